"""Scalar text expressions: identities, normalisers, excerpts, tokens.

All are built-in column expressions, so they stay in generated code.  Delimiters and suffixes are
parameters; the defaults suit Latin script, the ``CJK_*`` values suit classical Chinese.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import literal

UNIT = "\x1f"  # between the parts of a hashed identity
CJK_SENTENCE_END = "。！？!?；;"
LATIN_SENTENCE_END = ".!?;"
HAN = "\\u4e00-\\u9fff"
HAN_WIDE = "\\u3400-\\u9fff"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_of(x) -> Column:
    """A value as text, null as empty: ``concat_ws`` would drop nulls and shift the parts."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def content_hash(*parts) -> Column:
    """SHA-256 of parts joined by the unit separator."""
    return F.sha2(F.concat_ws(UNIT, *[text_of(p) for p in parts]), 256)


def document_id(source_id, *parts) -> Column:
    """The source's own id, else ``local-`` and 24 hex digits of the parts' hash."""
    own = F.nullif(F.trim(text_of(source_id)), F.lit(""))
    return F.coalesce(own, F.concat(F.lit("local-"), F.left(content_hash(*parts), F.lit(24))))


def normal_title(x) -> Column:
    """Without brackets, punctuation and blanks, in lower case; a part number ``其一`` keeps its numeral."""
    numbered = F.regexp_replace(text_of(x), "其([一二三四五六七八九十百]+)", "$1")
    return F.lower(F.regexp_replace(numbered, r"(?U)[\s\p{Punct}·，。！？；：、（）《》〈〉「」『』【】“”‘’—…]+", ""))


def first_sentence(x, ends: str = LATIN_SENTENCE_END) -> Column:
    """Text before the first sentence end or line end."""
    return F.element_at(F.split(F.trim(text_of(x)), f"[{ends}\n]", 2), 1)


def excerpt(x, limit: int = 160) -> Column:
    """White space runs as one blank, trimmed, cut at ``limit`` characters."""
    return F.left(F.trim(F.regexp_replace(text_of(x), r"(?U)\s+", " ")), F.lit(limit))


def snippet(x, query: str, radius: int = 54) -> Column:
    """The first hit with ``radius`` characters on each side, ellipses where text is left out; the start if no hit.

    Runs of white space count as one blank.
    """
    text = F.trim(F.regexp_replace(text_of(x), r"(?U)\s+", " "))
    gap = F.regexp_extract(text, f"(?isu)^(.*?){literal(query)}", 1)  # sought in the text itself: lower case may have another length
    at = F.when(text.rlike(f"(?isu){literal(query)}"), F.length(gap) + 1).otherwise(F.lit(0))
    start = F.greatest(at - 1 - radius, F.lit(0))
    end = F.least(F.when(at > 0, at - 1 + len(query) + radius).otherwise(F.lit(2 * radius)), F.length(text))
    body = F.substring(text, start + 1, end - start)
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))


def strip_suffix(x, suffixes: list[str]) -> Column:
    """Remove one of the suffixes from the end, the longest that fits."""
    ordered = "|".join(f"\\Q{s}\\E" for s in sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(_c(x), f"(?<=.)(?:{ordered})$", "")


def strip_suffixes(x, suffixes: list[str]) -> Column:
    """Remove suffixes as long as one fits, leaving one character at least."""
    ordered = "|".join(f"\\Q{s}\\E" for s in sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(_c(x), f"(?<=.)(?:{ordered})+$", "")


def translate_script(x, table: dict[str, str]) -> Column:
    """Replace characters one for one, such as traditional by simplified forms."""
    return F.translate(_c(x), "".join(table), "".join(table.values()))


def damaged(x) -> Column:
    """Signs of a wrong decoding: a replacement character, ``??``, or two question marks outside addresses."""
    plain = F.regexp_replace(text_of(x), r"https?://\S+", "")
    return text_of(x).contains("�") | plain.contains("??") | (F.size(F.split(plain, r"\?")) >= 3)


def class_length(x, characters: str = HAN) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text_of(x), f"[^{characters}]", ""))


def short_tokens(x) -> Column:
    """Distinct 1- and 2-grams of each run of letters and digits, in lower case."""
    runs = F.regexp_extract_all(F.lower(text_of(x)), F.lit(r"(?U)([^\W_]+)"), F.lit(1))
    grams = F.transform(
        runs,
        lambda r: F.concat(
            F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1))),
            F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>")),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigrams(x) -> Column:
    """All 3-grams of a text in lower case, in order, with repeats: one pass of a pattern that takes a character and looks ahead."""
    return F.regexp_extract_all(F.lower(text_of(x)), F.lit("(?s)(?=(...))."), F.lit(1))


def first_matching(x, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that fits, in order."""
    chain = None
    for pattern, label in rules:
        fits = text_of(x).rlike(pattern)
        chain = F.when(fits, F.lit(label)) if chain is None else chain.when(fits, F.lit(label))
    return chain.otherwise(F.lit(default)) if chain is not None else F.lit(default)


def sample_level(n) -> Column:
    """How far a count can be trusted."""
    return F.when(_c(n) < 10, "low").when(_c(n) < 30, "medium").otherwise("high")


def host_family(url, aliases: dict[str, str]) -> Column:
    """An address's host without ``www.``, mapped to its family."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(text_of(url), F.lit("HOST")), text_of(url))), r"^www\d*\.", "")
    if not aliases:
        return host
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.coalesce(F.element_at(table, host), host)


# fixed values: milliseconds by kind of character
DELAYS = {"\n": 160, "。！？；": 230, "，、：": 115}
DELAY = 38


def reveal_delay(x) -> Column:
    """How long a text takes to be shown character by character, in milliseconds."""
    text = text_of(x)
    total = F.length(text) * DELAY
    for characters, delay in DELAYS.items():
        total += (F.length(text) - F.length(F.translate(text, characters, ""))) * (delay - DELAY)
    return total


def resolve_key(x, keys: list[str], prefixes: list[str] = (), suffixes: list[str] = ()) -> Column:
    """A name as a key of a dictionary: itself without a prefix and a suffix, else the longest key of two characters or more in it, else what is left of it."""
    head = F.regexp_replace(text_of(x), "^(?:" + "|".join(f"\\Q{p}\\E" for p in sorted(prefixes, key=len, reverse=True)) + ")(?=.)", "") if prefixes else text_of(x)
    name = strip_suffix(head, list(suffixes)) if suffixes else head
    ordered = sorted((k for k in set(keys) if len(k) >= 2), key=lambda k: (-len(k), k))
    inside = F.get(F.filter(F.lit(ordered), lambda k: F.contains(name, k)), F.lit(0)) if ordered else F.lit(None)
    return F.when(name.isin(*keys), name).otherwise(F.coalesce(inside, name))


def source_clause(x, marker: str, vetoes: list[str], low: int = 8, high: int = 156, ends: str = "；;") -> Column:
    """The first clause behind a marker, without addresses and white space; null without a marker, with a vetoed word, or if it is too short; cut at ``high``."""
    behind = F.regexp_extract(text_of(x), f"(?s)(?:{marker})[：:]?(.*)$", 1)
    clause = F.element_at(F.split(F.regexp_replace(behind, r"https?://\S+", ""), f"[{ends}]", 2), 1)
    clause = F.regexp_replace(F.regexp_replace(clause, r"(?U)\s+", " "), r"^[ ：，。,.:]+|[ ：，。,.:]+$", "")
    bad = F.exists(F.lit([v.lower() for v in vetoes]), lambda v: F.contains(F.lower(clause), v)) if vetoes else F.lit(False)
    return F.when((F.length(clause) >= low) & ~bad, F.left(clause, F.lit(high)))


def hash_differs(declared, *parts) -> Column:
    """Does a declared hash not fit the content?  A missing declaration doesn't differ."""
    given = F.nullif(F.trim(text_of(declared)), F.lit(""))
    return F.coalesce(given != content_hash(*parts), F.lit(False))
