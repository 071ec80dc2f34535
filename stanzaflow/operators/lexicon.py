"""Five disciplines of matching a lexicon against texts.  They give different results on purpose.

``masked_counts``       longest words first over the whole text; hits are masked before shorter words
``leftmost_matches``    left to right, the longest word at each place, then on behind it
``interval_matches``    candidate intervals, then greedily without overlap by length, weight, place
``contained``           the set of words that occur anywhere
``undominated``         the words that occur, without those inside a longer one that occurs

On ``ABCDAB`` with the words AB and BCD the first gives BCD once and AB once, the second gives AB twice.

Lexicons are small dimension tables given as Python lists: they become literals of the plan, so the
documents are scanned once, without a join.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, literal, places_of, table_of
from ..functions.text import text_of

MASK = "\x00"


def by_length(words) -> list[str]:
    """Longest first, equal lengths by code points."""
    return sorted(set(words), key=lambda w: (-len(w), w))


def quoted(words) -> str:
    """A pattern of any of the words, the longest first."""
    return "|".join(map(literal, by_length(words)))


def mask(x, words) -> Column:
    """Overwrite each word by a placeholder of the same length, longest words first."""
    out = text_of(x)
    for w in by_length(words):
        out = F.replace(out, F.lit(w), F.lit(MASK * len(w)))
    return out


def masked_counts(x, words, excluded=()) -> Column:
    """``array<struct<word, hits>>`` of the words that occur, masking as it goes, in lexicon order.

    Only the words that occur at all are walked through: masking can take hits away but never make one.  A hit is overwritten
    by one placeholder, so the text's loss of bytes tells how many there were.
    """
    text = mask(x, excluded)
    present = F.filter(F.array(*[F.lit(w) for w in by_length(words)]), lambda w: F.contains(text, w))
    start = F.struct(text.alias("t"), F.array().cast("array<struct<word:string,hits:int>>").alias("found"))

    def step(acc, w):
        rest = F.replace(acc["t"], w, F.lit(MASK))
        shorter = F.octet_length(w) > 1
        gone = F.when(shorter, F.octet_length(acc["t"]) - F.octet_length(rest)).otherwise(F.octet_length(acc["t"]) - F.octet_length(F.replace(acc["t"], w, F.lit(""))))
        hits = (gone / F.when(shorter, F.octet_length(w) - 1).otherwise(F.lit(1))).cast("int")
        return F.struct(rest.alias("t"), F.when(hits > 0, F.array_append(acc["found"], F.struct(w.alias("word"), hits.alias("hits")))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(present, start, step)["found"]


def leftmost_matches(x, words) -> Column:
    """``array<string>`` of matches from left to right: leftmost, then longest."""
    return F.regexp_extract_all(text_of(x), F.lit(f"({quoted(words)})"), F.lit(1))


def leftmost_spans(docs: DataFrame, words, id_col: str = "doc_id", text_col: str = "text", context: int | None = None) -> DataFrame:
    """``id, match_no, word, start_offset, end_offset`` of the left-to-right matches.

    With ``context`` the columns ``left`` and ``right`` hold so many characters on both sides.
    """
    pattern = "|".join(map(re.escape, by_length(words)))
    sides = [] if context is None else ["left", "right"]
    kind = pa.list_(pa.struct([("word", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), *[(c, pa.string()) for c in sides]]))

    @F.arrow_udf("array<struct<word:string,start_offset:int,end_offset:int" + "".join(f",{c}:string" for c in sides) + ">>")
    def found(texts: pa.Array) -> pa.Array:
        fits = re.compile(pattern)

        def spans(text: str) -> list[tuple]:
            out = []
            for m in fits.finditer(text):
                a, b = m.span()
                out.append((m.group(), a, b) if context is None else (m.group(), a, b, text[max(a - context, 0) : a], text[b : b + context]))
            return out

        return pa.array([spans(t.as_py()) for t in texts], type=kind)

    rows = docs.select(F.col(id_col), F.posexplode(found(text_of(text_col))).alias("_n", "s"))
    return rows.select(id_col, (F.col("_n") + 1).alias("match_no"), "s.*")


def contained(x, words) -> Column:
    """``array<string>`` of the words that occur in a text, each once."""
    text = text_of(x)
    return F.filter(F.array(*[F.lit(w) for w in by_length(words)]), lambda w: F.contains(text, w))


def undominated(x, words) -> Column:
    """The words that occur, without those inside a longer word that occurs."""
    found = contained(x, words)
    return F.filter(found, lambda w: ~F.exists(found, lambda other: (other != w) & F.contains(other, w)))


def longest_contained(x, words) -> Column:
    """The longest word that occurs (ties by code points), null if none does."""
    found = contained(x, words)
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def _accepted(text: str, terms: list[tuple[str, float]], excluded: list[str], negators: tuple[str, ...]) -> list[tuple]:
    """One label's hits in a text, ``start, term, weight`` by place: its free occurrences taken one by one, the longest first, then the heaviest, then the leftmost.

    An occurrence is blocked right behind a negator, and where an excluded phrase covers it; of each phrase only the first one
    near the occurrence is looked at.
    """
    ranked = []
    for term, weight in terms:
        n, start = len(term), text.find(term)
        while start >= 0:
            end = start + n
            if not text.endswith(negators, 0, start):
                for p in excluded:
                    at = text.find(p, max(start - len(p), 0), end + len(p))
                    if 0 <= at <= start and end <= at + len(p):
                        break
                else:
                    ranked.append((-n, -weight, start, term))
            start = text.find(term, end)
    ranked.sort()
    used, taken = bytearray(len(text)), []
    for shorter, lighter, start, term in ranked:
        end = start - shorter
        if used.find(1, start, end) < 0:
            used[start:end] = b"\x01" * -shorter
            taken.append((start, term, -lighter))
    return sorted(taken)


def accepted_by_label(x, labelled_terms: dict[str, list[tuple[str, float]]], excluded=(), negators=(), single=None) -> Column:
    """``array<struct<label, hits: array<struct<start, term, weight>>>>``: each label's hits in a text, by place.

    A term of one character counts only if it is in ``single`` (if given).  Candidates are taken one by one, the longest first,
    then the heaviest, then the leftmost, if they overlap none of the label taken before.
    """
    rows = [(label, [(t, float(w)) for t, w in terms if t and (len(t) > 1 or single is None or t in single)]) for label, terms in labelled_terms.items()]
    phrases, before = list(excluded), tuple(negators)

    @F.arrow_udf("array<struct<label:string,hits:array<struct<start:int,term:string,weight:double>>>>")
    def found(texts: pa.Array) -> pa.Array:
        hits, ends = [], [0]
        for text in texts.to_pylist():
            near = [p for p in phrases if p in text]
            for _, terms in rows:
                hits += _accepted(text, terms, near, before)
                ends.append(len(hits))
        cells = [pa.array(c, type=t) for c, t in zip(zip(*hits) if hits else ([], [], []), (pa.int32(), pa.string(), pa.float64()))]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cells, ["start", "term", "weight"]))
        labels = pa.array([label for label, _ in rows] * len(texts), pa.string())
        borders = pa.array(range(0, len(labels) + 1, len(rows)) if rows else [0] * (len(texts) + 1), pa.int32())
        return pa.ListArray.from_arrays(borders, pa.StructArray.from_arrays([labels, listed], ["label", "hits"]))

    return found(text_of(x))


def accepted_hits(x, terms: list[tuple[str, float]], excluded=(), negators=(), single=None) -> Column:
    """``array<struct<start, term, weight>>`` of the terms of one label."""
    return F.get(accepted_by_label(x, {"": terms}, excluded, negators, single), F.lit(0))["hits"]


def interval_matches(docs: DataFrame, labelled_terms: dict[str, list[tuple[str, float]]], id_col: str = "doc_id", text_col: str = "text", excluded=(), negators=(), single=None) -> DataFrame:
    """``id, label, term, weight, start`` for each accepted hit of each label; no shuffle."""
    found = docs.select(F.col(id_col), F.explode(accepted_by_label(text_col, labelled_terms, excluded, negators, single)).alias("l"))
    return found.select(id_col, "l.label", F.explode("l.hits").alias("h")).select(id_col, "label", "h.term", "h.weight", "h.start")


def matches_outside(docs: DataFrame, words, barred: dict[str, tuple[str | None, str | None]], id_col: str = "doc_id", text_col: str = "text", reach: int = 8) -> DataFrame:
    """``leftmost_spans`` without the matches whose surroundings rule them out.

    ``barred`` gives for a word a pattern of the ``reach`` characters before it and one of those behind it (either may be
    none).  A match that is ruled out has still used up its text: no shorter word is looked for inside it.
    """
    text = text_of(text_col)
    rows = leftmost_spans(docs.select(id_col, text_col), words, id_col, text_col, context=reach)
    ok = F.lit(True)
    for word, (before, behind) in barred.items():
        hit = F.lit(False)
        if before is not None:
            hit |= F.col("left").rlike(f"(?:{before})$")
        if behind is not None:
            hit |= F.col("right").rlike(f"^(?:{behind})")
        ok &= ~((F.col("word") == word) & hit)
    return rows.filter(ok).drop("left", "right")


def companions(x, rules: dict[str, list[str]], but: str | None = None) -> Column:
    """``array<string>`` of the names one of whose aliases occurs, each once, by name."""
    text = text_of(x)
    names = [(n, sorted(set(a))) for n, a in sorted(rules.items()) if n != but]
    found = [F.when(F.exists(F.array(*[F.lit(a) for a in aliases]), lambda a: F.contains(text, a)), F.lit(n)) for n, aliases in names]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def context_labels(x, rules: dict[str, list[str]], excluded=(), negators=(), negated_up_to: int = 2) -> Column:
    """``array<struct<label, words>>``: the keywords of each label that stand somewhere free, longest first.

    A place isn't free inside an excluded phrase (the last one that ends by the keyword's end), or, for words of at most
    ``negated_up_to`` characters, right behind a negator.  Words inside a longer kept word of the label are dropped.
    """
    rows = [{"label": label, "words": [{"word": w, "pattern": literal(w)} for w in by_length(words)]} for label, words in rules.items()]
    labels = table_of(rows, "array<struct<label:string,words:array<struct<word:string,pattern:string>>>>")
    barred = table_of([{"phrase": p, "back": literal(p[::-1])} for p in excluded], "array<struct<phrase:string,back:string>>")

    def in_phrase(text: Column, at: Column, w: Column, p: Column) -> Column:
        before = F.substring(text, F.lit(1), at + F.length(w))
        last = F.length(before) - F.length(F.element_at(F.split(F.reverse(before), p["back"], F.lit(2)), 1)) - F.length(p["phrase"])
        return F.contains(before, p["phrase"]) & (last <= at) & (at + F.length(w) <= last + F.length(p["phrase"]))

    def negated(text: Column, at: Column, w: Column) -> Column:
        behind = F.exists(F.lit(list(negators)), lambda n: (at >= F.length(n)) & (F.substring(text, at - F.length(n) + 1, F.length(n)) == n))
        return (F.length(w) <= negated_up_to) & behind

    def free(text: Column, t: Column) -> Column:
        ok = lambda at: ~F.exists(barred, lambda p: in_phrase(text, at, t["word"], p)) & (~negated(text, at, t["word"]) if negators else F.lit(True))
        return F.exists(places_of(text, t["word"], overlapping=True, pattern=t["pattern"]), ok)

    def kept(text: Column, la: Column) -> Column:
        words = F.transform(F.filter(la["words"], lambda t: F.contains(text, t["word"]) & free(text, t)), lambda t: t["word"])
        longest = let(words, lambda ws: F.filter(ws, lambda w: ~F.exists(ws, lambda o: (o != w) & F.contains(o, w))))
        return F.struct(la["label"].alias("label"), longest.alias("words"))

    return let(text_of(x), lambda text: F.filter(F.transform(labels, lambda la: kept(text, la)), lambda e: F.size(e["words"]) > 0))


def merged_labels(rows: DataFrame, id_col: str, labels: str) -> DataFrame:
    """``id, label, words``: the words of all contexts of a document by label, longest first."""
    words = rows.select(id_col, F.explode(labels).alias("l")).select(id_col, "l.label", F.explode("l.words").alias("w")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("w")).alias("n"), "w")))  # words of a lexicon
    return words.groupBy(id_col, "label").agg(F.transform(ordered, lambda s: s["w"]).alias("words"))
