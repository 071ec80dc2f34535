"""Search: inverted indexes, lexical scoring, vectors, rank fusion, facets.

An index is a table ``postings(token, doc_id, tf)`` to be written partitioned or bucketed by token; searching
reads the query's tokens only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import short_tokens, snippet, text_of, trigrams

K1, B = 1.2, 0.75
RRF = 60
MAX_QUERY, MAX_LIMIT, MAX_OFFSET = 160, 50, 100_000


def check_search(query: str, limit: int = 20, offset: int = 0, scope: str = "all") -> str:
    """The trimmed query, or an error about an argument out of range."""
    if not isinstance(query, str) or len(query) > MAX_QUERY:
        raise ValueError(f"query must be text of at most {MAX_QUERY} characters")
    if not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    if not isinstance(offset, int) or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be 0 to {MAX_OFFSET}")
    if scope not in ("all", "doc", "line"):
        raise ValueError("scope must be all, doc or line")
    return query.strip()


def route(query: str) -> str:
    """``trigram`` from three characters on, ``short`` for one or two letters or digits, else ``like``."""
    if len(query) >= 3:
        return "trigram"
    return "short" if query.isalnum() else "like"


def trigram_postings(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """``token, id, tf``, of some tokens only if they are given."""
    grams = trigrams(text_col)
    grams = grams if only is None else F.filter(grams, lambda g: g.isin(only))
    return docs.select(F.explode(grams).alias("token"), id_col).groupBy("token", id_col).agg(F.count("*").cast("int").alias("tf"))


def trigram_length(text_col: str) -> Column:
    return F.greatest(F.length(F.lower(text_of(text_col))) - 2, F.lit(0))


def document_lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, length`` in trigrams."""
    return docs.select(F.col(id_col), trigram_length(text_col).alias("length"))


def query_trigrams(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[i : i + 3] for i in range(len(q) - 2)})


def short_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token, id`` of 1- and 2-grams."""
    return docs.select(F.explode(short_tokens(text_col)).alias("token"), id_col)


def phrase_search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_hits``: documents that hold the query literally, in any case."""
    q = query.lower()
    text = F.lower(text_of(text_col))
    hits = ((F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / len(q)).cast("int")
    return docs.filter(F.contains(text, F.lit(q))).select(id_col, hits.alias("n_hits"))


def bm25(postings: DataFrame, lengths: DataFrame, docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of the documents that hold the query literally; larger is better.

    The candidates are the documents with all trigrams of the query; they are verified against the text.
    Each distinct trigram adds idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)), idf = ln(1 + (N - n + 0.5) / (n + 0.5)).
    """
    q = query.lower()
    grams = query_trigrams(query)
    hit = postings.filter(F.col("token").isin(grams))
    n_docs = lengths.agg(F.count("*").alias("n_all"), F.avg("length").alias("avg"))  # one row
    df = hit.groupBy("token").agg(F.count("*").alias("n_token"))  # a row for each trigram of the query
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg"))
    idf = F.log(1 + (F.col("n_all") - F.col("n_token") + 0.5) / (F.col("n_token") + 0.5))
    scored = hit.join(F.broadcast(df), "token").join(lengths, id_col).crossJoin(F.broadcast(n_docs)).withColumn("part", idf * F.col("tf") * (K1 + 1) / norm)
    sums = scored.groupBy(id_col).agg(F.sum("part").alias("score"), F.count("*").alias("found")).filter(F.col("found") == len(grams))
    verified = docs.filter(F.contains(F.lower(text_of(text_col)), F.lit(q))).select(id_col)
    return sums.join(verified, id_col, "left_semi").select(id_col, F.round("score", 6).alias("score"))


def bm25_scan(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``bm25`` gives, without an index: two scans and no shuffle of rows.

    The first counts the documents with each trigram of the query, their number and mean length; the second scores the
    documents that hold the query.
    """
    q, grams = query.lower(), query_trigrams(query)
    text = F.lower(text_of(text_col))
    stats = docs.agg(F.count("*").alias("n_all"), F.avg(trigram_length(text_col)).alias("avg"), *[F.count_if(F.contains(text, F.lit(g))).alias(f"n{k}") for k, g in enumerate(grams)])  # one row
    held = docs.filter(F.contains(text, F.lit(q))).select(id_col, trigram_length(text_col).alias("length"), F.filter(trigrams(text_col), lambda g: g.isin(grams)).alias("_g"))
    norm = K1 * (1 - B + B * F.col("length") / F.col("avg"))
    score = F.lit(0.0)
    for k, g in enumerate(grams):
        tf = F.size(F.filter("_g", lambda x: x == g))
        score += F.log(1 + (F.col("n_all") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)) * tf * (K1 + 1) / (tf + norm)
    return held.crossJoin(F.broadcast(stats)).select(id_col, F.round(score, 6).alias("score"))


def _hits(rows: DataFrame, query: str, fields: list[str], id_col: str, equal_id: str | None = None, tokens: list[str] | None = None) -> DataFrame:
    """``id, relevance`` of the rows that one of ``fields`` answers the query by, smaller is better.

    From three characters on the query must stand in one field, and BM25 over the fields together ranks; one or two letters or
    digits must be a token of ``tokens`` (the fields, if not given); else any field holds the query, or ``equal_id`` is it.
    """
    kind = route(query)
    q = query.lower()
    if not query:
        return rows.select(id_col, F.lit(0.0).alias("relevance"))
    if kind == "trigram":
        whole = rows.select(id_col, F.concat_ws("\x1f", *[text_of(f) for f in fields]).alias("_all"))
        return bm25_scan(whole, query, id_col, "_all").select(id_col, (-F.col("score")).alias("relevance"))
    if kind == "short":
        found = F.lit(False)
        for f in tokens or fields:
            found |= F.array_contains(short_tokens(f), q)
    else:
        found = F.col(equal_id).cast("string") == query if equal_id else F.lit(False)
        for f in fields:
            found |= F.contains(F.lower(text_of(f)), F.lit(q))
    return rows.filter(found).select(id_col, F.lit(0.0).alias("relevance"))


def find(docs: DataFrame, lines: DataFrame, query: str, scope: str = "all", equal: dict[str, str | None] | None = None, tags: DataFrame | None = None, tag: str | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of hits ``kind, doc_id, line_no, relevance, snippet`` and, as a table of one row, the ``total``.

    ``docs(doc_id, title, poet, text, ...)`` and ``lines(doc_id, line_no, text)``.  The scope is ``doc``, ``line`` or ``all``; ``equal``
    holds column values a document must have; ``tag`` is the tag or label of a row in ``tags(doc_id, line_no, tag, label)``, for a line
    of that very line.  One or two letters or digits are looked up as tokens: of lines in lines, of titles, poets and lines in documents.
    """
    q = check_search(query, limit, offset, scope)
    own = docs
    for name, value in (equal or {}).items():
        own = own if value is None else own.filter(F.col(name) == value)
    wanted = None if tag is None else tags.filter((F.col("tag") == tag) | (F.col("label") == tag))
    parts = []
    if scope in ("all", "doc"):
        rows = own if wanted is None else own.join(wanted.select("doc_id"), "doc_id", "left_semi")
        hit = _hits(rows, q, ["title", "poet", "text"], "doc_id", "doc_id")
        parts.append(rows.select("doc_id", F.col("text").alias("_content")).join(hit, "doc_id").select(F.lit("doc").alias("kind"), "doc_id", F.lit(None).cast("int").alias("line_no"), "relevance", "_content"))
    if scope in ("all", "line"):
        rows = lines.select("doc_id", "line_no", F.col("text").alias("line")).join(own.select("doc_id", "title", "poet"), "doc_id")
        rows = rows if wanted is None else rows.join(wanted.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")
        rows = rows.withColumn("_id", F.struct("doc_id", "line_no"))
        hit = _hits(rows, q, ["line", "title", "poet"], "_id", tokens=["line"]).withColumnRenamed("_id", "_hit")
        found = rows.join(hit, F.col("_id") == F.col("_hit"))
        parts.append(found.select(F.lit("line").alias("kind"), "doc_id", F.col("line_no").cast("int").alias("line_no"), "relevance", F.col("line").alias("_content")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    total = every.agg(F.count("*").alias("total"))
    first = page(every, ["relevance", "kind", "doc_id", F.coalesce("line_no", F.lit(0))], limit, offset)
    return first.select("kind", "doc_id", "line_no", F.round("relevance", 6).alias("relevance"), snippet("_content", q).alias("snippet")), total


def with_mentions(hits: DataFrame, mentions: DataFrame, label: str = "label", method: str | None = None) -> DataFrame:
    """Adds ``labels`` to a page of hits: the distinct labels of a document, or of the very line, and with ``method`` the ``methods`` they were found by.

    Mentions are summed up by line and by document and joined to the page once each.
    """
    cells = {"labels": label} | ({"methods": method} if method else {})
    sets = lambda tag: [F.collect_set(c).alias(f"_{tag}_{name}") for name, c in cells.items()]  # noqa: E731 - labels of a lexicon
    own = mentions.groupBy("doc_id", "line_no").agg(*sets("l")).withColumnRenamed("line_no", "_n").withColumnRenamed("doc_id", "_d")
    whole = mentions.groupBy("doc_id").agg(*sets("d"))
    joined = hits.join(own, (F.col("doc_id") == F.col("_d")) & (F.col("line_no") == F.col("_n")), "left").join(whole, "doc_id", "left")
    found = [F.when(F.col("line_no").isNotNull(), F.col(f"_l_{n}")).otherwise(F.col(f"_d_{n}")) for n in cells]
    return joined.select(*hits.columns, *[F.array_sort(F.coalesce(f, F.array().cast("array<string>"))).alias(n) for f, n in zip(found, cells)])


def facets(docs: DataFrame, equal: dict[str, str | None], tags: DataFrame | None = None, tag: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows with the given column values, and with a tag in ``tags(id, tag, label)`` as its tag or label."""
    out = docs
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if tag is not None:
        wanted = tags.filter((F.col("tag") == tag) | (F.col("label") == tag)).select(id_col)
        out = out.join(wanted, id_col, "left_semi")
    return out


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one, null if it is zero or not finite; its length is worked out once."""
    whole = lambda norm: F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))
    return let(F.sqrt(dot(v, v)), whole)


def cosine(v: Column, q: Column) -> Column:
    """Cosine with a unit vector ``q``, null for vectors without a direction."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), dot(v, q) / norm)


def vector_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, tags: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """``id, score, relevance, place``: exact cosine over all rows that fit; each task keeps its own best before they meet.

    ``where`` is a condition on the metadata columns; it is applied before anything is scored and reaches the files.  ``tags(id)`` keeps the ids that
    stand in it.  ``offset`` skips the best so many; places count on from there.
    """
    norm = sum(x * x for x in query) ** 0.5
    if not query or not norm or norm != norm or norm == float("inf"):
        raise ValueError("the query vector must be finite and not zero")
    rows = vectors if where is None else vectors.filter(where)
    rows = rows if tags is None else rows.join(tags.select(id_col), id_col, "left_semi")
    score = F.round(cosine(F.col(vec_col), F.array(*[F.lit(x / norm) for x in query])), 6)
    best = rows.select(id_col, score.alias("score")).filter("score is not null").orderBy(F.desc("score"), id_col).offset(offset).limit(k)
    relevance = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") + 1) / 2)), 6)
    return best.select(id_col, "score", relevance.alias("relevance"), (F.row_number().over(W.orderBy(F.desc("score"), id_col)) + offset).alias("place"))  # k rows


def reciprocal_rank_fusion(lists: list[DataFrame], id_col: str, place_col: str = "place", k: int = RRF) -> DataFrame:
    """``id, relevance``: sum of 1 / (k + place) over the lists, over its largest possible value."""
    both = None
    for df in lists:
        own = df.select(id_col, (1.0 / (k + F.col(place_col))).alias("s"))
        both = own if both is None else both.unionByName(own)
    return both.groupBy(id_col).agg(F.round(F.sum("s") * (k + 1) / len(lists), 6).alias("relevance"))


def weighted_mean_vectors(chunks: DataFrame, owner: str, weight: str, vec: str, size: int) -> DataFrame:
    """``owner, vector``: the weighted mean of an owner's chunk vectors of ``size`` numbers, made a unit vector; one sum for each place."""
    sums = chunks.groupBy(owner).agg(F.sum(weight).alias("_w"), *[F.sum(F.get(vec, F.lit(i)) * F.col(weight)).alias(f"_{i}") for i in range(size)])
    mean = F.array(*[F.col(f"_{i}") / F.col("_w") for i in range(size)])
    return sums.select(owner, mean.alias("v")).select(owner, unit(F.col("v")).alias("vector"))


def gloss(selection: DataFrame, entries: DataFrame, text: str = "selected", forms: str = "forms") -> DataFrame:
    """Each selected text with the glossary entry one of whose forms equals it in any case."""
    keys = entries.withColumn("_form", F.explode(forms)).withColumn("_form", F.lower("_form"))
    return selection.join(keys, F.lower(text) == F.col("_form"), "left").drop("_form")


def merge_mentions(mentions: DataFrame, by: list[str], order: list[str], line: str, place: str, evidence: str) -> DataFrame:
    """One row for each mentioned thing: the first mention's fields, all places, distinct evidence; the line only if all share it."""
    first = F.min(F.struct(*dict.fromkeys([*order, line, evidence]))).alias("f")
    g = mentions.groupBy(*by).agg(
        first, F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("places"), F.array_sort(F.collect_set(evidence)).alias("evidence"),
        F.countDistinct(line).alias("_lines"),
    )
    return g.select(*by, F.when(F.col("_lines") == 1, F.col(f"f.{line}")).alias(line), "n", "places", "evidence")


def snippets(hits: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    return hits.withColumn("snippet", snippet(text_col, query))
