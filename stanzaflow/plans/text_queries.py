"""Queries on texts: identities, segmentation, lexicon scans, stylometry, affect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import affect, lexicon, segment, stylometry
from . import lexicons as L


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(words) -> str:
    return "(" + "|".join(words) + ")"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR)
  ELSE 'local-' || left(sha256(source || chr(31) || lang || chr(31) || text), 24) END AS stable_id, sha256(text) AS body_hash FROM documents""")
def doc_identity_hash(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("own", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")))
    return docs.select("doc_id", T.document_id("own", "source", "lang", "text").alias("stable_id"), T.content_hash("text").alias("body_hash"))


@query("""SELECT p_partkey, lower(regexp_replace(p_name || ' (' || p_type || ')', '[[:space:][:punct:]]+', '', 'g')) AS title_norm FROM part""")
def title_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.normal_title(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("title_norm"))


@query(r"""SELECT doc_id, regexp_extract(trim(text), '^[^.!?;\n]*', 0) AS first_sentence FROM documents""")
def first_sentence(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.first_sentence("text").alias("first_sentence"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160) AS excerpt FROM documents""")
def excerpt_160(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents), h AS (SELECT doc_id, text, strpos(lower(text), 'tion') AS p, length(text) AS n FROM t),
  b AS (SELECT *, greatest(p - 1 - 54, 0) AS a, least(CASE WHEN p > 0 THEN p - 1 + 4 + 54 ELSE 108 END, n) AS z FROM h)
  SELECT doc_id, (CASE WHEN a > 0 THEN '…' ELSE '' END) || substring(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) || (CASE WHEN z < n THEN '…' ELSE '' END) AS snippet FROM b""")
def snippet_first_hit(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.snippet("text", "tion").alias("snippet"))


_PIECES = r"""p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?;\r\n]*[.!?;]|[^.!?;\r\n]*(?:\r\n|\r|\n)|[^.!?;\r\n]+')) AS raw,
    generate_subscripts(regexp_extract_all(text, '[^.!?;\r\n]*[.!?;]|[^.!?;\r\n]*(?:\r\n|\r|\n)|[^.!?;\r\n]+'), 1) AS pos FROM documents),
  q AS (SELECT doc_id, pos, raw, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0,
    regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, length(raw) - length(regexp_replace(raw, '^\s+', '')) AS lead_n FROM p),
  b AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS blanks FROM q),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, blanks - coalesce(lag(blanks) OVER (PARTITION BY doc_id ORDER BY pos), blanks) AS gap FROM b WHERE line <> '')"""


@query(f"""WITH {_PIECES}
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(1 + sum(CASE WHEN gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS stanza_no,
    CAST(off0 + lead_n AS INTEGER) AS start_offset, CAST(off0 + lead_n + length(line) AS INTEGER) AS end_offset, sha256(line) AS line_hash FROM k""")
def sentence_explode_offsets(spark, sf_dir):
    return segment.split_lines(_t(spark, sf_dir, "documents")).drop("text")


@query(f"""WITH {_PIECES} SELECT count(*) AS n_lines, CAST(sum(CASE WHEN substring(text, CAST(off0 + lead_n + 1 AS BIGINT), length(line)) <> line THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM k JOIN documents USING (doc_id)""")
def line_offset_check(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    lines = segment.split_lines(docs).withColumnRenamed("text", "line").join(docs.select("doc_id", "text"), "doc_id")
    wrong = F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) != F.col("line")
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(wrong).alias("bad"))


_CLAUSES = r"""c0 AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'))) AS clause, generate_subscripts(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'), 1) AS pos FROM documents),
  c AS (SELECT doc_id, clause, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS clause_no FROM c0 WHERE clause <> '')"""


@query(f"WITH {_CLAUSES} SELECT doc_id, CAST(clause_no AS INTEGER) AS clause_no, clause FROM c")
def clause_split(spark, sf_dir):
    return segment.split_clauses(_t(spark, sf_dir, "documents"))


@query(f"""WITH {_CLAUSES}, w AS (SELECT doc_id, clause_no, clause, string_agg(clause, '') OVER (PARTITION BY doc_id ORDER BY clause_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM c)
  SELECT doc_id, CAST(clause_no AS INTEGER) AS clause_no, context FROM w WHERE contains(clause, 'ontion')""")
def neighbor_context(spark, sf_dir):
    return segment.clauses_in_context(_t(spark, sf_dir, "documents"), "ontion")


@query(f"""WITH {_CLAUSES}, w AS (SELECT doc_id, clause_no, string_agg(clause, '') OVER (PARTITION BY doc_id ORDER BY clause_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM c)
  SELECT doc_id, count(*) AS clauses, CAST(sum(length(context)) AS BIGINT) AS chars FROM w GROUP BY doc_id""")
def context_windows(spark, sf_dir):
    near = segment.neighbour_context(segment.split_clauses(_t(spark, sf_dir, "documents")), "doc_id", "clause_no", "clause")
    return near.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.length("context")).alias("chars"))


@query(r"""WITH p AS (SELECT doc_id, trim(unnest(string_split_regex(text, '[,.!?;:\n]'))) AS phrase FROM documents)
  SELECT doc_id, phrase, count(*) AS n FROM p WHERE length(phrase) BETWEEN 5 AND 16 AND regexp_full_match(phrase, '[\p{L} ]+') GROUP BY ALL""")
def clean_phrases(spark, sf_dir):
    return segment.clean_phrases(_t(spark, sf_dir, "documents")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS run FROM benchmark),
  g AS (SELECT item_id, substring(run, i, k) AS token FROM r, (SELECT unnest(range(1, 400)) AS i), (SELECT unnest([1, 2]) AS k) WHERE i + k - 1 <= length(run))
  SELECT DISTINCT token, item_id FROM g""")
def short_token_index(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.explode(T.short_tokens("text")).alias("token"), "item_id")


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\x{00C0}-\x{024F}]', '', 'g')) AS accented, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower_ascii FROM documents""")
def class_lengths(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", T.class_length("text", "\\u00c0-\\u024f").cast("bigint").alias("accented"), T.class_length("text", "a-z").cast("bigint").alias("lower_ascii"))


_MASKED = "m0 AS (SELECT doc_id, lang, source, text AS t0 FROM documents), " + ", ".join(
    f"m{i + 1} AS (SELECT *, replace(t{i}, '{w}', repeat('#', {len(w)})) AS t{i + 1}, (length(t{i}) - length(replace(t{i}, '{w}', ''))) // {len(w)} AS h{i} FROM m{i})" for i, w in enumerate(L.WORDS)
)
_MASKED += ", hits AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, source, '{w}' AS word, '{L.FAMILIES[w]}' AS family, h{i} AS hits FROM m{len(L.WORDS)}" for i, w in enumerate(L.WORDS)) + ")"


def _masked(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    hits = docs.select("doc_id", "lang", "source", F.explode(lexicon.masked_counts("text", L.WORDS)).alias("h")).select("doc_id", "lang", "source", "h.word", "h.hits")
    families = F.create_map(*[F.lit(v) for pair in L.FAMILIES.items() for v in pair])
    return hits.withColumn("family", families[F.col("word")])


@query(f"WITH {_MASKED} SELECT doc_id, word, CAST(hits AS INTEGER) AS hits FROM hits WHERE hits > 0")
def lexicon_mask_counts(spark, sf_dir):
    return _masked(spark, sf_dir).select("doc_id", "word", "hits")


@query(f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(L.WORDS)}')) AS word FROM documents) SELECT doc_id, word, count(*) AS hits FROM e GROUP BY ALL""")
def lexicon_scan_counts(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(lexicon.leftmost_matches("text", L.WORDS)).alias("word"))
    return found.groupBy("doc_id", "word").agg(F.count("*").alias("hits"))


@query(f"""WITH e AS (SELECT item_id, unnest(regexp_extract_all(text, '{_q(L.WORDS)}')) AS word, generate_subscripts(regexp_extract_all(text, '{_q(L.WORDS)}'), 1) AS n,
    string_split_regex(text, '{_q(L.WORDS)}') AS gaps, regexp_extract_all(text, '{_q(L.WORDS)}') AS words FROM benchmark)
  SELECT item_id, CAST(n AS INTEGER) AS match_no, word, CAST(list_sum(list_transform(gaps[1:n], lambda g: length(g))) + coalesce(list_sum(list_transform(words[1:n-1], lambda g: length(g))), 0) AS INTEGER) AS start_offset FROM e""")
def lexicon_scan_offsets(spark, sf_dir):
    return lexicon.leftmost_spans(_t(spark, sf_dir, "benchmark"), L.WORDS, "item_id").drop("end_offset")


_LEX = "lex(word) AS (VALUES " + ", ".join(f"('{w}')" for w in L.WORDS) + ")"


@query(f"WITH {_LEX} SELECT lang, word, count(*) AS docs FROM documents JOIN lex ON contains(text, word) GROUP BY ALL")
def lexicon_contains_counts(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("lang", F.explode(lexicon.contained("text", L.WORDS)).alias("word"))
    return found.groupBy("lang", "word").agg(F.count("*").alias("docs"))


@query(f"""WITH {_LEX}, f AS (SELECT doc_id, word FROM documents JOIN lex ON contains(text, word))
  SELECT doc_id, word FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.word <> f.word AND contains(g.word, f.word))""")
def lexicon_undominated(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(lexicon.undominated("text", L.WORDS)).alias("word"))


_PER_DOC = "d AS (SELECT source, doc_id, sum(hits) AS hits FROM hits GROUP BY ALL)"


@query(f"""WITH {_MASKED}, {_PER_DOC}, g AS (SELECT source, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n_chars) AS BIGINT) AS chars FROM d JOIN documents USING (doc_id, source) GROUP BY source)
  SELECT source, hits, chars, round(hits * 100.0::DOUBLE / chars, 4) AS per_100 FROM g""")
def hits_per_100_chars(spark, sf_dir):
    hits = F.aggregate(lexicon.masked_counts("text", L.WORDS), F.lit(0), lambda a, h: a + h["hits"])
    docs = _t(spark, sf_dir, "documents").select("source", hits.alias("h"), "n_chars")
    return stylometry.hits_per_100(docs, "source", "h", "n_chars")


@query(f"""WITH {_MASKED}, s AS (SELECT lang, family, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY ALL)
  SELECT lang, family, hits, round(hits::DOUBLE / sum(hits) OVER (PARTITION BY lang)::DOUBLE, 4) AS share FROM s""")
def family_share(spark, sf_dir):
    return stylometry.family_share(_masked(spark, sf_dir), "lang", "family", "hits", sorted(set(L.FAMILIES.values())))


@query(f"""WITH {_MASKED}, s AS (SELECT source, word, CAST(sum(hits) AS BIGINT) AS n FROM hits WHERE hits > 0 GROUP BY ALL)
  SELECT source, word, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INTEGER) AS place FROM s QUALIFY place <= 3""")
def top_words_per_source(spark, sf_dir):
    sums = _masked(spark, sf_dir).groupBy("source", "word").agg(F.sum("hits").alias("n"))
    return stylometry.first_k(sums, "source", [F.desc("n"), "word"], 3)


@query(f"""WITH {_MASKED}, s AS (SELECT lang, word, CAST(sum(hits) AS BIGINT) AS n FROM hits WHERE hits > 0 GROUP BY ALL),
  l AS (SELECT *, round((n::DOUBLE / sum(n) OVER (PARTITION BY lang)::DOUBLE) / (sum(n) OVER (PARTITION BY word)::DOUBLE / sum(n) OVER ()::DOUBLE), 6) AS lift FROM s),
  r AS (SELECT lang, word, n, lift, CASE WHEN n < 2 THEN 1 ELSE 0 END AS few, CASE WHEN n >= 2 THEN round(n * lift, 6) ELSE 0.0::DOUBLE END AS score FROM l)
  SELECT lang, word, n, lift, CAST(row_number() OVER (PARTITION BY lang ORDER BY few, score DESC, n DESC, word) AS INTEGER) AS place FROM r QUALIFY place <= 6""")
def signature_lift_top6(spark, sf_dir):
    return stylometry.signature(_masked(spark, sf_dir), "lang", "word", "hits")


@query("""SELECT source, count(*) AS docs, round(avg(CASE WHEN contains(text, 'ontion') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS quiet_ratio FROM documents GROUP BY source""")
def quiet_ratio(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("hits", F.size(lexicon.leftmost_matches("text", ["ontion"])))
    return stylometry.quiet_ratio(docs, "source", "hits")


@query(f"""WITH {_PIECES}, d AS (SELECT source, k.doc_id, k.line_no, length(line) AS chars, length(regexp_extract_all(line, '{_q(L.WORDS)}')) AS hits FROM k JOIN documents USING (doc_id) WHERE length(line) >= 4),
  x AS (SELECT *, round(hits::DOUBLE / chars, 6) AS density FROM d)
  SELECT source, doc_id, CAST(line_no AS INTEGER) AS line_no, density, CAST(row_number() OVER (PARTITION BY source ORDER BY density DESC, doc_id, line_no) AS INTEGER) AS place FROM x QUALIFY place <= 5""")
def line_density_top5(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    lines = segment.split_lines(docs).filter(F.length("text") >= 4)
    density = F.round(F.size(lexicon.leftmost_matches("text", L.WORDS)) / F.length("text"), 6)
    scored = lines.select("doc_id", "line_no", density.alias("density")).join(docs.select("doc_id", "source"), "doc_id")
    return stylometry.first_k(scored, "source", [F.desc("density"), "doc_id", "line_no"], 5).select("source", "doc_id", "line_no", "density", "place")


@query(f"""WITH {_MASKED}, {_PER_DOC}, g AS (SELECT source, round(sum(hits)::DOUBLE * 100 / sum(n_chars)::DOUBLE, 6) AS rate, CAST(count(*) AS BIGINT) AS docs FROM d JOIN documents USING (doc_id, source) GROUP BY source),
  m AS (SELECT round(median(rate), 6) AS median FROM g WHERE docs >= 50)
  SELECT source, rate, docs, median, CASE WHEN docs >= 50 THEN CAST(row_number() OVER (PARTITION BY docs >= 50 ORDER BY rate DESC, source) AS INTEGER) END AS place, docs < 50 AND rate > median AS small_outlier FROM g, m""")
def qualified_rank_median(spark, sf_dir):
    hits = F.aggregate(lexicon.masked_counts("text", L.WORDS), F.lit(0), lambda a, h: a + h["hits"])
    docs = _t(spark, sf_dir, "documents").select("source", hits.alias("h"), "n_chars")
    rates = docs.groupBy("source").agg(F.round(F.sum("h").cast("double") * 100 / F.sum("n_chars").cast("double"), 6).alias("rate"), F.count("*").alias("docs"))
    return stylometry.qualified_ranking(rates, "source", "rate", "docs", 50)


_TAGS = "tags(tag) AS (VALUES " + ", ".join(f"('{w}')" for w in L.TAGS) + ")"


@query(f"""WITH {_TAGS}, p AS (SELECT doc_id, lang, tag FROM documents JOIN tags ON contains(text, tag)), c AS (SELECT tag, lang, count(*) AS n_cell FROM p GROUP BY ALL),
  x AS (SELECT *, CAST(sum(n_cell) OVER (PARTITION BY tag) AS BIGINT) AS n_item FROM c),
  l AS (SELECT tag, lang, n_item, n_cell, round((n_cell::DOUBLE / n_item) / ((SELECT count(*) FROM documents d WHERE d.lang = x.lang)::DOUBLE / (SELECT count(*) FROM documents)), 6) AS lift FROM x)
  SELECT *, CAST(row_number() OVER (PARTITION BY tag ORDER BY lift DESC, n_cell DESC, lang) AS INTEGER) AS place FROM l WHERE n_item >= 50 AND n_cell >= 5 AND lift > 1 QUALIFY place <= 10""")
def imagery_region_lift(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", "lang", F.explode(lexicon.contained("text", L.TAGS)).alias("tag"))
    return stylometry.lift_matrix(pairs, docs.select("doc_id", "lang"), "tag", "lang")


@query(f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(L.WORDS)}')) AS word, generate_subscripts(regexp_extract_all(text, '{_q(L.WORDS)}'), 1) AS pos FROM documents),
  f AS (SELECT doc_id, CASE word {" ".join(f"WHEN '{w}' THEN '{f}'" for w, f in L.FAMILIES.items())} END AS family, pos FROM e),
  c AS (SELECT doc_id, family, count(*) AS n, min(pos) AS first FROM f GROUP BY ALL)
  SELECT doc_id, family, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""")
def dominant_family(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(lexicon.leftmost_matches("text", L.WORDS)).alias("pos", "word"))
    families = F.create_map(*[F.lit(v) for pair in L.FAMILIES.items() for v in pair])
    return stylometry.dominant_label(found.withColumn("family", families[F.col("word")]), "doc_id", "family", "pos")


@query(f"""WITH {_TAGS}, {_LEX}, i AS (SELECT doc_id AS id, lang AS grp, tag AS item FROM documents JOIN tags ON contains(text, tag)), b AS (SELECT doc_id AS id, lang AS grp, word AS label FROM documents JOIN lex ON contains(text, word)),
  p AS (SELECT * FROM i JOIN b USING (id, grp)),
  g AS (SELECT lang AS grp, count(*) AS n_group FROM documents GROUP BY 1), nb AS (SELECT grp, label, count(*) AS n_base FROM b GROUP BY ALL), ni AS (SELECT grp, item, count(DISTINCT id) AS n_item FROM p GROUP BY ALL), nc AS (SELECT grp, item, label, count(*) AS n_cell FROM p GROUP BY ALL),
  x AS (SELECT *, n_cell::DOUBLE / n_item AS pi, n_base::DOUBLE / n_group AS pb FROM nc JOIN ni USING (grp, item) JOIN nb USING (grp, label) JOIN g USING (grp))
  SELECT grp, item, label, round(pi, 6) AS p_item, round(pb, 6) AS p_base, round(pi / pb, 6) AS lift FROM x""")
def cond_prob_lift(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), lexicon.contained("text", L.TAGS).alias("items"), lexicon.contained("text", L.WORDS).alias("labels"))
    return stylometry.conditional_lift(docs, "grp", "items", "labels")


@query(f"""WITH {_MASKED}, c AS (SELECT lang, sum(n_chars) AS chars FROM documents GROUP BY lang), r AS (SELECT word, lang, sum(hits)::DOUBLE * 10000 / any_value(chars)::DOUBLE AS rate FROM hits JOIN c USING (lang) WHERE hits > 0 GROUP BY ALL),
  w AS (SELECT word, coalesce(max(CASE WHEN lang = 'en' THEN rate END), 0) AS a, coalesce(max(CASE WHEN lang = 'de' THEN rate END), 0) AS b FROM r GROUP BY word)
  SELECT word, round(a, 4) AS left_rate, round(b, 4) AS right_rate, round(b - a, 4) AS delta FROM w ORDER BY abs(delta) DESC, word LIMIT 8""")
def rate_per_10k_contrast(spark, sf_dir):
    sizes = _t(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("chars"))
    return stylometry.rate_contrast(_masked(spark, sf_dir), sizes, "word", "lang", "en", "de", 8)


def _accepted_sql(name: str, source: str, field: str) -> str:
    """CTEs that end in ``name(doc_id, label, term, weight, start)``: hits of ``field`` in ``source``, longest terms first.

    Terms of a label that have one length can't overlap here, so it is enough that a hit overlaps none of a longer term.
    """
    parts, n = [], 0
    for label, terms in L.EMOTIONS.items():
        lengths = sorted({len(t) for t, _ in terms}, reverse=True)
        for term, weight in terms:
            parts.append(
                f"SELECT doc_id, x, '{label}' AS label, '{term}' AS term, {weight}::DOUBLE AS weight, {len(term)} AS n, {lengths.index(len(term)) + 1} AS tier, start FROM (SELECT doc_id, x, i, many, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {len(term)} AS start "
                f"FROM (SELECT doc_id, {field} AS x, unnest(string_split({field}, '{term}')) AS part, generate_subscripts(string_split({field}, '{term}'), 1) AS i, len(string_split({field}, '{term}')) AS many FROM {source})) WHERE i < many"
            )
            n = max(n, len(lengths))
    free = " AND ".join(
        [f"NOT (start >= {len(x)} AND substring(x, CAST(start - {len(x) - 1} AS BIGINT), {len(x)}) = '{x}')" for x in L.NEGATORS]
        + [f"NOT coalesce((SELECT f > 0 AND lo + f - 1 <= start AND start + n <= lo + f - 1 + {len(p)} FROM (SELECT greatest(start - {len(p)}, 0) AS lo, strpos(substring(x, CAST(greatest(start - {len(p)}, 0) + 1 AS BIGINT), CAST(start + n + {len(p)} - greatest(start - {len(p)}, 0) AS BIGINT)), '{p}') AS f)), false)" for p in L.EXCLUDED]
    )
    out = [f"{name}_o AS ({' UNION ALL '.join(parts)})", f"{name}_f AS (SELECT doc_id, label, term, weight, n, tier, start FROM {name}_o WHERE {free})", f"{name}_1 AS (SELECT * FROM {name}_f WHERE tier = 1)"]
    for k in range(2, n + 1):
        out.append(
            f"{name}_{k} AS (SELECT * FROM {name}_{k - 1} UNION ALL SELECT * FROM {name}_f f WHERE tier = {k} AND NOT EXISTS (SELECT 1 FROM {name}_{k - 1} a WHERE a.doc_id = f.doc_id AND a.label = f.label AND a.start < f.start + f.n AND f.start < a.start + a.n))"
        )
    return ", ".join([*out, f"{name} AS (SELECT doc_id, label, term, weight, start FROM {name}_{n})"])


@query(f"WITH {_accepted_sql('h', 'documents', 'text')} SELECT doc_id, label, term, weight, CAST(start AS INTEGER) AS start FROM h")
def emotion_hits(spark, sf_dir):
    return lexicon.interval_matches(_t(spark, sf_dir, "documents"), L.EMOTIONS, excluded=L.EXCLUDED, negators=L.NEGATORS)


_TITLE = r"regexp_extract(trim(text), '^[^.!?;\n]*', 0)"
_PROFILE = f"""s0 AS (SELECT doc_id, source, text, {_TITLE} AS title FROM documents), {_accepted_sql('b', 's0', 'text')}, {_accepted_sql('t', 's0', 'title')},
  parts AS (SELECT doc_id, label, weight AS w, 1 AS hits FROM b UNION ALL SELECT doc_id, label, weight * 0.55::DOUBLE, 0 FROM t
    {" ".join(f"UNION ALL SELECT doc_id, '{label}', {weight}::DOUBLE * ((length(text) - length(replace(text, '{w}', ''))) // {len(w)}), 0 FROM s0 WHERE contains(text, '{w}')" for w, (label, weight) in L.CLUSTERS.items())}),
  g AS (SELECT doc_id, label, round(sum(w), 9) AS score, sum(hits) AS rule_hits FROM parts GROUP BY ALL),
  dim(label, v, a, d) AS (VALUES {", ".join(f"('{n}', {v}::DOUBLE, {a}::DOUBLE, {d}::DOUBLE)" for n, v, a, d in L.DIMENSIONS)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place, sum(score) OVER (PARTITION BY doc_id) AS total FROM g JOIN dim USING (label) WHERE score > 0),
  x AS (SELECT doc_id, sum(pow(score, 1.12) * v) / sum(pow(score, 1.12)) AS valence, sum(pow(score, 1.12) * a) / sum(pow(score, 1.12)) AS arousal, sum(pow(score, 1.12) * d) / sum(pow(score, 1.12)) AS dominance,
    max(CASE WHEN place = 1 THEN label END) AS primary_label, string_agg(label, ',' ORDER BY place) FILTER (WHERE place <= 3) AS labels, max(score) AS top, max(total) AS total, CAST(sum(rule_hits) AS BIGINT) AS hits, coalesce(sum(CASE WHEN v > 0.2 THEN score / total END), 0) AS pos, coalesce(sum(CASE WHEN v < -0.2 THEN score / total END), 0) AS neg FROM r GROUP BY doc_id),
  y AS (SELECT s0.doc_id, source, primary_label, labels, valence, arousal, dominance, pos, neg, hits, (0.18 + 0.38 * (1 - exp(-total / 4.2)) + 0.24 * top / total + 0.16 * least(1.0, hits / 5.0))::DOUBLE AS c FROM s0 LEFT JOIN x ON x.doc_id = s0.doc_id),
  profile AS (SELECT doc_id, source, primary_label, coalesce(labels, '') AS labels, coalesce(round(valence, 3), 0.0) AS valence, coalesce(round(arousal, 3), 0.35) AS arousal, coalesce(round(dominance, 3), 0.0) AS dominance, coalesce(pos >= 0.22 AND neg >= 0.22, false) AS mixed,
    CASE WHEN c IS NULL THEN 0.12::DOUBLE ELSE round(least(0.96::DOUBLE, c), 3) END AS confidence, CASE WHEN c >= 0.72 THEN 'high' WHEN c >= 0.48 THEN 'medium' ELSE 'low' END AS confidence_label, coalesce(hits, 0) AS rule_hits FROM y)"""


def _profiles(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "text", T.first_sentence("text").alias("title"))
    scored = affect.document_scores(docs, L.EMOTIONS, L.CLUSTERS, "title", "text", "doc_id", L.EXCLUDED, L.NEGATORS, keep=["source"])
    return scored.select("doc_id", "source", affect.profile_of(F.col("scores"), L.DIMENSIONS).alias("p")).select("doc_id", "source", "p.*")


@query(f"""WITH {_PROFILE} SELECT doc_id, primary_label, labels, valence, arousal, dominance, mixed, confidence, confidence_label, rule_hits, CAST(round_even((valence + 1) * 50, 0) AS INTEGER) AS valence_percent FROM profile""")
def emotion_profile(spark, sf_dir):
    labels = F.array_join(F.transform("labels", lambda x: x["label"]), ",")
    out = _profiles(spark, sf_dir).withColumn("labels", labels).withColumn("valence_percent", affect.percent_of("valence"))
    return out.drop("source").withColumnRenamed("primary", "primary_label")


@query(f"""WITH {_PROFILE} SELECT 'label' AS kind, NULL::VARCHAR AS source, primary_label AS label, count(*) AS n FROM profile WHERE primary_label IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'owner', source, primary_label, count(*) FROM profile WHERE primary_label IS NOT NULL GROUP BY ALL UNION ALL SELECT 'confidence', NULL, confidence_label, count(*) FROM profile GROUP BY ALL""")
def emotion_distribution(spark, sf_dir):
    return affect.label_distribution(_profiles(spark, sf_dir), "source")


@query(f"""WITH {_MASKED}, f AS (SELECT doc_id, family AS label, CASE family WHEN 'a' THEN 1.8::DOUBLE WHEN 'b' THEN 1.0::DOUBLE ELSE 0.48::DOUBLE END * hits AS s, hits FROM hits WHERE hits > 0)
  SELECT doc_id, label, round(sum(s), 6) AS score, CAST(sum(hits) AS BIGINT) AS rule_hits FROM f GROUP BY ALL""")
def emotion_scores_of_hits(spark, sf_dir):
    weight = F.when(F.col("family") == "a", 1.8).when(F.col("family") == "b", 1.0).otherwise(0.48)
    hits = _masked(spark, sf_dir).select("doc_id", F.col("family").alias("label"), weight.alias("weight"), F.explode(F.sequence(F.lit(1), F.col("hits"))).alias("n"))
    return affect.emotion_scores(hits).withColumn("score", F.round("score", 6))


def _season_sql() -> str:
    picks = []
    for k, (name, terms) in enumerate(L.SEASONS.items()):
        fields = {}
        for field in ("title", "text"):
            now, score, last = field, [], []
            for w in lexicon.by_length(terms):
                score.append(f"(length({now}) - length(replace({now}, '{w}', ''))) // {len(w)} * {terms[w]}")
                last.append(f"CASE WHEN contains({now}, '{w}') THEN length({now}) - length(string_split({now}, '{w}')[-1]) - {len(w)} ELSE -1 END")
                now = f"replace({now}, '{w}', repeat('#', {len(w)}))"
            fields[field] = (" + ".join(score), f"greatest({', '.join(last)})")
        (ts, tl), (bs, bl) = fields["title"], fields["text"]
        picks.append(f"SELECT doc_id, '{name}' AS season, {k} AS nr, 3 * ({ts}) + {bs} AS score, greatest({tl}, CASE WHEN {bl} >= 0 THEN length(title) + 1 + {bl} ELSE -1 END) AS latest FROM d")
    return f"""WITH d AS (SELECT doc_id, text, {_TITLE} AS title FROM documents), s AS ({" UNION ALL ".join(picks)}),
      b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, score) AS ties FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, latest DESC, nr) = 1)
      SELECT doc_id, CASE WHEN score > 0 THEN season END AS season, CAST(score AS INTEGER) AS score, CAST(CASE WHEN score > 0 THEN ties ELSE 0 END AS INTEGER) AS tied FROM b"""


@query(_season_sql())
def season_detect(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", T.first_sentence("text").alias("title"))
    return affect.detect_season(docs, L.SEASONS, "title", "text")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
  c AS (SELECT doc_id, t, 0 AS a, 0 AS z, 0 AS k FROM t UNION ALL
    SELECT doc_id, t, z, CASE WHEN length(t) - z <= 2000 THEN length(t) ELSE z + CASE WHEN m > 0 THEN 1600 + m ELSE 2000 END END, k + 1 FROM (SELECT *, length(regexp_extract(substring(t, z + 1601, 400), '(?s)^.*[\n.]', 0)) AS m FROM c) WHERE z < length(t)),
  p AS (SELECT doc_id, k, regexp_replace(substring(t, a + 1, z - a), '^\s+|\s+$', '', 'g') AS chunk FROM c WHERE k > 0)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_no, CAST(length(chunk) AS INTEGER) AS n_chars FROM p WHERE chunk <> ''""")
def chunk_long_texts(spark, sf_dir):
    return segment.chunk_text(_t(spark, sf_dir, "documents"), limit=2000, marks="\n.").select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


# ---------------------------------------------------------------- numbers, contexts, companions

_NUMBERS = f"""e AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{_q(lexicon.by_length(L.NUMBERS))}')) AS word FROM documents),
  num(word, kind, size) AS (VALUES {", ".join(f"('{w}', '{k}', {v}::DOUBLE)" for w, (k, v) in L.NUMBERS.items())})"""


def _numbers(spark, sf_dir, ids: list[str]) -> DataFrame:
    table = F.create_map(*[v for w, (k, size) in L.NUMBERS.items() for v in (F.lit(w), F.struct(F.lit(k).alias("kind"), F.lit(size).alias("size")))])
    found = _t(spark, sf_dir, "documents").select(*ids, F.explode(lexicon.leftmost_matches("text", L.NUMBERS)).alias("word"))
    return found.select(*ids, "word", table[F.col("word")].alias("n")).select(*ids, "word", "n.kind", "n.size")


@query(f"""WITH {_NUMBERS} SELECT source, count(*) FILTER (WHERE kind NOT IN ('weak', 'ordinal')) AS counted, count(*) FILTER (WHERE kind = 'weak') AS weak, count(*) FILTER (WHERE kind = 'ordinal') AS ordinal,
  round(avg(size) FILTER (WHERE kind NOT IN ('weak', 'ordinal')), 6) AS mean_size, count(*) FILTER (WHERE kind NOT IN ('weak', 'ordinal') AND size >= 3) AS huge FROM e JOIN num USING (word) GROUP BY source""")
def number_kinds(spark, sf_dir):
    return stylometry.number_kinds(_numbers(spark, sf_dir, ["source"]), "source", "kind", "size")


@query(f"""WITH {_CLAUSES}, e AS (SELECT source, clause, unnest(regexp_extract_all(clause, '{_q(lexicon.by_length(L.NUMBERS))}')) AS word FROM c JOIN documents USING (doc_id)),
  num(word, kind, size) AS (VALUES {", ".join(f"('{w}', '{k}', {v}::DOUBLE)" for w, (k, v) in L.NUMBERS.items())}), b AS (SELECT source, clause AS line, max({{'size': size, 'word': word}}) AS b FROM e JOIN num USING (word) WHERE kind NOT IN ('weak', 'ordinal') GROUP BY ALL)
  SELECT source, line, b.size AS size, b.word AS word, CAST(row_number() OVER (PARTITION BY source ORDER BY b.size DESC, b.word, line) AS INTEGER) AS place FROM b QUALIFY place <= 5""")
def number_top_expressions(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("_id", F.struct("doc_id", "source"))
    lines = segment.split_clauses(docs, "_id").select(F.col("_id.source").alias("source"), F.col("clause").alias("line"))
    table = F.create_map(*[v for w, (k, size) in L.NUMBERS.items() for v in (F.lit(w), F.struct(F.lit(k).alias("kind"), F.lit(size).alias("size")))])
    hits = lines.select("source", "line", F.explode(lexicon.leftmost_matches("line", L.NUMBERS)).alias("word")).withColumn("n", table[F.col("word")])
    counted = hits.filter(~F.col("n.kind").isin("weak", "ordinal")).select("source", "line", "word", "n.size")
    return stylometry.top_expressions(counted, "source", "size", "word", "line").select("source", "line", "size", "word", "place")


@query(rf"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(L.WORDS)}')) AS word, generate_subscripts(regexp_extract_all(text, '{_q(L.WORDS)}'), 1) AS n, unnest(string_split_regex(text, '{_q(L.WORDS)}')[1:len(regexp_extract_all(text, '{_q(L.WORDS)}'))]) AS gap FROM documents),
  o AS (SELECT doc_id, n, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY n) - length(word) AS BIGINT) AS a FROM e),
  s AS (SELECT o.*, substring(text, greatest(a - 8, 0) + 1, a - greatest(a - 8, 0)) AS l, substring(text, a + length(word) + 1, 8) AS r FROM o JOIN documents USING (doc_id))
  SELECT doc_id, CAST(n AS INTEGER) AS match_no, word, CAST(a AS INTEGER) AS start_offset FROM s WHERE NOT (word = 'tion' AND (regexp_matches(l, '(?:[aou])$') OR regexp_matches(r, '^(?:s|\s)'))) AND NOT (word = 'then' AND regexp_matches(l, '(?:[Aa]nd )$'))""")
def lexicon_outside_context(spark, sf_dir):
    barred = {"tion": ("[aou]", r"s|\s"), "then": ("[Aa]nd ", None)}
    return lexicon.matches_outside(_t(spark, sf_dir, "documents"), L.WORDS, barred).drop("end_offset")


@query("WITH " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS companion FROM documents WHERE {' OR '.join(f"contains(text, '{a}')" for a in aliases)}" for n, aliases in L.COMPANIONS.items()).join(["f AS (", ")"]) + " SELECT companion, count(*) AS docs FROM f GROUP BY companion")
def companion_counts(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select(F.explode(lexicon.companions("text", L.COMPANIONS)).alias("companion"))
    return found.groupBy("companion").agg(F.count("*").alias("docs"))


@query(f"""WITH {_MASKED}, s AS (SELECT source, word AS shade, CAST(sum(hits) AS BIGINT) AS n FROM hits WHERE hits > 0 GROUP BY ALL) SELECT source, shade, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, shade) AS INTEGER) AS place FROM s QUALIFY place <= 8""")
def palette_top8(spark, sf_dir):
    return stylometry.palette(_masked(spark, sf_dir).withColumnRenamed("word", "shade"), "source", "shade", "hits")


_FAMS = sorted(set(L.FAMILIES.values()))
_BY_FAMILY = "w AS (SELECT source, count(DISTINCT doc_id) AS docs, CAST(sum(hits) AS BIGINT) AS hits, " + ", ".join(f"CAST(coalesce(sum(hits) FILTER (WHERE family = '{f}'), 0) AS BIGINT) AS {f}" for f in _FAMS) + " FROM hits WHERE hits > 0 GROUP BY source)"


@query(f"""WITH {_MASKED}, {_BY_FAMILY}, t AS (SELECT sum(hits)::DOUBLE AS n, sum(a + b)::DOUBLE AS warm, sum(c + d)::DOUBLE AS cold FROM w),
  r AS (SELECT source, 'warm' AS side, (a + b) / w.hits::DOUBLE AS share, t.warm / n AS corpus_share FROM w, t WHERE docs >= 10 AND hits >= 40 UNION ALL SELECT source, 'cold', (c + d) / w.hits::DOUBLE, t.cold / n FROM w, t WHERE docs >= 10 AND hits >= 40)
  SELECT source, side, round(share, 6) AS share, round(corpus_share, 6) AS corpus_share, round(share / corpus_share, 6) AS ratio FROM r ORDER BY ratio DESC, side, source LIMIT 1""")
def headline_deviation(spark, sf_dir):
    hits = _masked(spark, sf_dir)
    groups = hits.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.sum("hits").alias("hits"), *[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("hits"))), F.lit(0)).alias(f) for f in _FAMS])
    return stylometry.headline(groups, "source", "docs", "hits", {"warm": ["a", "b"], "cold": ["c", "d"]})
