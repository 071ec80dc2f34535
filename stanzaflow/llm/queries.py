"""The queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontam, html_extract, infill, langid, licenses, metric_join, minhash, mixing, sharding, token_count, token_output, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and rejection of every document; trained on a bounded sample of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, from the whole html."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the 32k pieces, and whether there are more than 4096."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document at 85 per cent of shared five-word shingles, and whether it stays."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector at a cosine of 0.98 within its label."""
    return metric_join.link_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document that the sources' target weights ask for, in a global random order."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by its most frequent n-grams, learned from those that aren't held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark item's windows, and which items those are."""
    return decontam.contamination_digest(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and checksums of every document as read back from the coded files."""
    return token_output.token_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal counts."""
    return sharding.assign_shards(table(spark, sf_dir, "documents")).drop("grp")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every document's fill-in-the-middle example."""
    return infill.with_digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.license_digest(licenses.scan(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html_text": op2_html_text,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_embedding_links": op5_embedding_links,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_sharding": op10_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_license_scan": op12_license_scan,
    "op13_collocations": op13_collocations,
}

def _license_sql() -> str:
    """Blocks and templates in SQL: template words found in the texts, counted by block and template; no filters, no order."""
    templates = [*licenses.PHRASES, *licenses.NOTICES]
    assert all(len(licenses.words_of(t.text)) <= licenses.STEP for t in templates)
    words = [(k, w.decode()) for k, t in enumerate(templates) if not t.phrase for w in sorted(set(licenses.words_of(t.text)))]
    told = [(k, t.label, len(set(licenses.words_of(t.text))), t.percent) for k, t in enumerate(templates) if not t.phrase]
    phrases = [(t.label, *[w.decode() for w in licenses.words_of(t.text)]) for t in templates if t.phrase]

    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)

    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d),
tw(t, word) AS (VALUES {values(words)}),
told(t, label, size, percent) AS (VALUES {values(told)}),
ph(label, x, y, z) AS (VALUES {values([(*p, None)[:4] for p in phrases])}),
b AS (SELECT doc_id, t, word, unnest([p // {licenses.STEP}, p // {licenses.STEP} - 1]) AS k FROM w JOIN tw USING (word)),
m AS (SELECT doc_id, t, k, count(DISTINCT word) AS common FROM b WHERE k >= 0 GROUP BY ALL),
found AS (SELECT doc_id, label, common::DOUBLE / size AS c FROM m JOIN told USING (t) WHERE 100 * common >= percent * size),
s AS (SELECT doc_id, p, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
base AS (SELECT doc_id, p, label FROM s JOIN ph ON word = x AND w2 = y AND (z IS NULL OR w3 = z)),
by_base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
by_all AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM (SELECT * FROM found UNION ALL SELECT doc_id, label, 1.0::DOUBLE FROM base) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN by_base USING (doc_id) LEFT JOIN by_all USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op6_mixing": """
WITH s AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS n_bytes FROM documents GROUP BY source),
t AS (SELECT sum(n_bytes)::DOUBLE AS all_bytes, sum(pow(n_bytes::DOUBLE, 0.5::DOUBLE)) AS all_weight FROM s),
r AS (SELECT source, CASE WHEN n_bytes > 0 AND all_weight > 0 THEN round(pow(n_bytes::DOUBLE, 0.5::DOUBLE) / all_weight * all_bytes / n_bytes, 9) ELSE 1.0::DOUBLE END AS rate FROM s, t),
p AS (SELECT source, rate, CAST(greatest(ceil(rate / 8), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / 8), 1) AS mean FROM r),
c AS (SELECT source, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p, (SELECT unnest(range(0, 65)) AS k)),
u AS (SELECT doc_id, source, j, CAST(('0x' || left(md5('mix-1:' || doc_id || ':' || j), 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents JOIN p USING (source), LATERAL (SELECT unnest(range(1, parts + 1)) AS j)),
n AS (SELECT doc_id, CAST(count(k) AS INTEGER) AS n_copies FROM u LEFT JOIN c ON u.source = c.source AND cdf <= u GROUP BY doc_id),
x AS (SELECT d.doc_id, d.source, d.text, rate, n_copies, CAST(unnest(range(0, n_copies)) AS INTEGER) AS copy FROM documents d JOIN p USING (source) JOIN n USING (doc_id))
SELECT *, CAST(('0x' || left(md5('mix-1:' || doc_id || ':copy:' || copy), 15)) AS BIGINT) AS shuffle_key FROM x""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, form, CAST(len(units) AS BIGINT) AS n, coalesce(array_to_string(units[1:lo], ''), '') AS a, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS b, coalesce(array_to_string(units[hi + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_license_scan": _license_sql(),
    "op13_collocations": """
WITH p AS (SELECT row_number() OVER () AS piece, lang, str_split(trim(replace(q, chr(9), ' '), ' '), ' ').list_filter(lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS q FROM documents)),
w AS (SELECT piece, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS k FROM p),
g AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY piece ORDER BY k)),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS a FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
around AS (SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
cuts AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, 1 AS k, f2.a, x.a AS l, y.a AS r FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 LEFT JOIN around o USING (lang, w1, w2) WHERE coalesce(100 * longer < 50 * f2.a, true)
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, 1, f3.a, x.a, y.a FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, 2, f3.a, x.a, y.a FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000""",
}
