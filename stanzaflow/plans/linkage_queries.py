"""Queries on record linkage, name resolution, profiles and nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T
from ..operators import lexicon, linkage, segment, stylometry

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH d AS (SELECT DISTINCT p_type AS k, p_type || '!' AS v FROM part WHERE p_size % 2 = 0), r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ' X' END AS name FROM part),
  j AS (SELECT p_partkey, name, k, v FROM r LEFT JOIN d ON starts_with(name, k) AND length(k) >= 2)
  SELECT p_partkey, name, v, CASE WHEN k IS NULL THEN 'none' WHEN k = name THEN 'exact' ELSE 'prefix' END AS method FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(k) DESC NULLS LAST) = 1""")
def place_longest_prefix(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    names = part.filter("p_size % 2 = 0").select(F.col("p_type").alias("k"), F.concat("p_type", F.lit("!")).alias("v")).distinct()
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" X"))).alias("name"))
    return linkage.resolve_longest_prefix(rows, "name", names, "k", "v")


@query("""WITH d AS (SELECT n_name AS k, n_regionkey AS v FROM nation), r AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || '(old)' WHEN 2 THEN n_name || ' CITY' ELSE '?' || n_name END AS name FROM nation)
  SELECT id, name, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.k IS NOT NULL THEN 'exact' WHEN b.k IS NOT NULL THEN 'paren' WHEN c.k IS NOT NULL THEN 'suffix' ELSE 'none' END AS step FROM r LEFT JOIN d a ON a.k = name LEFT JOIN d b ON b.k = regexp_replace(name, '\\(.*\\)$', '') LEFT JOIN d c ON c.k = regexp_replace(name, ' CITY$', '')""")
def place_step_resolution(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    m = F.col("n_nationkey") % 4
    name = F.when(m == 0, F.col("n_name")).when(m == 1, F.concat("n_name", F.lit("(old)"))).when(m == 2, F.concat("n_name", F.lit(" CITY"))).otherwise(F.concat(F.lit("?"), "n_name"))
    rows = n.select(F.col("n_nationkey").alias("id"), name.alias("name"))
    steps = [("exact", F.col("name")), ("paren", F.regexp_replace("name", r"\(.*\)$", "")), ("suffix", T.strip_suffix("name", [" CITY"]))]
    return linkage.resolve_in_steps(rows, steps, n.select(F.col("n_name").alias("k"), F.col("n_regionkey").alias("v")), "k", "v")


@query("""WITH l AS (SELECT c_custkey AS id, c_nationkey AS name, 1900 + c_custkey % 60 AS lo, 1940 + c_custkey % 60 AS hi FROM customer), o AS (SELECT s_suppkey AS oid, s_nationkey AS name, 1890 + s_suppkey % 70 AS lo2, 1925 + s_suppkey % 70 AS hi2, s_acctbal > 0 AS pri FROM supplier),
  p AS (SELECT id, oid, 10 * greatest(least(hi, hi2) - greatest(lo, lo2) + 1, 0) + 3 * CAST(pri AS INTEGER) AS sc FROM l JOIN o USING (name) WHERE greatest(least(hi, hi2) - greatest(lo, lo2) + 1, 0) > 0),
  t AS (SELECT id, sc, count(*) AS ties, min(oid) AS m FROM p GROUP BY ALL), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY sc DESC) = 1)
  SELECT l.id, CASE WHEN ties = 1 THEN m END AS match, sc AS score, CASE WHEN ties IS NULL THEN 'unmatched' WHEN ties > 1 THEN 'ambiguous' ELSE 'matched' END AS state FROM l LEFT JOIN b USING (id)""")
def identity_scoring(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    local = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("name"), (1900 + F.col("c_custkey") % 60).alias("lo"), (1940 + F.col("c_custkey") % 60).alias("hi"))
    other = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_nationkey").alias("name"), (1890 + F.col("s_suppkey") % 70).alias("lo2"), (1925 + F.col("s_suppkey") % 70).alias("hi2"), (F.col("s_acctbal") > 0).alias("pri"))
    years = linkage.overlap_years("lo", "hi", "lo2", "hi2")
    return linkage.link_scores(local, other, "name", 10 * years + 3 * F.col("pri").cast("int"), years > 0, "id", "oid", (("lo", "hi"), ("lo2", "hi2")))


@query("""WITH v AS (SELECT p_partkey AS id, unnest(list_distinct([lower(p_name), split_part(lower(p_name), ' ', 1)])) AS k FROM part WHERE p_partkey % 20 = 0), w AS (SELECT p_partkey AS w, lower(p_name) AS k FROM part),
  h AS (SELECT id, count(DISTINCT w) AS n, min(w) AS w FROM v JOIN w USING (k) WHERE k <> '' GROUP BY id) SELECT p_partkey AS id, coalesce(n, 0) AS n_works, CASE WHEN n = 1 THEN w END AS work, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS state FROM part LEFT JOIN h ON h.id = p_partkey WHERE p_partkey % 20 = 0""")
def title_variant_join(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    rows = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), "p_name")
    works = part.select(F.col("p_partkey").alias("w"), F.lower("p_name").alias("k"))
    forms = {"whole": F.lower("p_name"), "first": F.substring_index(F.lower("p_name"), " ", 1)}
    return linkage.variant_join(rows, "id", "p_name", forms, works, "w", "k")


@query("""WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN substring(text, CAST(length(text) // 2 + 1 AS BIGINT), 60) WHEN 2 THEN right(text, 12) ELSE reverse(right(text, 40)) END AS quote FROM documents)
  SELECT doc_id, quote, contains(text, quote) AND length(trim(quote)) > 0 AS literal FROM q""")
def quoted_evidence_check(spark, sf_dir):
    """Quotes from the middle and the end of each text, empty ones, and ones that were turned round."""
    docs, m = _t(spark, sf_dir, "documents"), F.col("doc_id") % 4
    quote = F.when(m == 0, "").when(m == 1, F.expr("substring(text, length(text) div 2 + 1, 60)")).when(m == 2, F.right("text", F.lit(12))).otherwise(F.reverse(F.right("text", F.lit(40))))
    return linkage.quoted_evidence(docs.select("doc_id", quote.alias("quote")), docs, "doc_id", "quote", "text")


@query("""SELECT event_id, user_id FROM events WHERE user_id % 4 <> 1 UNION ALL SELECT event_id, user_id FROM events WHERE user_id % 4 = 1 AND event_type = 'view'""")
def asset_scoped_replace(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("asset", F.col("user_id") % 4)
    done = spark.createDataFrame([(1,)], "asset bigint")
    fresh = e.filter("asset = 1 AND event_type = 'view'")
    return linkage.replace_assets(e, fresh, done, "asset", "event_id", "event_id").select("event_id", "user_id")


@query("""SELECT doc_id, min(file) AS file FROM (SELECT doc_id, 0 AS file FROM labels WHERE quality = 1 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 1) GROUP BY doc_id""")
def dedup_across_files(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    return linkage.first_across_files([labels.filter("doc_id % 2 = 0"), labels], ["doc_id"], "doc_id", F.col("quality") == 1).select("doc_id", F.col("_file").alias("file"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c)
  SELECT x.c_nationkey, x.n, mean_value, first_year, last_year, top_labels, modal_label FROM (SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean_value, min(c_custkey) AS first_year, max(c_custkey) AS last_year FROM customer GROUP BY 1) x
  JOIN (SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY k) AS top_labels, max(CASE WHEN k = 1 THEN c_mktsegment END) AS modal_label FROM r WHERE k <= 3 GROUP BY 1) y ON x.c_nationkey = y.c_nationkey""")
def place_profile(spark, sf_dir):
    return linkage.place_profile(_t(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey")


@query("""SELECT o_orderkey, CAST(count(l_linenumber) AS BIGINT) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def document_detail_nested(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = linkage.nested_documents(_t(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber", ["l_partkey"])
    text = F.array_join(F.transform("lines", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"])), ",")
    return out.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(text, F.lit("")).alias("lines"))


@query("""WITH y AS (SELECT l_orderkey, list(DISTINCT year(l_shipdate)) AS y, bool_or(l_returnflag = 'R') AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(list_min(y) AS INTEGER) AS low, CAST(list_max(y) AS INTEGER) AS high, CASE WHEN list_min(y) = list_max(y) THEN 'exact' ELSE 'range' END AS precision, CASE WHEN list_min(y) = list_max(y) AND c THEN 'B' ELSE 'C' END AS grade FROM y""")
def candidate_precision(spark, sf_dir):
    y = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.year("l_shipdate")).alias("y"), F.bool_or(F.col("l_returnflag") == "R").alias("c"))
    return linkage.candidate_rows(y, "l_orderkey", "y", F.col("c"))


@query("""SELECT p_partkey, year(DATE '1990-01-01' + CAST(p_size AS INTEGER) * 30) AS low, p_size % 2 = 0 AS approximate, p_size + 1 AS age FROM part""")
def year_parsing(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    year = F.year(F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_size") * 30))
    parsed = geo.year_range(F.concat(F.when(F.col("p_size") % 2 == 0, "about ").otherwise("in "), year.cast("string")))
    return part.select("p_partkey", parsed["low"].cast("bigint").alias("low"), parsed["approximate"].alias("approximate"), geo.nominal_age(F.col("p_size"), F.lit(0)).alias("age"))


@query("""SELECT p_partkey FROM part WHERE trim(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand ELSE 'other' END) IN ('', p_brand)""")
def foreign_author_filter(spark, sf_dir):
    author = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise("other")
    return linkage.foreign_author_filter(_t(spark, sf_dir, "part").withColumn("author", author), "author", "p_brand").select("p_partkey")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, 'schaft') THEN 'boat' WHEN regexp_matches(text, 'ción|eau') THEN 'horse' WHEN regexp_matches(text, 'ontion') THEN 'foot' ELSE 'unknown' END AS mode FROM documents""")
def transport_mode_rules(spark, sf_dir):
    rules = [("schaft", "boat"), ("ción|eau", "horse"), ("ontion", "foot")]
    return _t(spark, sf_dir, "documents").select("doc_id", T.first_matching("text", rules, "unknown").alias("mode"))


@query("""SELECT source, CASE WHEN count(*) < 10 THEN 'low' WHEN count(*) < 30 THEN 'medium' ELSE 'high' END AS level FROM documents GROUP BY source""")
def sample_levels(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", T.sample_level("n").alias("level"))


@query(r"""WITH c AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'))) AS clause FROM documents), s AS (SELECT DISTINCT doc_id, clause, 2 * (CAST(contains(clause, 'ontion') AS INTEGER) + CAST(contains(clause, 'eau') AS INTEGER)) + CAST(contains(clause, 'that') AS INTEGER) AS score FROM c WHERE length(clause) BETWEEN 4 AND 60)
  SELECT doc_id, clause, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(clause), clause) AS INTEGER) AS place FROM s WHERE score > 0 QUALIFY place <= 3""")
def display_lines(spark, sf_dir):
    clauses = segment.split_clauses(_t(spark, sf_dir, "documents")).filter(F.length("clause").between(4, 60)).select("doc_id", "clause").distinct()
    score = 2 * F.size(lexicon.contained("clause", ["ontion", "eau"])) + F.size(lexicon.contained("clause", ["that"]))
    return stylometry.first_k(clauses.withColumn("score", score).filter("score > 0"), "doc_id", [F.desc("score"), F.length("clause"), "clause"], 3)


@query("""WITH e AS (SELECT source, unnest(regexp_extract_all(text, '(?:ontion|schaft|ción|eau)')) AS w FROM documents), m AS (SELECT source, CASE w WHEN 'ontion' THEN 1.0::DOUBLE WHEN 'schaft' THEN 2.0::DOUBLE WHEN 'ción' THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS mag FROM e)
  SELECT source, count(*) AS n, round(avg(mag), 4) AS mean_magnitude, count(*) FILTER (WHERE mag >= 3) AS hyperbole FROM m GROUP BY source""")
def magnitude_mean(spark, sf_dir):
    size = F.create_map(*[F.lit(v) for pair in (("ontion", 1.0), ("schaft", 2.0), ("ción", 3.0), ("eau", 4.0)) for v in pair])
    hits = _t(spark, sf_dir, "documents").select("source", F.explode(lexicon.leftmost_matches("text", ["ontion", "schaft", "ción", "eau"])).alias("w"))
    return hits.withColumn("mag", size[F.col("w")]).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("mag"), 4).alias("mean_magnitude"), F.count_if(F.col("mag") >= 3).alias("hyperbole"))


@query("""WITH m AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS n, n_nationkey AS id FROM nation), s AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS n, 100 + r_regionkey AS id FROM region)
  SELECT id, CAST(n + least(n // 5, 5) AS BIGINT) AS slot FROM m UNION ALL SELECT id, CAST(CASE WHEN n < 5 THEN (n + 1) * 6 - 1 ELSE 25 + n END AS BIGINT) FROM s""")
def interleave_every_sixth(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    b = _t(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"))
    return linkage.interleave(a, b, "id")


@query("""WITH m AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE lang <> 'en'),
  k AS (SELECT (SELECT count(*) FROM m) AS a, (SELECT count(*) FROM s) AS b)
  SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(n + least(n // 5, b) AS BIGINT) AS slot FROM m, k UNION ALL SELECT doc_id, CAST(length(text) AS BIGINT), CAST(CASE WHEN n < a // 5 THEN (n + 1) * 6 - 1 ELSE a + n END AS BIGINT) FROM s, k""")
def interleaved_documents(spark, sf_dir):
    """One document of another language after every five English ones, whole texts and all."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    slots = linkage.interleave(docs.filter("lang = 'en'").drop("lang"), docs.filter("lang <> 'en'").drop("lang"), "doc_id")
    return slots.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "slot")
