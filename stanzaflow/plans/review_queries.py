"""Queries on promotion, authority matching, linking, releases and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, lexicon, merge, promotion, search, segment
from . import lexicons as L

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


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""WITH w AS (SELECT c_custkey AS id, c_nationkey AS k, 700 + c_custkey % 40 AS y FROM customer), e AS (SELECT s_nationkey AS k, 700 + s_suppkey * 3 % 40 AS ey, 'p' || s_suppkey AS p, (s_suppkey * 37 % 50) / 10.0 + 100 AS lon, (s_suppkey * 17 % 40) / 10.0 + 30 AS lat FROM supplier),
  n AS (SELECT DISTINCT w.k, y, ey, p, lon, lat FROM w JOIN e ON w.k = e.k AND abs(y - ey) <= 1), g AS (SELECT a.k, a.y, max({_KM}) AS d FROM n a JOIN n b ON a.k = b.k AND a.y = b.y GROUP BY ALL HAVING max({_KM}) <= 300),
  f AS (SELECT k, y, p, ey, count(*) OVER (PARTITION BY k, y) AS c FROM n QUALIFY row_number() OVER (PARTITION BY k, y ORDER BY abs(ey - y), ey, p) = 1) SELECT id, p AS place, CAST(ey AS BIGINT) AS event_year, c AS n_events FROM w JOIN f USING (k, y) JOIN g USING (k, y)""")
def journey_place_gate(spark, sf_dir):
    works = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), (700 + F.col("c_custkey") % 40).alias("y"))
    s = F.col("s_suppkey")
    events = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (700 + s * 3 % 40).alias("event_year"), F.concat(F.lit("p"), s).alias("place"), ((s * 37 % 50) / 10.0 + 100).alias("lon"), ((s * 17 % 40) / 10.0 + 30).alias("lat"))
    return promotion.journey_places(works, events, "k", "id", "y", "event_year", "place", "lon", "lat")


@query("""WITH a AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS name, CASE s_suppkey % 9 WHEN 1 THEN NULL WHEN 2 THEN 0 WHEN 3 THEN 999 ELSE s_suppkey % 80 END AS lon, CASE s_suppkey % 9 WHEN 2 THEN 0 ELSE s_suppkey % 40 END AS lat, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 700 + s_suppkey % 50 END AS lo, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 720 + s_suppkey % 50 END AS hi FROM supplier),
  c AS (SELECT c_custkey AS id, c_custkey % 20 + 1 AS k, 'n' || (c_nationkey // 6 * 6) AS name, 690 + c_custkey % 90 AS y1, 700 + c_custkey % 90 AS y2 FROM customer),
  j AS (SELECT c.id, CASE WHEN a.k IS NULL THEN 'missing' WHEN a.name <> c.name THEN 'name' WHEN lon IS NULL OR lat IS NULL THEN 'null' WHEN lon = 0 AND lat = 0 THEN 'sentinel' WHEN lon NOT BETWEEN -180 AND 180 OR lat NOT BETWEEN -90 AND 90 THEN 'range' WHEN NOT (y1 <= CASE WHEN hi = 0 THEN 1000000000 ELSE hi END AND y2 >= CASE WHEN lo = 0 THEN -1000000000 ELSE lo END) THEN 'years' END AS reason, lon FROM c LEFT JOIN a USING (k))
  SELECT id, reason, CASE WHEN reason IS NULL THEN lon::DOUBLE END AS lon FROM j""")
def coordinate_backfill(spark, sf_dir):
    s = F.col("s_suppkey")
    a = _t(spark, sf_dir, "supplier").select(
        s.alias("k"), F.concat(F.lit("n"), "s_nationkey").alias("own"), F.when(s % 9 == 1, None).when(s % 9 == 2, 0).when(s % 9 == 3, 999).otherwise(s % 80).alias("x"), F.when(s % 9 == 2, 0).otherwise(s % 40).alias("y"),
        F.when(s % 4 == 0, 0).otherwise(700 + s % 50).alias("lo"), F.when(s % 5 == 0, 0).otherwise(720 + s % 50).alias("hi"),
    )
    k = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer").select(k.alias("id"), (k % 20 + 1).alias("k"), F.concat(F.lit("n"), (F.floor(F.col("c_nationkey") / 6) * 6).cast("string")).alias("name"), (690 + k % 90).alias("y1"), (700 + k % 90).alias("y2"))
    return promotion.coordinate_reasons(c, a, "k", "name", "own", "x", "y", ("y1", "y2"), ("lo", "hi")).select("id", "reason", "lon")


@query("""WITH c AS (SELECT l_orderkey + l_linenumber % 3 AS ref, l_suppkey % 5 AS own FROM lineitem), p AS (SELECT o_orderkey AS k, o_custkey % 5 AS own FROM orders WHERE o_orderkey % 7 <> 0)
  SELECT (SELECT count(*) FROM c WHERE ref NOT IN (SELECT k FROM p)) AS orphans, (SELECT count(*) FROM c JOIN p ON ref = k WHERE c.own <> p.own) AS other_owner, (SELECT count(*) FROM (SELECT ref FROM c GROUP BY ref HAVING count(*) > 1)) AS repeated""")
def reference_checks(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("ref"), (F.col("l_suppkey") % 5).alias("own"))
    p = _t(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("owner"))
    return promotion.reference_errors(c, p, "ref", "k", "own", "owner")


_ERAS = {"tang": ["early tang", "high tang"], "song": ["north song"]}


@query("""WITH l AS (SELECT c_custkey AS id, 'nm' || (c_custkey % 90) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'tang' ELSE 'song' END AS era, 700 + c_custkey % 40 - 3 AS bl, 700 + c_custkey % 40 + 3 AS bh, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 750 + c_custkey % 40 - 3 END AS dl, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 750 + c_custkey % 40 + 3 END AS dh FROM customer),
  r AS (SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 6 = 0 THEN 'old nm' || (s_suppkey % 90) ELSE 'nm' || (s_suppkey * 7 % 90) END AS r_name, 'nm' || (s_suppkey * 11 % 90) AS alias, CASE s_suppkey % 4 WHEN 0 THEN 'tang' WHEN 1 THEN 'north song' WHEN 2 THEN 'unknown' ELSE 'ming' END AS tok, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 695 + s_suppkey % 50 END AS wl, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 705 + s_suppkey % 50 END AS wh, 745 + s_suppkey % 50 AS vl, 757 + s_suppkey % 50 AS vh FROM supplier),
  m AS (SELECT id, rid, CASE WHEN name = r_name THEN 100 WHEN name = alias THEN 75 ELSE 20 END AS ns, CASE WHEN tok = 'unknown' THEN 0 WHEN tok = era THEN 50 WHEN (era = 'song' AND tok = 'north song') THEN 40 ELSE -60 END AS es, CASE WHEN wl IS NOT NULL THEN greatest(least(wh, bh) - greatest(wl, bl) + 1, 0) END AS b, CASE WHEN dl IS NOT NULL THEN greatest(least(vh, dh) - greatest(vl, dl) + 1, 0) END AS d FROM l JOIN r ON name = r_name OR name = alias OR contains(r_name, name)),
  s AS (SELECT id, rid, ns, CASE WHEN b IS NULL AND d IS NULL THEN 0 WHEN coalesce(b, 1) = 0 OR coalesce(d, 1) = 0 THEN -90 ELSE 40 + least(coalesce(b, 0) + coalesce(d, 0), 20) END AS ds, es FROM m), t AS (SELECT id, rid, ns + es + ds AS total, ns >= 75 AND ds >= 0 AS ok FROM s),
  k0 AS (SELECT id, total, count(*) AS ties, min(rid) AS r FROM t WHERE ok GROUP BY ALL), k AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY total DESC) = 1)
  SELECT id, CASE WHEN ties = 1 THEN r END AS record, CAST(total AS INTEGER) AS total, CASE WHEN id NOT IN (SELECT id FROM t) THEN 'not_found' WHEN ties = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM l LEFT JOIN k USING (id)""")
def authority_matching(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("nm"), x.cast("string"))
    local = _t(spark, sf_dir, "customer").select(
        k.alias("id"), name(k % 90).alias("name"), F.when(k % 2 == 0, "tang").otherwise("song").alias("era"), (700 + k % 40 - 3).alias("birth_low"), (700 + k % 40 + 3).alias("birth_high"),
        F.when(k % 3 != 0, 750 + k % 40 - 3).alias("death_low"), F.when(k % 3 != 0, 750 + k % 40 + 3).alias("death_high"),
    )
    token = F.when(s % 4 == 0, "tang").when(s % 4 == 1, "north song").when(s % 4 == 2, "unknown").otherwise("ming")
    records = _t(spark, sf_dir, "supplier").select(
        s.alias("rid"), F.when(s % 6 == 0, F.concat(F.lit("old "), name(s % 90))).otherwise(name(s * 7 % 90)).alias("r_name"), F.array(name(s * 11 % 90)).alias("aliases"), F.array(token).alias("eras"),
        F.when(s % 5 != 0, 695 + s % 50).alias("born_low"), F.when(s % 5 != 0, 705 + s % 50).alias("born_high"), (745 + s % 50).alias("died_low"), (757 + s % 50).alias("died_high"),
    )
    return promotion.authority_matches(local, records, "id", "rid", _ERAS)


@query("""WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 3 AS own, 't' || (l_partkey % 4000) AS title, l_partkey AS sid, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE 'x' END AS author, l_returnflag AS grade FROM lineitem), p AS (SELECT p_partkey % 3 AS own, 't' || (p_partkey * 3 % 4000) AS title, p_partkey AS pid FROM part),
  s AS (SELECT own, title, count(DISTINCT sid) AS n FROM w GROUP BY ALL), q AS (SELECT own, title, count(*) AS m, min(pid) AS pid FROM p GROUP BY ALL)
  SELECT id, CASE WHEN trim(author) <> '' THEN grade ELSE 'C' END AS grade, CASE WHEN n = 1 AND coalesce(m, 0) = 1 AND trim(author) <> '' THEN pid END AS poem, n = 1 AND coalesce(m, 0) = 1 AND trim(author) <> '' AS linked FROM w JOIN s USING (own, title) LEFT JOIN q USING (own, title)""")
def work_linking(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    w = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 3).alias("own"), F.concat(F.lit("t"), (F.col("l_partkey") % 4000).cast("string")).alias("title"), F.col("l_partkey").alias("sid"), F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise("x").alias("author"), F.col("l_returnflag").alias("grade"))
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("own"), F.concat(F.lit("t"), (F.col("p_partkey") * 3 % 4000).cast("string")).alias("title"), F.col("p_partkey").alias("pid"))
    return promotion.link_works(w, p, "own", "title", "sid", "author", "grade", "pid").select("id", "grade", "poem", "linked")


@query("""WITH i AS (SELECT p_brand AS k, p_partkey % 9 AS identity FROM part WHERE p_partkey % 9 < 1 + p_size % 3), n AS (SELECT k, count(DISTINCT identity) AS n, min(identity) AS i FROM i GROUP BY k)
  SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 99 WHEN n = 1 THEN i END AS identity, coalesce(n, 0) AS n_identities FROM part LEFT JOIN n ON k = p_brand""")
def identity_resolution(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    ids = part.filter("p_partkey % 9 < 1 + p_size % 3").select(F.col("p_brand").alias("k"), (F.col("p_partkey") % 9).alias("identity"))
    settled = spark.createDataFrame([("Brand#11", 99)], "k string, identity bigint")
    return promotion.resolve_identities(part.select("p_partkey", F.col("p_brand").alias("k")), ids, ["k"], "identity", settled).drop("k")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents), x AS (SELECT doc_id, 'i' || doc_id AS i1, CASE WHEN doc_id % 7 = 0 THEN 'i' || doc_id ELSE '' END AS i2, lang AS o1, CASE WHEN doc_id % 5 = 0 THEN 'zz' ELSE lang END AS o2, text AS t1, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substring(text, 5) ELSE 'q' END AS t2, lower(text) AS f1, CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE 'other' END AS f2 FROM d),
  y AS (SELECT doc_id, trim(i1) AS i1, trim(i2) AS i2, trim(o1) AS o1, trim(o2) AS o2, trim(t1) AS t1, trim(t2) AS t2, trim(f1) AS f1, trim(f2) AS f2 FROM x)
  SELECT doc_id, CASE WHEN i2 <> '' AND i1 = i2 AND o1 <> '' AND o1 = o2 THEN 1.0::DOUBLE WHEN o1 = o2 AND t1 <> '' AND t1 = t2 THEN 0.95 WHEN o1 = o2 AND t1 <> '' AND t2 <> '' AND (contains(t1, t2) OR contains(t2, t1)) AND f1 <> '' AND f1 = f2 THEN 0.9 ELSE 0.0 END AS score FROM y""")
def source_match_scores(spark, sf_dir):
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    x = _t(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("i"), d).alias("i1"), F.when(d % 7 == 0, F.concat(F.lit("i"), d)).otherwise("").alias("i2"), F.col("lang").alias("o1"), F.when(d % 5 == 0, "zz").otherwise(F.col("lang")).alias("o2"),
        text.alias("t1"), F.when(d % 3 == 0, text).when(d % 3 == 1, F.expr("substring(coalesce(text, ''), 5)")).otherwise("q").alias("t2"), F.lower(text).alias("f1"), F.when(d % 2 == 0, F.lower(text)).otherwise("other").alias("f2"),
    )
    return x.select("doc_id", promotion.source_match_score(("i1", "i2"), ("o1", "o2"), ("t1", "t2"), ("f1", "f2")).alias("score"))


@query("""WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'open' ELSE 'verified' END AS st, 't' || (c_custkey % 50) AS title, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'because' END AS why FROM customer WHERE c_custkey % 6 <> 5), p AS (SELECT o_orderkey // 3 AS k, 't' || (o_orderkey // 3 % 49) AS title FROM orders),
  m AS (SELECT k, count(*) AS n, min(title) AS pt FROM p GROUP BY k), j AS (SELECT coalesce(s.k, m.k) AS k, s.k IS NOT NULL AS has, st, title, why, coalesce(n, 0) AS n, pt FROM s FULL JOIN m ON s.k = m.k),
  e AS (SELECT k, concat_ws(',', CASE WHEN NOT has THEN 'unassigned' END, CASE WHEN has AND st NOT IN ('verified', 'hold') THEN 'state' END, CASE WHEN has AND trim(why) = '' THEN 'reason' END, CASE WHEN has AND st = 'verified' AND n <> 1 THEN 'not_one_package' END, CASE WHEN has AND st = 'verified' AND n = 1 AND title <> pt THEN 'other_identity' END, CASE WHEN has AND st = 'hold' AND n > 0 THEN 'package_on_hold' END) AS errors FROM j)
  SELECT k, errors FROM e WHERE errors <> ''""")
def status_reconciliation(spark, sf_dir):
    k = F.col("c_custkey")
    s = _t(spark, sf_dir, "customer").filter("c_custkey % 6 <> 5").select(k.alias("k"), F.when(k % 4 == 0, "hold").when(k % 4 == 1, "open").otherwise("verified").alias("st"), F.concat(F.lit("t"), (k % 50).cast("string")).alias("title"), F.when(k % 11 == 0, " ").otherwise("because").alias("why"))
    p = _t(spark, sf_dir, "orders").select(F.expr("o_orderkey div 3").alias("k")).select("k", F.concat(F.lit("t"), (F.col("k") % 49).cast("string")).alias("title"))
    return promotion.status_errors(s, p, "k", "st", ["title"], "why").withColumn("errors", F.array_join("errors", ","))


@query("""SELECT 'verdict' AS kind, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'family', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'owner', o_custkey::VARCHAR, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'missing', c_custkey::VARCHAR, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def release_counts(spark, sf_dir):
    roster = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return promotion.release_summary(_t(spark, sf_dir, "orders"), roster, "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT l_partkey AS k, arg_min(l_orderkey, (CASE l_returnflag WHEN 'A' THEN -0.9 WHEN 'R' THEN -0.75 ELSE 0.0 END, l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_returnflag, (CASE l_returnflag WHEN 'A' THEN -0.9 WHEN 'R' THEN -0.75 ELSE 0.0 END, l_orderkey, l_linenumber)) AS l_returnflag FROM lineitem GROUP BY 1""")
def strongest_sources(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", "l_returnflag")
    return promotion.strongest_source(s, "k", "l_returnflag", ["l_orderkey", "l_linenumber"], {"A": 0.9, "R": 0.75}).drop("l_linenumber")


@query("""WITH s AS (SELECT o_custkey AS k, 'v' || (o_orderkey % 3) AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), st AS (SELECT c_custkey AS k, 'v' || (c_custkey % 5) AS body FROM customer),
  f AS (SELECT k, body FROM s WHERE n = 1), m AS (SELECT f.k, f.body FROM f JOIN st ON st.k = f.k AND st.body = f.body), t AS (SELECT k, body, list_sort(list(n))[2] AS second FROM s GROUP BY ALL), r AS (SELECT k, arg_min(body, second) AS body FROM t WHERE second IS NOT NULL GROUP BY k),
  z AS (SELECT k, count(*) AS c FROM s GROUP BY k), v AS (SELECT k, body FROM s JOIN z USING (k) GROUP BY k, body, c HAVING count(*) >= c // 2 + 1)
  SELECT f.k, coalesce(m.body, r.body, v.body) AS body, CASE WHEN m.k IS NOT NULL THEN 'matched_stored_version' WHEN r.k IS NOT NULL THEN 'repeated_fresh_version' WHEN v.k IS NOT NULL THEN 'per_character_consensus' ELSE 'unresolved' END AS mode FROM f LEFT JOIN m ON m.k = f.k LEFT JOIN r ON r.k = f.k LEFT JOIN v ON v.k = f.k""")
def version_settlement(spark, sf_dir):
    from pyspark.sql import Window as W

    o = _t(spark, sf_dir, "orders")
    s = o.select(F.col("o_custkey").alias("k"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("body"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    st = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("v"), (F.col("c_custkey") % 5).cast("string")).alias("body"))
    return promotion.settled_versions(st, s, "k", "body", "n")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS orders_n, count(*) FILTER (WHERE o_orderstatus = 'P') AS orders_open, count(DISTINCT o_orderpriority) AS orders_kinds FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS people_n FROM customer GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS events_n, count(*) FILTER (WHERE event_type = 'view') AS events_views FROM events GROUP BY 1)
  SELECT coalesce(o.k, c.k, e.k) AS k, coalesce(orders_n, 0) AS orders_n, coalesce(orders_open, 0) AS orders_open, coalesce(orders_kinds, 0) AS orders_kinds, coalesce(people_n, 0) AS people_n, coalesce(events_n, 0) AS events_n, coalesce(events_views, 0) AS events_views FROM o FULL JOIN c ON c.k = o.k FULL JOIN e ON e.k = coalesce(o.k, c.k)""")
def history_summary(spark, sf_dir):
    n = F.count("*")
    parts = {
        "orders": (_t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), {"n": n, "open": F.count_if(F.col("o_orderstatus") == "P"), "kinds": F.countDistinct("o_orderpriority")}),
        "people": (_t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), {"n": n}),
        "events": (_t(spark, sf_dir, "events").withColumnRenamed("user_id", "k"), {"n": n, "views": F.count_if(F.col("event_type") == "view")}),
    }
    return promotion.owner_summary(parts, "k")


@query("""SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def history_distributions(spark, sf_dir):
    return promotion.distributions(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS w FROM lineitem), x AS (SELECT a.k, a.w, b.w AS other, row_number() OVER (PARTITION BY a.k, a.w ORDER BY b.w) AS n FROM m a JOIN m b ON a.k = b.k AND a.w <> b.w QUALIFY n <= 30)
  SELECT k, w, other, CAST(row_number() OVER (PARTITION BY k, w ORDER BY other % 7, other) AS INTEGER) AS place FROM x QUALIFY place <= 3""")
def same_place_picks(spark, sf_dir):
    m = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("w")).distinct().withColumn("seven", F.col("w") % 7)
    return promotion.same_place_works(m, "k", "w", "w", ["seven"])


@query("""WITH v AS (SELECT c_nationkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'id' || (c_custkey % 40) END AS sid, md5(c_mktsegment) AS h, c_custkey FROM customer), i AS (SELECT *, coalesce('id:' || sid, 'body:' || h) AS ident FROM v)
  SELECT c_custkey, count(*) OVER (PARTITION BY k, ident) - 1 AS collapsed FROM i QUALIFY row_number() OVER (PARTITION BY k, ident ORDER BY c_custkey DESC) = 1""")
def version_collapse(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    v = c.select(F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("id"), (F.col("c_custkey") % 40).cast("string"))).alias("sid"), F.md5("c_mktsegment").alias("h"), "c_custkey")
    return merge.collapse_versions(v, ["k"], "sid", "h", [F.desc("c_custkey")]).select("c_custkey", "collapsed")


@query("""WITH d AS (SELECT DISTINCT user_id AS s, event_id % 9 + 1 AS p FROM events WHERE event_type <> 'error'), r AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS n FROM d), x AS (SELECT s, max(p) AS top FROM r WHERE p = n GROUP BY s), w AS (SELECT DISTINCT user_id AS s, p FROM events, (SELECT unnest(range(1, 10)) AS p))
  SELECT w.s, w.p FROM w LEFT JOIN x ON x.s = w.s WHERE w.p > coalesce(top, 0)""")
def resume_rule(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    done = e.select(F.col("user_id").alias("s"), (F.col("event_id") % 9 + 1).alias("p"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    wanted = e.select(F.col("user_id").alias("s")).distinct().withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(9)).cast("array<bigint>")))
    return promotion.resume_pages(wanted, done, ["s"], "p", "status")


@query(r"""WITH c0 AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'))) AS clause FROM documents WHERE contains(text, 'ontion')), c AS (SELECT doc_id, clause FROM c0 WHERE contains(clause, 'ontion')),
  k(label, word) AS (VALUES ('calm', 'of'), ('calm', 'with the'), ('calm', 'with'), ('fear', 'no'), ('fear', 'not')),
  o AS (SELECT doc_id, clause, label, word, i - 1 AS pos FROM c, k, LATERAL (SELECT unnest(range(1, length(clause) - length(word) + 2)) AS i) WHERE contains(clause, word) AND substring(clause, i, length(word)) = word),
  f AS (SELECT DISTINCT doc_id, clause, label, word FROM o WHERE NOT (length(word) <= 2 AND pos >= 2 AND substring(clause, CAST(pos - 1 AS BIGINT), 2) = 'e ')
    AND NOT (strpos(substring(clause, 1, CAST(pos + length(word) AS BIGINT)), 'out of') > 0 AND pos + length(word) - (strpos(reverse(substring(clause, 1, CAST(pos + length(word) AS BIGINT))), 'fo tuo') - 1) - 6 <= pos AND pos + length(word) <= pos + length(word) - (strpos(reverse(substring(clause, 1, CAST(pos + length(word) AS BIGINT))), 'fo tuo') - 1))),
  g AS (SELECT DISTINCT doc_id, label, word FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.clause = f.clause AND o.label = f.label AND o.word <> f.word AND contains(o.word, f.word)))
  SELECT doc_id, label, string_agg(word, ',' ORDER BY length(word) DESC, word) AS words FROM g GROUP BY ALL""")
def local_labels(spark, sf_dir):
    rules = {"calm": ["of", "with the", "with"], "fear": ["no", "not"]}
    clauses = segment.split_clauses(_t(spark, sf_dir, "documents")).filter(F.contains("clause", F.lit("ontion")))
    labelled = clauses.select("doc_id", lexicon.context_labels("clause", rules, excluded=["out of"], negators=["e "]).alias("labels"))
    return lexicon.merged_labels(labelled, "doc_id", "labels").withColumn("words", F.array_join("words", ","))


# ---------------------------------------------------------------- search in full, catalogs, comparisons

_FIND = r"""d AS (SELECT doc_id, source AS title, lang AS poet, text FROM documents), l0 AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'))) AS line, generate_subscripts(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'), 1) AS pos FROM documents),
  l AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS line_no, line FROM l0 WHERE line <> '')"""


def _searched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("poet"), "text")
    return docs, segment.split_clauses(docs).select("doc_id", F.col("clause_no").alias("line_no"), F.col("clause").alias("text"))


@query(rf"""WITH {_FIND}, h AS (SELECT 'doc' AS kind, doc_id, NULL::INTEGER AS line_no FROM d WHERE contains(lower(text), 'ontion an') OR contains(lower(title), 'ontion an') OR contains(lower(poet), 'ontion an') UNION ALL
  SELECT 'line', l.doc_id, line_no FROM l JOIN d USING (doc_id) WHERE contains(lower(line), 'ontion an') OR contains(lower(title), 'ontion an') OR contains(lower(poet), 'ontion an')) SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(line_no) AS BIGINT) AS line_nos FROM h GROUP BY kind""")
def search_find_phrase(spark, sf_dir):
    docs, lines = _searched(spark, sf_dir)
    doc = search._hits(docs, "ontion an", ["title", "poet", "text"], "doc_id").select(F.lit("doc").alias("kind"), "doc_id", F.lit(None).cast("int").alias("line_no"))
    both = lines.withColumnRenamed("text", "line").join(docs.select("doc_id", "title", "poet"), "doc_id").withColumn("_id", F.struct("doc_id", "line_no"))
    line = search._hits(both, "ontion an", ["line", "title", "poet"], "_id").select(F.lit("line").alias("kind"), "_id.doc_id", F.col("_id.line_no").cast("int").alias("line_no"))
    return doc.unionByName(line).groupBy("kind").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum("line_no").alias("line_nos"))


@query(rf"""WITH {_FIND}, f AS (SELECT DISTINCT doc_id FROM d WHERE title = 'src3'), h AS (SELECT 'doc' AS kind, doc_id, NULL::INTEGER AS line_no, text AS x FROM d WHERE title = 'src3' AND (contains(lower(text), 'e.') OR contains(lower(poet), 'e.')) UNION ALL SELECT 'line', doc_id, line_no, line FROM l JOIN f USING (doc_id) WHERE contains(lower(line), 'e.'))
  SELECT kind, doc_id, line_no FROM h ORDER BY kind, doc_id, coalesce(line_no, 0) LIMIT 20 OFFSET 5""")
def search_find_like(spark, sf_dir):
    docs, lines = _searched(spark, sf_dir)
    return search.find(docs, lines, "e.", "all", {"title": "src3"}, limit=20, offset=5)[0].select("kind", "doc_id", "line_no")


@query(rf"""WITH {_FIND}, t AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+')) AS w FROM l) SELECT CAST(count(*) AS BIGINT) AS total FROM (SELECT DISTINCT doc_id, line_no FROM t WHERE contains(w, 'qu'))""")
def search_find_short_total(spark, sf_dir):
    docs, lines = _searched(spark, sf_dir)
    return search.find(docs, lines, "qu", "line")[1]


@query("""WITH h AS (SELECT doc_id, toxic::VARCHAR AS a, quality::VARCHAR AS b FROM labels), m AS (SELECT doc_id, 't' || a AS label FROM h UNION SELECT doc_id, 'q' || b FROM h)
  SELECT doc_id, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM m WHERE m.doc_id = d.doc_id), '') AS labels FROM documents d""")
def search_enrichment(spark, sf_dir):
    hits = _t(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("line_no"))
    h = _t(spark, sf_dir, "labels")
    m = h.select("doc_id", F.concat(F.lit("t"), "toxic").alias("label")).unionByName(h.select("doc_id", F.concat(F.lit("q"), "quality").alias("label"))).withColumn("line_no", F.lit(1))
    return search.with_mentions(hits, m).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'tang' ELSE 'song' END AS era, 'a' || (c_custkey % 70) AS al1, 'b' || c_custkey AS al2 FROM customer), n AS (SELECT DISTINCT id, era, unnest([al1, al2]) AS alias FROM r), o AS (SELECT alias, count(DISTINCT id) AS owners FROM n GROUP BY alias),
  c AS (SELECT s_suppkey AS rid, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'tang' ELSE 'song' END AS e, 'b' || (s_suppkey * 3) AS head, 'a' || (s_suppkey % 90) AS resp, 'b' || (s_suppkey * 5) AS pers, CASE WHEN s_suppkey % 4 = 0 THEN 'song' ELSE '' END AS pe, 'x b' || (s_suppkey * 7) AS title FROM supplier),
  t AS (SELECT rid, e, head AS alias, '' AS pe, 'header' AS m FROM c UNION ALL SELECT rid, e, resp, '', 'responsible' FROM c UNION ALL SELECT rid, e, pers, pe, 'person' FROM c), z AS (SELECT * FROM t UNION ALL SELECT DISTINCT rid, e, n.alias, '', 'title' FROM c JOIN n ON contains(title, n.alias) WHERE e <> ''),
  g AS (SELECT id, rid, string_agg(DISTINCT m, ',' ORDER BY m) AS methods, bool_or(m <> 'title') AS strong, max(CASE WHEN m <> 'title' THEN owners END) AS sh FROM z JOIN n USING (alias) JOIN o USING (alias) WHERE (e = '' OR e = era) AND (pe = '' OR pe = era) GROUP BY ALL)
  SELECT id, rid, CASE WHEN strong AND sh = 1 THEN 'matched' ELSE 'ambiguous' END AS status, methods FROM g""")
def catalog_matching(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    roster = _t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, "tang").otherwise("song").alias("era"), F.array(name("a", k % 70), name("b", k)).alias("aliases"))
    eras = F.when(s % 3 == 0, F.array().cast("array<string>")).when(s % 3 == 1, F.array(F.lit("tang"))).otherwise(F.array(F.lit("song")))
    person = F.struct(name("b", s * 5).alias("name"), F.when(s % 4 == 0, "song").otherwise("").alias("era"))
    records = _t(spark, sf_dir, "supplier").select(s.alias("rid"), eras.alias("eras"), F.array(name("b", s * 3)).alias("header"), F.array(name("a", s % 90)).alias("responsible"), F.array(person).alias("people"), name("x b", s * 7).alias("title"))
    return promotion.catalog_matches(roster, records, "id", "rid", ",")


@query("""WITH n AS (SELECT lang, sum(n_chars)::DOUBLE AS chars FROM documents GROUP BY lang), w(word) AS (VALUES ('that'), ('with'), ('from'), ('this'), ('nicht'), ('durch')), h AS (SELECT word, lang, sum((length(text) - length(replace(text, word, ''))) // length(word)) AS hits FROM documents, w WHERE lang IN ('en', 'de') GROUP BY ALL),
  r AS (SELECT word, max(CASE WHEN lang = 'en' THEN round(hits * 10000.0::DOUBLE / chars, 6) END) AS en, max(CASE WHEN lang = 'de' THEN round(hits * 10000.0::DOUBLE / chars, 6) END) AS de FROM h JOIN n USING (lang) GROUP BY word)
  SELECT word, en, de, round(de - en, 6) AS delta, CASE WHEN de > en THEN 'de' WHEN de < en THEN 'en' ELSE 'equal' END AS higher_in, CAST(list_position(['this', 'nicht', 'that'], word) AS INTEGER) AS place FROM r WHERE word IN ('this', 'nicht', 'that')""")
def imagery_compare(spark, sf_dir):
    words = ["that", "with", "from", "this", "nicht", "durch"]
    docs = _t(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de"))
    hits = [((F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words]
    sums = docs.groupBy("lang").agg(F.sum("n_chars").alias("chars"), *[F.sum(h).alias(w) for w, h in zip(words, hits)])
    rates = sums.select("lang", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.round(F.col(w) * 10000.0 / F.col("chars"), 6).alias("rate")) for w in words])).alias("r"))
    wide = rates.groupBy("r.word").agg(*[F.max(F.when(F.col("lang") == x, F.col("r.rate"))).alias(x) for x in ("en", "de")])
    return promotion.compare_terms(wide, "word", "en", "de", ["this", "nicht", "that"])


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_routes, count(DISTINCT o_orderkey) > 0 AS available FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def owner_route_catalog(spark, sf_dir):
    routes = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return promotion.owner_catalog(_t(spark, sf_dir, "customer").select("c_custkey"), routes, "c_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) = count(*) OVER (PARTITION BY l_orderkey) AS is_last FROM lineitem""")
def scene_playback(spark, sf_dir):
    return promotion.playback_index(_t(spark, sf_dir, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber"], "l_linenumber")


@query(rf"""WITH {_FIND}, t(tag) AS (VALUES ('that'), ('with'), ('nicht')), m AS (SELECT tag, poet AS lang, l.doc_id, line, line_no FROM l JOIN d USING (doc_id) JOIN t ON contains(line, tag) WHERE length(line) BETWEEN 4 AND 30), f AS (SELECT tag, lang, doc_id, arg_min(line, line_no) AS line FROM m GROUP BY ALL)
  SELECT tag, lang, doc_id, line, CAST(row_number() OVER (PARTITION BY tag, lang ORDER BY doc_id) AS INTEGER) AS place FROM f QUALIFY place <= 3""")
def lift_sample_lines(spark, sf_dir):
    docs, lines = _searched(spark, sf_dir)
    met = lines.select("doc_id", "line_no", F.col("text").alias("line"), F.explode(lexicon.contained("text", ["that", "with", "nicht"])).alias("tag")).join(docs.select("doc_id", F.col("poet").alias("lang")), "doc_id")
    cells = met.select("tag", "lang").distinct()
    return promotion.sample_lines(cells, met, "tag", "lang", "doc_id", "line").select("tag", "lang", "doc_id", "line", "place")


@query(r"""SELECT doc_id, CAST(length(text) * 38 + (length(text) - length(replace(text, chr(10), ''))) * 122 AS INTEGER) AS delay FROM documents""")
def reveal_delays(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.reveal_delay("text").alias("delay"))


@query("""WITH n AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Province ' ELSE '' END || 'Old ' || n_name || CASE s_suppkey % 3 WHEN 0 THEN ' City' ELSE '' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT id, regexp_replace(regexp_replace(name, '^Province (.)', '\\1'), ' City$', '') AS name FROM n)
  SELECT id, CASE WHEN contains(name, 'CHINA') THEN 'CHINA' WHEN contains(name, 'PERU') THEN 'PERU' WHEN contains(name, 'JAPAN') THEN 'JAPAN' ELSE name END AS key FROM m""")
def place_key_resolution(spark, sf_dir):
    n = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "Province ").otherwise(""), F.lit("Old "), "n_name", F.when(F.col("s_suppkey") % 3 == 0, " City").otherwise(""))
    return n.select(F.col("s_suppkey").alias("id"), T.resolve_key(name, ["CHINA", "PERU", "JAPAN"], ["Province "], [" City"]).alias("key"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('x' || text) <> sha256(text) ELSE false END AS differs FROM documents""")
def declared_hashes(spark, sf_dir):
    declared = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", T.hash_differs(declared, "text").alias("differs"))


_EVIDENCE = """e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber || '' AS id, 'in ' || year(l_shipdate) || ' at port' || l_suppkey % 4 AS excerpt, l_linenumber % 5 NOT IN (0, 3) AS d, l_linenumber % 5 IN (2, 3) AS p, l_linenumber % 5 = 4 AS c,
    CASE WHEN l_returnflag = 'N' THEN 'C' ELSE 'B' END AS grade, 'https://' || CASE WHEN l_suppkey % 2 = 0 THEN 'www.poems.example' ELSE 'other.example' END || CASE WHEN l_quantity > 48 THEN '/search' WHEN l_quantity > 45 THEN '/list' ELSE '/work/' || l_partkey END AS url FROM lineitem)"""


@query(f"""WITH {_EVIDENCE}, g AS (SELECT k, string_agg(excerpt, chr(10)) FILTER (WHERE d AND grade = 'B') AS dates, string_agg(excerpt, chr(10)) FILTER (WHERE p AND grade = 'B') AS places, bool_or((d OR p) AND contains(url, '/search')) AS barred,
    bool_or((d OR p) AND contains(url, 'poems.example') AND NOT regexp_matches(url, '/work/[0-9]+$')) AS shape, bool_or(grade = 'B' AND NOT d AND NOT p AND NOT c) AS bare, bool_or(c AND n = 4) AS fact, min(n) AS first FROM e GROUP BY k)
  SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(fact, false) THEN 'context_support' END, CASE WHEN NOT coalesce(contains(dates, year(o_orderdate)::VARCHAR), false) THEN 'date_visible' END, CASE WHEN coalesce(barred, false) THEN 'direct_page' END,
    CASE WHEN coalesce(bare, false) THEN 'identity_grade' END, CASE WHEN coalesce(shape, false) THEN 'page_shape' END, CASE WHEN NOT coalesce(contains(places, 'port' || o_orderkey % 4), false) THEN 'place_visible' END) AS errors FROM orders LEFT JOIN g ON k = o_orderkey""")
def package_semantics(spark, sf_dir):
    """Orders as fact packages whose lines are the evidence: year and place of the order must be visible in it, pages direct and of their host's shape."""
    m, li = F.col("l_linenumber") % 5, _t(spark, sf_dir, "lineitem")
    supports = F.array_compact(F.array(F.when(~m.isin(0, 3), "date"), F.when(m.isin(2, 3), "place"), F.when(m == 4, "life_event")))
    host = F.when(F.col("l_suppkey") % 2 == 0, "www.poems.example").otherwise("other.example")
    path = F.when(F.col("l_quantity") > 48, "/search").when(F.col("l_quantity") > 45, "/list").otherwise(F.concat(F.lit("/work/"), F.col("l_partkey").cast("string")))
    cell = F.struct(
        F.col("l_linenumber").cast("string").alias("evidence_id"), F.concat(F.lit("in "), F.year("l_shipdate"), F.lit(" at port"), F.col("l_suppkey") % 4).alias("excerpt"), supports.alias("supports"),
        F.when(F.col("l_returnflag") == "N", "C").otherwise("B").alias("grade"), F.concat(F.lit("https://"), host, path).alias("url"),
    )
    evidence_of = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(cell)).alias("evidence"))
    fact = F.array(F.struct(F.lit("told").alias("text"), F.array(F.lit("4")).alias("evidence_ids")))
    rows = _t(spark, sf_dir, "orders").join(evidence_of, "o_orderkey", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(evidence_of.schema["evidence"].dataType)))
    rows = rows.select("o_orderkey", "evidence", fact.alias("context_facts"), F.year("o_orderdate").alias("year_start"), F.concat(F.lit("port"), F.col("o_orderkey") % 4).alias("place"))
    found = evidence.semantic_errors(rows, ["year_start"], ["place"], {"poems.example": "^/work/[0-9]+$"})
    return found.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("""SELECT l_orderkey, l_linenumber, sha256(sha256(l_orderkey::VARCHAR) || chr(31) || sha256(l_linenumber::VARCHAR) || chr(31) || sha256(l_returnflag)) AS id FROM lineitem""")
def composed_ids(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", promotion.composed_id(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("id"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderstatus, o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey FROM r WHERE n <= 40""")
def ranked_sort(spark, sf_dir):
    return promotion.ranked_order(_t(spark, sf_dir, "orders"), "o_orderstatus", ["P", "F"], [F.desc("o_totalprice"), "o_orderkey"]).limit(40).select("o_orderkey")


@query("""SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, coalesce(nullif(trim(arg_min(CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE l_returnflag END, (l_orderkey, l_linenumber))), ''), 'D') AS grade FROM lineitem GROUP BY 1""")
def evidence_normalisation(spark, sf_dir):
    """Lines of one number and order are told apart by their place in the table, as the SQL meets them."""
    grade = F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.col("l_returnflag")).alias("grade")
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", grade, F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    return promotion.normalised_evidence(rows, "l_partkey", ["l_orderkey", "l_linenumber", "_at"], {"grade": "D"}).drop("l_linenumber", "_at")


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS st, 'old' AS note FROM orders), v AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'X' END AS s2, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'new' END AS n2 FROM orders WHERE o_orderkey % 2 = 0),
  j AS (SELECT r.*, s2, n2, coalesce((st = 'O' AND s2 IN ('F', 'P')) OR (st = 'P' AND s2 = 'F'), false) AS ok FROM r LEFT JOIN v USING (k)) SELECT k, CASE WHEN ok THEN s2 ELSE st END AS st, CASE WHEN ok THEN coalesce(nullif(trim(n2), ''), note) ELSE note END AS note, s2 IS NOT NULL AND NOT ok AS refused FROM j""")
def review_moves(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    records = o.select(k.alias("k"), F.col("o_orderstatus").alias("st"), F.lit("old").alias("note"))
    reviews = o.filter("o_orderkey % 2 = 0").select(k.alias("k"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "O").otherwise("X").alias("st"), F.when(k % 4 == 0, " ").otherwise("new").alias("note"))
    return promotion.apply_reviews(records, reviews, "k", "st", {"O": ["F", "P"], "P": ["F"]}, "note")


_SPIRIT = {t: (dict((d[0], d[1:]) for d in L.DIMENSIONS)[label][0], 1 + round(4 * dict((d[0], d[1:]) for d in L.DIMENSIONS)[label][1])) for label, ts in L.EMOTIONS.items() for t, _ in ts}
_PERIODS = [("youth", 1990, 1995), ("journeys", 1996, 1996), ("court", 1997, 1998), ("exile", 1999, 1999), ("age", 2000, 2030)]


@query(f"""WITH p(period, low, high) AS (VALUES {", ".join(str(p) for p in _PERIODS)}), w AS (SELECT doc_id, text, year(o_orderdate) AS y FROM documents JOIN orders ON o_orderkey = doc_id),
  e AS (SELECT y, unnest(regexp_extract_all(text, '({"|".join(lexicon.by_length(_SPIRIT))})')) AS t FROM w), v(t, s, z) AS (VALUES {", ".join(f"('{t}', {s}::DOUBLE, {z}::DOUBLE)" for t, (s, z) in sorted(_SPIRIT.items()))})
  SELECT period, count(*) AS n, round(avg(s), 6) AS sentiment, round(avg(z), 6) AS scale FROM e JOIN v USING (t) JOIN p ON y BETWEEN low AND high GROUP BY period""")
def spirit_terrain(spark, sf_dir):
    """Works in the year of the order of their number, in five periods of years; sentiment and scale are those of the terms' labels."""
    table = F.create_map(*[v for t, (s, z) in sorted(_SPIRIT.items()) for v in (F.lit(t), F.struct(F.lit(float(s)).alias("s"), F.lit(float(z)).alias("z")))])
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"))
    period = None
    for name, low, high in _PERIODS:
        fits = F.col("y").between(low, high)
        period = F.when(fits, name) if period is None else period.when(fits, name)
    hits = _t(spark, sf_dir, "documents").join(o, "doc_id").select(period.alias("period"), F.explode(lexicon.leftmost_matches("text", list(_SPIRIT))).alias("t")).withColumn("v", table[F.col("t")])
    return promotion.terrain(hits.filter("period is not null").select("period", "v.s", "v.z"), "period", "s", "z")


@query("""WITH n AS (SELECT l_orderkey AS r, l_linenumber AS o, l_partkey AS node FROM lineitem WHERE l_discount <= 0.05 AND l_linenumber % 4 <> 3), x AS (SELECT r, node AS from_id, lead(node) OVER (PARTITION BY r ORDER BY o, node) AS to_id, row_number() OVER (PARTITION BY r ORDER BY o, node) AS leg FROM n)
  SELECT r, from_id, to_id, CAST(leg AS INTEGER) AS leg FROM x WHERE to_id IS NOT NULL""")
def route_legs(spark, sf_dir):
    nodes = _t(spark, sf_dir, "lineitem").filter("l_linenumber % 4 <> 3").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("node"), "l_discount")
    return promotion.route_legs(nodes, "r", "o", "node", F.col("l_discount") <= 0.05)


@query("""WITH p AS (SELECT p_partkey AS i, p_brand AS g, p_size // 10 AS z, row_number() OVER (PARTITION BY p_brand, p_size // 10 ORDER BY md5('decoy:' || p_partkey), p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand, p_size // 10) AS c FROM part)
  SELECT a.i, b.i AS decoy, CAST(k AS INTEGER) AS place FROM p a, (SELECT unnest([1, 2, 3]) AS k), p b WHERE k < a.c AND b.g = a.g AND b.z = a.z AND b.p = (a.p + k) % a.c""")
def decoy_picks(spark, sf_dir):
    items = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("g"), F.floor(F.col("p_size") / 10).alias("z"))
    return promotion.near_length_decoys(items, "g", "i", "z", "decoy")
