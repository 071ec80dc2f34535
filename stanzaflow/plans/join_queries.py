"""Queries on joins, places and times, merges, evidence and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import affect, coverage, evidence, joins, merge, stylometry

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


# ---------------------------------------------------------------- plain join kinds

@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def equi_join_lines(spark, sf_dir):
    o, c, n = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""")
def left_join_counts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return _t(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 UNION SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)""")
def semi_join_tag_or_label(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= 50) | (F.col("l_discount") >= 0.1))
    return _t(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("""SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)""")
def anti_join_done(spark, sf_dir):
    done = _t(spark, sf_dir, "labels").filter("quality = 1")
    return _t(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id")


@query("""WITH k AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 10 <> 3), d AS (SELECT doc_id FROM documents)
  SELECT CASE WHEN k.doc_id IS NULL THEN 'not_in_labels' ELSE 'in_labels' END AS state, count(*) AS n FROM d LEFT JOIN k USING (doc_id) GROUP BY 1""")
def key_lookup_missing_counted(spark, sf_dir):
    known = _t(spark, sf_dir, "labels").filter("doc_id % 10 <> 3").select("doc_id").distinct().withColumn("known", F.lit(True))
    docs = _t(spark, sf_dir, "documents").join(known, "doc_id", "left")
    return evidence.funnel(docs, [("not_in_labels", F.col("known").isNull())], "in_labels").withColumnRenamed("reason", "state")


@query("""SELECT r_name, count(*) AS n FROM region CROSS JOIN part WHERE p_size > r_regionkey * 10 GROUP BY r_name""")
def cross_join_classify(spark, sf_dir):
    region = F.broadcast(_t(spark, sf_dir, "region"))  # five rows
    return _t(spark, sf_dir, "part").join(region, F.col("p_size") > F.col("r_regionkey") * 10).groupBy("r_name").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.k, b.k) AS n_nationkey, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_outer_profile(spark, sf_dir):
    parts = {"customers": _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "suppliers": _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))}
    return coverage.full_profile(parts, "n_nationkey")


# ---------------------------------------------------------------- bands, intervals, nearest

@query("""SELECT a.event_id, b.event_id AS other_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) <= 1""")
def band_join_year(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", F.unix_date(F.to_date("ts")))
    a = e.filter("event_type = 'purchase'").select("user_id", "event_id", "day")
    b = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("other_id"), F.col("day").alias("other_day"))
    return joins.band_join(a, b, "user_id", "day", "other_day", 1).select("event_id", "other_id")


_SHIP = "SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::DATE AS s, max(l_shipdate)::DATE AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def _spans(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    o = _t(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.unix_date(F.to_date("o_orderdate")).alias("s"), F.unix_date(F.to_date("ship")).alias("e"))


@query(f"""WITH x AS (SELECT * FROM ({_SHIP}) WHERE s <= e) SELECT a.id AS left_id, b.id AS right_id FROM x a JOIN x b ON a.k = b.k AND a.id < b.id AND a.s <= b.e AND b.s <= a.e""")
def interval_overlap_pairs(spark, sf_dir):
    x = _spans(spark, sf_dir)
    y = x.select("k", F.col("id").alias("right_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return joins.interval_join(x, y, "k", ("s", "e"), ("s2", "e2"), 60).filter("id < right_id").select(F.col("id").alias("left_id"), "right_id")


@query("""WITH w AS (SELECT user_id, min(ts)::DATE AS ws, min(ts)::DATE + 10 AS we, min_by(event_type, (ts, event_id)) AS wp FROM events GROUP BY user_id), j AS (SELECT e.user_id, e.event_id, e.ts::DATE BETWEEN ws AND we AS inside, event_type <> wp AS other FROM events e JOIN w USING (user_id))
  SELECT user_id, count(*) AS n_works, count(*) FILTER (WHERE inside AND other) AS n_conflict, count(*) FILTER (WHERE NOT inside) AS n_gap FROM j GROUP BY user_id""")
def interval_overlap_conflict_gap(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", F.unix_date(F.to_date("ts")))
    win = e.groupBy("user_id").agg(F.min("day").alias("win_start"), (F.min("day") + 10).alias("win_end"), F.min_by("event_type", F.struct("ts", "event_id")).alias("win_place"))
    return evidence.conflict_and_gap(e, win, "user_id", "event_id", "day", "event_type")


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
  j AS (SELECT p.event_id, v.event_id AS anchor_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS distance FROM p JOIN v USING (user_id))
  SELECT event_id, anchor_id FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, anchor_id) = 1""")
def nearest_anchor(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    p = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    v = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("anchor_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    return joins.nearest(p, v, "user_id", "event_id", "t", "u", "anchor_id").select("event_id", "anchor_id")


@query("""SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_last_view(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_view"))
    return joins.as_of(e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), views, "user_id", "ts", "ts", ["last_view"]).select("event_id", "last_view")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT s_suppkey, s_nationkey * 5 AS lo, s_nationkey * 5 + 20 AS hi FROM supplier),
  j AS (SELECT p_partkey, p_size, s_suppkey, p_size BETWEEN lo AND hi AS inside, CASE WHEN p_size < lo THEN lo - p_size WHEN p_size > hi THEN p_size - hi ELSE 0 END AS dist FROM part JOIN g ON p_partkey % 7 = s_suppkey % 7)
  SELECT p_partkey, s_suppkey, inside FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY inside DESC, dist, s_suppkey) = 1""")
def nearest_interval_pick(spark, sf_dir):
    g = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("m"), (F.col("s_nationkey") * 5).alias("lo"), (F.col("s_nationkey") * 5 + 20).alias("hi"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 7).alias("m"))
    return joins.nearest_interval(rows, g, "m", "p_partkey", "p_size", ("lo", "hi"), "s_suppkey").select("p_partkey", "s_suppkey", "inside")


# ---------------------------------------------------------------- places

_PLACE = "(s_suppkey * 37 % 300) / 10.0 - 15 AS lon, (s_suppkey * 17 % 300) / 10.0 + 30 AS lat"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _places(spark, sf_dir) -> DataFrame:
    lon = (F.col("s_suppkey") * 37 % 300) / 10.0 - 15
    return _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", lon.alias("lon"), ((F.col("s_suppkey") * 17 % 300) / 10.0 + 30).alias("lat"))


@query(f"""WITH p AS (SELECT s_suppkey, {_PLACE} FROM supplier) SELECT a.s_suppkey, count(b.s_suppkey) AS n_near FROM p a LEFT JOIN p b ON a.s_suppkey <> b.s_suppkey AND {_KM} <= 500 GROUP BY a.s_suppkey""")
def spatial_count_500km(spark, sf_dir):
    return joins.within_km(_places(spark, sf_dir), "s_suppkey", 500)


@query(f"""WITH p AS (SELECT s_suppkey, s_nationkey, {_PLACE} FROM supplier), f AS (SELECT a.s_nationkey, max({_KM}) AS d FROM p a JOIN p b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1)
  SELECT s_nationkey, count(*) AS n, round(coalesce(any_value(d), 0.0), 3) AS diameter, coalesce(any_value(d), 0.0) <= 1500 AS one_cluster FROM p LEFT JOIN f USING (s_nationkey) GROUP BY s_nationkey""")
def pairwise_cluster_gate(spark, sf_dir):
    d = joins.cluster_diameter(_places(spark, sf_dir), "s_nationkey", "s_suppkey", "lon", "lat")
    return d.withColumn("one_cluster", F.col("diameter") <= 1500)


@query(f"""WITH p AS (SELECT s_suppkey, {_PLACE} FROM supplier), q AS (SELECT b.s_suppkey, {_KM} AS km FROM p a JOIN p b ON a.s_suppkey = 1) SELECT s_suppkey, round(km, 3) AS km, round(5000 * exp(-km / 300)) AS points FROM q""")
def distance_points(spark, sf_dir):
    p = _places(spark, sf_dir)
    start = F.broadcast(p.filter("s_suppkey = 1").select(F.col("lon").alias("x"), F.col("lat").alias("y")))  # one row
    km = geo.haversine_km("x", "y", "lon", "lat")
    return p.crossJoin(start).select("s_suppkey", F.round(km, 3).alias("km"), geo.score_decay(km).alias("points"))


@query("""SELECT s_suppkey, lon IS NOT NULL AND NOT (lon = 0 AND lat = 0) AND lon BETWEEN 73 AND 136 AND lat BETWEEN 18 AND 54 AS valid FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * 3.0 % 200 END AS lon, s_suppkey * 7.0 % 80 AS lat FROM supplier)""")
def coordinate_box(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") * 3.0 % 200).alias("lon"), (F.col("s_suppkey") * 7.0 % 80).alias("lat"))
    return s.select("s_suppkey", geo.valid_point("lon", "lat", 73, 136, 18, 54).alias("valid"))


@query("""WITH p AS (SELECT n_nationkey, n_nationkey * 3.0 AS x1, n_nationkey * 2.0 AS y1, n_nationkey * 3.0 + 10 AS x2, n_nationkey * 2.0 + 5 AS y2, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END AS s FROM nation),
  c AS (SELECT *, (x1 + x2) / 2 - (y2 - y1) * 0.12 * s AS cx, (y1 + y2) / 2 + (x2 - x1) * 0.12 * s AS cy FROM p), i AS (SELECT unnest(range(0, 28)) AS i)
  SELECT n_nationkey, CAST(i AS INTEGER) AS i, round(((1 - i / 27.0::DOUBLE) ** 2 * x1 + 2 * (1 - i / 27.0::DOUBLE) * (i / 27.0::DOUBLE) * cx + (i / 27.0::DOUBLE) ** 2 * x2)::DOUBLE, 6) AS x, round(((1 - i / 27.0::DOUBLE) ** 2 * y1 + 2 * (1 - i / 27.0::DOUBLE) * (i / 27.0::DOUBLE) * cy + (i / 27.0::DOUBLE) ** 2 * y2)::DOUBLE, 6) AS y FROM c, i""")
def path_bezier_samples(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("double"))
    ends = n.select("n_nationkey", (F.col("k") * 3).alias("x1"), (F.col("k") * 2).alias("y1"), (F.col("k") * 3 + 10).alias("x2"), (F.col("k") * 2 + 5).alias("y2"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1).alias("s"))
    return ends.select("n_nationkey", F.posexplode(geo.bezier_path("x1", "y1", "x2", "y2", "s")).alias("i", "p")).select("n_nationkey", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


# ---------------------------------------------------------------- sequences

@query("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations) SELECT role AS from_role, nxt AS to_role, count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY ALL""")
def adjacent_transitions(spark, sf_dir):
    pairs = joins.adjacent_pairs(_t(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "role")
    return pairs.groupBy(F.col("from_id").alias("from_role"), F.col("to_id").alias("to_role")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) SELECT conv_id, bool_and(turn = n - 1 + first) AS dense FROM s GROUP BY conv_id""")
def dense_sequence_check(spark, sf_dir):
    return merge.dense_by_group(_t(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf_dir):
    return merge.latest_per_key(_t(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 3""")
def first_n_per_group(spark, sf_dir):
    return stylometry.first_k(_t(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 3)


@query("""WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part), k AS (SELECT * FROM r WHERE n <= 4)
  SELECT p_partkey, p_brand, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM k QUALIFY place <= 24""")
def greedy_cap_pick(spark, sf_dir):
    capped = stylometry.first_k(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 4, "n")
    top = capped.orderBy(F.desc("p_retailprice"), "p_partkey").limit(24)
    return top.select("p_partkey", "p_brand", F.row_number().over(W.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))  # 24 rows


@query("""WITH r AS (SELECT doc_id, source, md5('shuffle:' || doc_id) AS h FROM documents) SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS INTEGER) AS place FROM r QUALIFY place <= 4""")
def hash_order_shuffle(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.concat(F.lit("shuffle:"), "doc_id")).alias("h"))
    return stylometry.first_k(d, "source", ["h", "doc_id"], 4).select("source", "doc_id", "place")


@query("""WITH d AS (SELECT n_nationkey AS k, 'direct' AS v FROM nation WHERE n_nationkey % 3 = 0), s AS (SELECT n_nationkey AS k, 'visual' AS v FROM nation WHERE n_nationkey % 2 = 0)
  SELECT n_nationkey, CASE WHEN d.k IS NOT NULL THEN 1 WHEN s.k IS NOT NULL THEN 2 END AS source_no, coalesce(d.v, s.v) AS v FROM nation LEFT JOIN d ON d.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def ordered_fallback_lookup(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey")
    direct, visual = n.filter("n_nationkey % 3 = 0").withColumn("v", F.lit("direct")), n.filter("n_nationkey % 2 = 0").withColumn("v", F.lit("visual"))
    return joins.first_available(n, [direct, visual], ["n_nationkey"], ["v"])


# ---------------------------------------------------------------- evidence

_CLAIMS = "c AS (SELECT l_partkey AS k, year(l_shipdate) AS y, 'f' || (l_suppkey % 4) AS fam, l_returnflag AS g, l_quantity AS q, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"


def _claims(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    family = F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string"))
    return li.select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y"), family.alias("fam"), F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query(f"""WITH {_CLAIMS}, v AS (SELECT k, y, count(DISTINCT fam) AS agreeing FROM c GROUP BY ALL) SELECT k, CAST(y AS INTEGER) AS y, agreeing, count(*) OVER (PARTITION BY k) AS n_values, count(*) OVER (PARTITION BY k) > 1 AS conflict FROM v""")
def source_agreement_conflict(spark, sf_dir):
    return evidence.source_agreement(_claims(spark, sf_dir), "k", "y", "fam")


@query("""SELECT l_partkey AS k, max(l_shipdate::DATE - 30) > min(l_shipdate::DATE) AND count(*) >= 2 AND count(DISTINCT l_suppkey) >= 2 AS conflict, count(*) AS n FROM lineitem GROUP BY 1""")
def interval_date_conflict(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.date_sub(F.to_date("l_shipdate"), 30).alias("s"), F.to_date("l_shipdate").alias("e"), "l_suppkey")
    return evidence.interval_conflict(li, "k", "s", "e", "l_suppkey").select("k", "conflict", "n")


@query(f"""WITH {_CLAIMS}, f AS (SELECT k, fam, min(y) AS y FROM c GROUP BY ALL) SELECT k, count(*) AS families, CAST(min(y) AS INTEGER) AS low, CAST(max(y) AS INTEGER) AS high FROM f GROUP BY k HAVING count(*) >= 2 AND max(y) - min(y) <= 1""")
def dual_source_gate(spark, sf_dir):
    return evidence.dual_source_gate(_claims(spark, sf_dir), "k", "fam", "y")


@query(f"""WITH {_CLAIMS}, f AS (SELECT k, fam, min(y) AS y FROM c WHERE q >= 40 GROUP BY ALL), g AS (SELECT k, count(*) AS n, min(y) AS low, max(y) AS high, min(fam) AS fam FROM f GROUP BY k)
  SELECT k, CASE WHEN n >= 2 AND high - low <= 1 THEN 'dual_exact' WHEN n >= 2 AND high - low <= 3 THEN 'dual_range' WHEN n >= 2 THEN 'gap_too_large' WHEN fam = 'f0' THEN 'single_b' WHEN fam IN ('f1', 'f2') THEN 'single_c' ELSE 'none' END AS rule, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high FROM g""")
def relaxed_gate_rules(spark, sf_dir):
    return evidence.ordered_rules(_claims(spark, sf_dir).filter("q >= 40"), "k", "fam", "y", [("f0", "single_b"), ("f1", "single_c"), ("f2", "single_c")])


@query(f"""WITH {_CLAIMS}, n AS (SELECT *, CASE g WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END AS grade FROM c), s AS (SELECT k, y, count(DISTINCT fam) AS s FROM n GROUP BY ALL) SELECT id, grade, grade IN ('A', 'B') OR s >= 2 AS publish FROM n JOIN s USING (k, y)""")
def publishable_claims(spark, sf_dir):
    c = _claims(spark, sf_dir).withColumn("grade", F.when(F.col("g") == "A", "A").when(F.col("g") == "R", "B").otherwise("C"))
    return evidence.publishable(c, "k", "y", "fam", "grade").select("id", "grade", "publish")


@query("""SELECT o_orderkey, round(greatest(0.0, least(0.99, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.75 ELSE 0.5 END * m + CASE WHEN s >= 2 THEN 0.05 ELSE 0.0 END - CASE WHEN x THEN 0.2 ELSE 0.0 END))::DOUBLE, 3) AS confidence
  FROM (SELECT o_orderkey, o_orderstatus, 0.9 + (o_orderkey % 3) * 0.05 AS m, o_orderkey % 4 AS s, o_orderkey % 5 = 0 AS x FROM orders)""")
def confidence_score(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (0.9 + (F.col("o_orderkey") % 3) * 0.05).alias("m"), (F.col("o_orderkey") % 4).alias("s"), (F.col("o_orderkey") % 5 == 0).alias("x"))
    return o.select("o_orderkey", affect.confidence_for("o_orderstatus", "m", "s", "x", {"F": 0.9, "O": 0.75, "P": 0.5}).alias("confidence"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, 100 * CAST(l_returnflag = 'N' AS INTEGER) + 10 * CAST(l_quantity > 25 AS INTEGER) + CAST(l_discount > 0.05 AS INTEGER) AS sc FROM lineitem), t AS (SELECT l_orderkey, sc, count(*) AS ties, min(l_suppkey) AS c FROM s GROUP BY ALL)
  SELECT l_orderkey, CASE WHEN ties = 1 THEN c END AS winner, sc AS top_score, ties FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY sc DESC) = 1""")
def unique_winner(spark, sf_dir):
    score = 100 * (F.col("l_returnflag") == "N").cast("int") + 10 * (F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int")
    return evidence.unique_winner(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", score)


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'no_year' WHEN o_totalprice < 20000 THEN 'author_mismatch' WHEN o_orderpriority LIKE '5%' THEN 'unmatched' ELSE 'candidate' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def matching_funnel(spark, sf_dir):
    reasons = [("no_year", F.col("o_orderstatus") == "P"), ("author_mismatch", F.col("o_totalprice") < 20000), ("unmatched", F.col("o_orderpriority").startswith("5"))]
    return evidence.funnel(_t(spark, sf_dir, "orders"), reasons, "candidate")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN NOT (o_totalprice BETWEEN 1000 AND 250000) THEN 'price' END, CASE WHEN NOT (o_orderstatus IN ('O', 'F')) THEN 'status' END, CASE WHEN NOT (coalesce(s, 0) >= 2) THEN 'sources' END) AS errors
  FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def package_validation(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("s"))
    o = _t(spark, sf_dir, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {"price": F.col("o_totalprice").between(1000, 250000), "status": F.col("o_orderstatus").isin("O", "F"), "sources": F.col("s") >= 2}
    return evidence.package_errors(o, rules).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {_CLAIMS} SELECT k, CAST(arg_min(y, (-q, id)) AS INTEGER) AS y, array_to_string(list_sort(list_distinct(list(fam))), ',') AS sources, count(*) AS n_claims, count(DISTINCT y) AS n_values FROM c GROUP BY k""")
def approved_record(spark, sf_dir):
    return evidence.best_record(_claims(spark, sf_dir), "k", [F.desc("q"), "id"], ["y"], "fam").withColumn("sources", F.array_join("sources", ","))


@query("""SELECT p_name, count(DISTINCT p_partkey) AS works FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1""")
def ambiguous_titles(spark, sf_dir):
    return evidence.ambiguous_titles(_t(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS identities FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1""")
def cross_batch_reuse(spark, sf_dir):
    return evidence.cross_reuse(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("""WITH s AS (SELECT c_nationkey || ':' || length(c_mktsegment) AS g, c_mktsegment AS t FROM customer), z AS (SELECT g, count(*) AS n, min(length(t)) AS lo, max(length(t)) AS hi FROM s GROUP BY g),
  c AS (SELECT g, i, substring(t, i, 1) AS ch, n, lo FROM s JOIN z USING (g), (SELECT unnest(range(1, 40)) AS i) WHERE lo = hi AND i <= lo), v AS (SELECT g, i, ch, count(*) AS v, any_value(n) AS n, any_value(lo) AS lo FROM c GROUP BY ALL HAVING count(*) >= any_value(n) // 2 + 1),
  w AS (SELECT g, CASE WHEN count(*) = any_value(lo) THEN string_agg(ch, '' ORDER BY i) END AS consensus FROM v GROUP BY g) SELECT DISTINCT s.g, consensus FROM s LEFT JOIN w USING (g)""")
def char_consensus(spark, sf_dir):
    s = _t(spark, sf_dir, "customer").select(F.concat_ws(":", "c_nationkey", F.length("c_mktsegment")).alias("g"), F.col("c_mktsegment").alias("t"))
    return evidence.character_consensus(s, "g", "t")


# ---------------------------------------------------------------- merges and sets

_OLD = "o AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS note FROM customer WHERE c_custkey % 3 <> 0)"
_NEW = "n AS (SELECT c_custkey AS id, upper(c_name) AS name, 'new' AS note FROM customer WHERE c_custkey % 2 = 0)"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 4 == 1, "").when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), note.alias("note"))
    return old, c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("new").alias("note"))


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(o.note, n.note) AS note FROM o FULL JOIN n ON o.id = n.id""")
def upsert_existing_wins(spark, sf_dir):
    return merge.upsert_existing_wins(*_versions(spark, sf_dir), ["id"])


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(nullif(o.note, ''), n.note) AS note FROM o FULL JOIN n ON o.id = n.id""")
def upsert_incoming_wins(spark, sf_dir):
    return merge.upsert_incoming_wins(*_versions(spark, sf_dir), ["id"], ["note"])


@query(f"""WITH {_OLD}, {_NEW} SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upsert_last_row(spark, sf_dir):
    return merge.upsert_last_row(*_versions(spark, sf_dir), ["id"])


@query(f"""WITH {_OLD}, {_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)""")
def insert_or_ignore(spark, sf_dir):
    return merge.insert_or_ignore(*_versions(spark, sf_dir), ["id"])


@query(f"""WITH {_OLD}, {_NEW}, so AS (SELECT *, id % 5 AS scope FROM o), sn AS (SELECT *, id % 5 AS scope FROM n WHERE id % 5 < 2), s AS (SELECT * FROM so WHERE scope >= 2 OR id IN (SELECT id FROM sn))
  SELECT coalesce(s.id, sn.id) AS id, coalesce(sn.name, s.name) AS name, coalesce(nullif(s.note, ''), sn.note) AS note, coalesce(sn.scope, s.scope) AS scope FROM s FULL JOIN sn ON s.id = sn.id""")
def scope_refresh(spark, sf_dir):
    old, new = (v.withColumn("scope", F.col("id") % 5) for v in _versions(spark, sf_dir))
    done = spark.createDataFrame([(0,), (1,)], "scope bigint")
    return merge.refresh_scopes(old, new.filter("scope < 2"), done, ["scope"], ["id"], ["note"])


@query("""WITH o AS (SELECT c_custkey AS id, c_custkey % 7 AS h, CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS st FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE c_custkey % 7 END AS h FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 11 = 0)
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR (o.h = n.h AND o.st = 'completed') THEN o.h ELSE n.h END AS h, CASE WHEN n.id IS NULL OR (o.h = n.h AND o.st = 'completed') THEN o.st ELSE 'pending' END AS st FROM o FULL JOIN n ON o.id = n.id""")
def upsert_keep_completed(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    old = c.filter("id % 3 <> 0").select("id", (F.col("id") % 7).alias("h"), F.when(F.col("id") % 2 == 0, "completed").otherwise("failed").alias("st"))
    new = c.filter("id % 2 = 0 OR id % 11 = 0").select("id", F.when(F.col("id") % 5 == 0, 99).otherwise(F.col("id") % 7).alias("h"), F.lit("pending").alias("st"))
    return merge.upsert_keep_done(old, new, ["id"], "h", "st")


@query("""SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05)) AS only_a, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 25)) AS only_b""")
def set_equality_check(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return merge.set_difference_counts(li.filter("l_quantity > 25").select("l_suppkey").distinct(), li.filter("l_discount > 0.05").select("l_suppkey").distinct())


@query("""SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys_having(spark, sf_dir):
    return merge.duplicate_keys(_t(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT count(*) AS n, count(DISTINCT vec_id) AS n_distinct, min(vec_id) AS low, max(vec_id) AS high, count(*) = count(DISTINCT vec_id) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS dense FROM embeddings""")
def index_dense_range(spark, sf_dir):
    return merge.dense_index_check(_t(spark, sf_dir, "embeddings"), "vec_id")


@query("""SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct_ids(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")).union(_t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def set_intersect_except(spark, sf_dir):
    labels, docs = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents")
    good = labels.filter("quality = 1").select("doc_id").intersect(docs.filter("lang = 'en'").select("doc_id"))
    return good.subtract(labels.filter("toxic = 1").select("doc_id"))


# ---------------------------------------------------------------- roll-ups

@query("""SELECT source, lang, CAST(grouping_id(source, lang) AS INTEGER) AS level, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS success, count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE quality IS NULL) AS missing
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source, lang), (source), ())""")
def coverage_grouping_sets(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return coverage.coverage_levels(d, "source", "lang", {"success": F.col("quality") == 1, "failed": F.col("quality") == 0, "missing": F.col("quality").isNull()})


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT source, arg_max(lang, (n, -f)) AS lang, CAST(sum(n) AS BIGINT) AS n, min(f) AS first_seen FROM c GROUP BY source""")
def catalog_majority(spark, sf_dir):
    return coverage.majority_catalog(_t(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("""SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS approved, count(*) FILTER (WHERE quality IS NULL) AS candidate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def approved_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return coverage.status_counts(d, ["lang"], {"approved": (F.col("quality") == 1) & (F.col("toxic") == 0), "candidate": F.col("quality").isNull()})


@query("""WITH t AS (SELECT CASE WHEN toxic = 1 THEN 'c' WHEN quality = 1 THEN 'a' ELSE 'b' END AS tier, doc_id, source FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) AS n FROM documents)
  SELECT tier, count(DISTINCT doc_id) AS keys, count(DISTINCT source) AS groups, round(count(DISTINCT doc_id) * 100.0::DOUBLE / any_value(n), 1) AS percent FROM t, n GROUP BY tier UNION ALL SELECT 'combined', count(DISTINCT doc_id), count(DISTINCT source), round(count(DISTINCT doc_id) * 100.0::DOUBLE / any_value(n), 1) FROM t, n""")
def tier_coverage(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    t = _t(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("tier", F.when(F.col("toxic") == 1, "c").when(F.col("quality") == 1, "a").otherwise("b"))
    return coverage.tier_coverage(t, "tier", "doc_id", "source", docs.count())


@query("""SELECT source, count(DISTINCT doc_id) AS n FROM (SELECT source, doc_id FROM documents WHERE n_chars > 2000 UNION ALL SELECT source, doc_id FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def distinct_union_located(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return coverage.distinct_union([docs.filter("n_chars > 2000"), docs.join(_t(spark, sf_dir, "labels"), "doc_id")], "source", "doc_id")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS dreamed, count(*) FILTER (WHERE event_type = 'purchase') AS composed, CASE WHEN count(*) FILTER (WHERE event_type IN ('view', 'purchase')) >= 2 THEN round(count(*) FILTER (WHERE event_type = 'view')::DOUBLE / count(*) FILTER (WHERE event_type IN ('view', 'purchase')), 4) END AS imagined_rate FROM events GROUP BY user_id""")
def imagined_rate(spark, sf_dir):
    return coverage.imagined_rate(_t(spark, sf_dir, "events"), "user_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("""SELECT conv_id, string_agg(text, '|' ORDER BY turn, role, text) AS joined FROM conversations GROUP BY conv_id""")
def listagg_ordered(spark, sf_dir):
    return coverage.joined_texts(_t(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "text", "|")
