"""Common names and places: equal rows are compared as one; ties and lists as the SQL has them."""

import time

from pyspark.sql import functions as F

from stanzaflow.operators import joins, linkage, promotion
from stanzaflow.plans import review_queries, search_queries
from stanzaflow.sources import readers

N = 60000  # rows of one name on each side: 3.6 milliards of pairs
LIMIT = 60  # seconds


def _timed(df) -> tuple[list, float]:
    start = time.time()
    return df.collect(), time.time() - start


def test_authority_matches_of_one_name(spark):
    rows = spark.range(N).withColumn("name", F.lit("wang"))
    local = rows.select("id", "name", F.lit("tang").alias("era"), F.lit(700).alias("birth_low"), F.lit(701).alias("birth_high"), F.lit(None).cast("int").alias("death_low"), F.lit(None).cast("int").alias("death_high"))
    records = rows.select(F.col("id").alias("rid"), F.col("name").alias("r_name"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("id") == 7, F.array(F.lit("tang"))).otherwise(F.array(F.lit("ming"))).alias("eras"), F.lit(699).alias("born_low"), F.lit(702).alias("born_high"), F.lit(750).alias("died_low"), F.lit(760).alias("died_high"))
    got, took = _timed(promotion.authority_matches(local, records, "id", "rid", {}).groupBy("record", "outcome").count())
    assert [tuple(r) for r in got] == [(7, "matched", N)] and took < LIMIT


def test_lists_of_persons_meet_their_persons(spark, tmp_path):
    """As many partitions as rows ask for: the list of one and the list of many are one table, so the join has one number of them."""
    one, two = '{"Person":{"id":"1","A":{"B":{"n":"x"}}}}', '{"Person":{"id":"2","A":{"B":[{"n":"y"},3,{"n":"z"}]}}}'
    df = spark.createDataFrame([(1, one), (2, two), (3, '{"Person":{"id":"3","A":{"B":"text"}}}'), (4, '{"Person":[1]}')], "i int, j string").repartition(3, "i")
    people = readers.person_records(df, "i", "j")
    lists = readers.person_lists(people, "i", "A", "B", {"name": "n"})
    assert "Union" not in lists._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in people.select("i", "person_id").join(lists, "i").collect()) == [(1, "1", 0, "x"), (2, "2", 0, "y"), (2, "2", 2, "z")]


def test_variant_join_of_one_title(spark):
    rows = spark.range(N).select("id", F.lit("red bolt").alias("t"))
    works = spark.range(N).select(F.col("id").alias("w"), F.lit("red bolt").alias("k")).unionByName(spark.createDataFrame([(1, "red"), (1, "red bolt"), (N, "red")], "w bigint, k string"))
    got, took = _timed(linkage.variant_join(rows, "id", "t", {"whole": F.col("t"), "first": F.substring_index("t", " ", 1)}, works, "w", "k").groupBy("n_works", "state").count())
    assert [tuple(r) for r in got] == [(N + 1, "ambiguous", N)] and took < LIMIT


def test_titles_keep_what_their_sql_keeps(spark, tmp_path):
    spark.createDataFrame([(1, "<html><h1>a &amp; b = &quot;c&quot;\n&lt;</h1></html>")], "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in search_queries.html_titles(spark, str(tmp_path)).collect()] == [(1, "a & b = &quot;c&quot; &lt;")]


def test_evidence_of_one_number_goes_by_its_place_in_the_table(spark, tmp_path):
    """Spark reads the largest file first; the first row of the table still counts."""
    schema = "l_partkey bigint, l_orderkey bigint, l_linenumber int, l_returnflag string"
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, rows in (("a", [(1, 5, 1, "R")]), ("b", [(1, 5, 1, "N")] + [(p, p, 1, f"N{p}") for p in range(2, 5000)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    got = review_queries.evidence_normalisation(spark, str(tmp_path)).filter("l_partkey = 1").collect()
    assert [tuple(r) for r in got] == [(1, 5, "R")]


def test_link_scores_of_one_name(spark):
    local = spark.range(N).select("id", F.lit("wang").alias("name"), F.lit(1900).alias("lo"), F.lit(1940).alias("hi"))
    other = spark.range(N).select(F.col("id").alias("oid"), F.lit("wang").alias("name"), F.lit(1930).alias("lo2"), F.when(F.col("id") == 5, 1941).otherwise(1935).alias("hi2"))
    years = linkage.overlap_years("lo", "hi", "lo2", "hi2")
    got, took = _timed(linkage.link_scores(local, other, "name", years, years > 0, "id", "oid", (("lo", "hi"), ("lo2", "hi2"))).groupBy("match", "score", "state").count())
    assert [tuple(r) for r in got] == [(5, 11, "matched", N)] and took < LIMIT


def test_points_of_one_place(spark):
    points = spark.range(N).select("id", F.lit(10.0).alias("lon"), F.lit(50.0).alias("lat")).unionByName(spark.createDataFrame([(N, 10.1, 50.0), (N + 1, 90.0, 0.0)], "id bigint, lon double, lat double"))
    got, took = _timed(joins.within_km(points, "id", 500).groupBy("n_near").count().orderBy("n_near"))
    assert [tuple(r) for r in got] == [(0, 1), (N, N + 1)] and took < LIMIT


def test_repeated_ids_are_not_near_themselves(spark):
    points = spark.createDataFrame([(1, 10.0, 50.0), (1, 10.1, 50.0), (2, 10.0, 50.0)], "id int, lon double, lat double")
    assert sorted(tuple(r) for r in joins.within_km(points, "id", 500).collect()) == [(1, 2), (1, 2), (2, 2)]


def test_same_place_works_inside_and_behind_the_pool(spark):
    works = [(0, w, (w * 5) % 7) for w in range(9)] + [(1, 1, 0)]
    got = sorted(tuple(r) for r in promotion.same_place_works(spark.createDataFrame(works, "k int, w int, q int"), "k", "w", "w", ["q"], cap=4, k=2).collect())
    want = []
    for k, w, _ in works:
        first = [x for x in works if x[0] == k and x[1] != w][:4]
        want += [(k, w, x[1], n + 1) for n, x in enumerate(sorted(first, key=lambda x: (x[2], x[1]))[:2])]
    assert got == sorted(want)


def test_same_place_works_of_one_place(spark):
    mentions = spark.range(1_000_000).select(F.lit(0).alias("k"), F.col("id").alias("w"), (F.col("id") % 7).alias("q"))
    got, took = _timed(promotion.same_place_works(mentions, "k", "w", "w", ["q"]).agg(F.count("*"), F.sum("place")))
    assert tuple(got[0]) == (3_000_000, 6_000_000) and took < 30


def test_catalog_matches_of_common_aliases(spark):
    """A few kinds of owners and records make all pairs of a common alias; those that meet by a rare alias too are told once."""
    roster = [(i, "tang" if i % 3 else "song", ["wang", f"b{i}"] + ["li"] * (i % 2)) for i in range(90)] + [(5, "song", ["wang"]), (None, "tang", ["wang", "x1"])]
    records = [(j, [[], ["tang"], ["song"]][j % 3], [f"b{j}"], ["wang"] if j % 4 else ["li", "zhao"], [("wang", "song")] if j % 5 == 0 else [], f"of b{2 * j}") for j in range(80)] + [(7, ["song"], [], ["li"], [("x1", "")], None), (None, [], ["b3"], ["wang"], [], "t")]
    own = spark.createDataFrame(roster, "id int, era string, aliases array<string>")
    rec = spark.createDataFrame(records, "rid int, eras array<string>, header array<string>, responsible array<string>, people array<struct<name:string,era:string>>, title string")
    owners: dict = {}
    for i, _, names in roster:
        for a in names:
            owners.setdefault(a, set()).update({i} - {None})
    want: dict = {}
    for j, eras, header, responsible, people, title in records:
        named = [(a, None, "header") for a in header] + [(a, None, "responsible") for a in responsible] + [(a, e or None, "person") for a, e in people] + [(a, None, "title") for a in owners if eras and title and a in title]
        for i, era, names in roster:
            for a, of, method in named:
                if a in names and (not eras or era in eras) and of in (None, era):
                    want.setdefault((i, j), set()).add((method, len(owners[a])))
    told = {p: ("matched" if max((n for m, n in ms if m != "title"), default=0) == 1 else "ambiguous", sorted({m for m, _ in ms})) for p, ms in want.items()}
    got = promotion.catalog_matches(own, rec, "id", "rid").collect()
    assert len(got) == len(told) and {(r["id"], r["rid"]): (r["status"], r["methods"]) for r in got} == told
    assert {r["methods"] for r in promotion.catalog_matches(own, rec, "id", "rid", "+").collect()} == {"+".join(m) for _, m in told.values()}


def test_pairs_of_a_common_alias_are_not_grouped(spark):
    n = 6000
    own = spark.range(n).select("id", F.lit("tang").alias("era"), F.array(F.lit("wang")).alias("aliases"))
    rec = spark.range(n).select(F.col("id").alias("rid"), F.array(F.lit("tang")).alias("eras"), F.array(F.lit("wang")).alias("header"), F.array().cast("array<string>").alias("responsible"), F.array().cast("array<struct<name:string,era:string>>").alias("people"), F.lit("").alias("title"))
    got, took = _timed(promotion.catalog_matches(own, rec, "id", "rid", ",").groupBy("status", "methods").agg(F.count("*"), F.sum("id"), F.sum("rid")))
    each = n * n * (n - 1) // 2
    assert [tuple(r) for r in got] == [("ambiguous", "header", n * n, each, each)] and took < 30
