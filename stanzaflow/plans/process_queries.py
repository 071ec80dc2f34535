"""Queries on ordered processes: reviews, year rows, page loops, outlines, glosses, islands, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chronicle, collection, glossary, joins, lexicon, linkage, outline, packages, places, promotion, registry, report, search, segment, stylometry
from ..operators import transitions as state
from ..operators.glossary import Entry
from ..operators.order import parts_for
from ..sources import markup, readers
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


MOVES = {"needs_review": ["approved", "rejected", "disputed"], "approved": ["disputed", "needs_review"], "rejected": ["needs_review"], "disputed": ["approved", "rejected"]}
_ASKED = {"purchase": "approved", "error": "rejected", "signup": "disputed", "view": "needs_review"}  # a click asks for a state there isn't
_PAIRS = ", ".join(f"('{s}', '{t}')" for s, ts in MOVES.items() for t in ts)
_HISTORY = f"""WITH RECURSIVE m(a, b) AS (VALUES {_PAIRS}),
  e AS (SELECT event_id, user_id, value, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'disputed' WHEN 'view' THEN 'needs_review' ELSE 'closed' END AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  h AS (SELECT NULL::BIGINT AS event_id, u AS user_id, 0::BIGINT AS n, CASE WHEN u % 10 = 9 THEN 'lost' ELSE 'needs_review' END AS before, CASE WHEN u % 10 = 9 THEN 'lost' ELSE 'needs_review' END AS after, NULL::VARCHAR AS refused FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 7 <> 3)
    UNION ALL SELECT e.event_id, e.user_id, e.n, h.after, CASE WHEN h.after <> 'lost' AND e.asked <> 'closed' AND NOT (e.asked = 'approved' AND e.value < 20) AND m.a IS NOT NULL THEN e.asked ELSE h.after END,
      CASE WHEN h.after = 'lost' OR e.asked = 'closed' THEN 'unknown_state' WHEN e.asked = 'approved' AND e.value < 20 THEN 'not_allowed' WHEN m.a IS NULL THEN 'no_move' END
    FROM h JOIN e ON e.user_id = h.user_id AND e.n = h.n + 1 LEFT JOIN m ON m.a = h.after AND m.b = e.asked),
  every AS (SELECT event_id, user_id, n, CASE WHEN before <> 'lost' THEN before END AS before, CASE WHEN after <> 'lost' THEN after END AS after, refused FROM h WHERE n > 0
    UNION ALL SELECT event_id, user_id, n, NULL, NULL, 'unknown_record' FROM e WHERE user_id % 7 = 3)"""


def _history(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "events")
    records = e.filter("user_id % 7 <> 3").select("user_id", F.when(F.col("user_id") % 10 == 9, "lost").otherwise("needs_review").alias("state")).distinct()
    asked = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in _ASKED.items() for v in p]), F.col("event_type")), F.lit("closed"))
    reviews = e.select("event_id", "user_id", "ts", "value", asked.alias("asked"))
    allowed = (F.col("asked") != "approved") | (F.col("value") >= 20)  # an approval needs a reviewer; here, a value
    return records, state.transitions(records, reviews, "user_id", "state", "asked", ["ts", "event_id"], MOVES, allowed)


@query(f"{_HISTORY} SELECT event_id, before, after, refused FROM every")
def review_history(spark, sf_dir):
    return _history(spark, sf_dir)[1].select("event_id", "before", "after", "refused")


@query(f"""{_HISTORY} SELECT u AS user_id, coalesce((SELECT arg_max(after, n) FROM every WHERE every.user_id = u), CASE WHEN u % 10 = 9 THEN 'lost' ELSE 'needs_review' END) AS state, (SELECT count(refused) FROM every WHERE every.user_id = u) AS n_refused FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 7 <> 3)""")
def review_states(spark, sf_dir):
    records, history = _history(spark, sf_dir)
    return state.settled_states(records, history, "user_id", "state", ["ts", "event_id"])


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag = 'R', l_quantity <= 40, l_shipdate) AS n, l_partkey, l_returnflag, l_quantity, year(l_shipdate) AS y FROM lineitem),
  s AS (SELECT *, l_returnflag = 'R' AS border, count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY k ORDER BY n) AS seg FROM l),
  b AS (SELECT k, seg, CASE WHEN l_quantity <= 40 THEN y END AS b, y + 1 AS e FROM s WHERE border UNION ALL SELECT o_orderkey, 0, year(o_orderdate), year(o_orderdate) FROM orders),
  t AS (SELECT k, seg, string_agg('item ' || l_partkey || ' & co', ' ' ORDER BY n) AS text FROM s WHERE NOT border GROUP BY ALL),
  r AS (SELECT t.k, seg, b, e, text FROM t JOIN b USING (k, seg) WHERE b IS NOT NULL AND k % 5 <> 0 AND k % 7 <> 0)
  SELECT k AS o_orderkey, 'o' || k AS label_id, CAST(row_number() OVER (PARTITION BY k ORDER BY seg) - 1 AS INTEGER) AS row_index, CAST(b AS INTEGER) AS begin, CAST(e AS INTEGER) AS "end", text, sha256(text) AS event_hash FROM r""")
def marker_year_rows(spark, sf_dir):
    """Pages made of orders: a label with years, then a block whose lines are items or links with years, some without a first year.

    Every fifth order has another element between label and block, every seventh a label without a last year.
    """
    o = _t(spark, sf_dir, "orders")
    href = lambda b, e: F.concat(F.lit("<a href='ViewDetail?x=1"), b, e, F.lit("'>years</a>"))
    year = F.year("l_shipdate")
    link = href(F.when(F.col("l_quantity") <= 40, F.concat(F.lit("&beginYear="), year)).otherwise(F.lit("&beginYear=")), F.concat(F.lit("&endYear="), year + 1))
    item = F.concat(F.lit(" item "), F.lit("<b>"), F.col("l_partkey").cast("string"), F.lit("</b> &amp; co\n"))
    cell = F.when(F.col("l_returnflag") == "R", link).otherwise(item).alias("cell")
    parts = parts_for(o, 1 << 16)  # reading a page costs more than its bytes tell
    body = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", cell).repartition(parts, "o_orderkey").groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "cell"))), lambda x: x["cell"]), "").alias("body"))
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    label = F.concat(F.lit("<div class='label1 x'>"), href(F.concat(F.lit("&beginYear="), y), F.when(k % 7 != 0, F.concat(F.lit("&endYear="), y)).otherwise(F.lit(""))), F.lit("</div>\n"))
    noise = F.when(k % 5 == 0, "<div class='noise'>-</div>").otherwise("<!-- none -->")
    html = F.concat(F.lit("<html><body>"), label, noise, F.lit("<div class='detail' id='o"), k.cast("string"), F.lit("'>"), F.coalesce("body", F.lit("")), F.lit("</div></body></html>"))
    pages = o.select("o_orderkey", "o_orderdate").repartition(parts, "o_orderkey").join(body, "o_orderkey", "left").select("o_orderkey", html.alias("html"))
    return markup.year_rows(pages, "o_orderkey").drop("block_no")


@query("""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="(/[^"]*)">[^<]*</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="/[^"]*">([^<]*)</a></li>', 1)) AS title, generate_subscripts(regexp_extract_all(html, '<li><a href="/[^"]*">[^<]*</a></li>'), 1) - 1 AS n FROM pages)
  SELECT page_id, CAST(n AS INTEGER) AS entry_no, CAST(0 AS INTEGER) AS depth, href, title, 'unknown' AS precision FROM i""")
def page_list_entries(spark, sf_dir):
    entries = markup.list_entries(_t(spark, sf_dir, "pages"), item="li", link="/", author="", time="")
    return markup.work_years(entries).select("page_id", "entry_no", "depth", "href", "title", "precision")


_ENTRIES = [
    Entry("e1", ("tion", "ontion"), "an ending", category="form"), Entry("e2", ("schaft",), "a bond", category="form"), Entry("e3", ("the ", "The "), "an article", category="word"),
    Entry("e4", ("eau", "eaux"), "water", category="word"), Entry("e5", ("zzz",), "nothing", status="draft"),
]
_FORMS = [(f, e.term_id, e.forms[0].strip(), e.category) for e in _ENTRIES if e.status == "published" for f in (x.strip() for x in e.forms)]
_FORM = "|".join(sorted((f for f, *_ in _FORMS), key=lambda f: (-len(f), f)))
_LINES = r"""p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?;\r\n]*[.!?;]|[^.!?;\r\n]*(?:\r\n|\r|\n)|[^.!?;\r\n]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[^.!?;\r\n]*[.!?;]|[^.!?;\r\n]*(?:\r\n|\r|\n)|[^.!?;\r\n]+'), 1) AS pos FROM documents),
  k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM p WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> '')"""


@query(f"""WITH {_LINES}, f(form, term_id, term, category) AS (VALUES {", ".join(str(t) for t in _FORMS)}),
  m AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_FORM}') AS w, string_split_regex(line, '{_FORM}') AS g FROM k),
  e AS (SELECT doc_id, line_no, unnest(w) AS form, generate_subscripts(w, 1) AS n, w, g FROM m),
  s AS (SELECT doc_id, line_no, form, list_sum(list_transform(g[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:n - 1], lambda x: length(x))), 0) AS pos FROM e)
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, term_id, term, form, CAST(pos AS INTEGER) AS start_offset, CAST(pos + length(form) AS INTEGER) AS end_offset, category FROM s JOIN f USING (form)""")
def glossed_lines(spark, sf_dir):
    """Every glossed span of every line of all documents."""
    lines = segment.split_lines(_t(spark, sf_dir, "documents")).select("doc_id", "line_no", "text")
    return glossary.gloss_lines(lines, _ENTRIES).drop("definition")


_WORDS = "len(string_split(trim(line), ' '))"
_LEVEL = f"CASE WHEN trim(line) = '' THEN NULL WHEN {_WORDS} <= 2 THEN 1 WHEN {_WORDS} <= 6 THEN 2 WHEN {_WORDS} <= 12 THEN 4 END"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT *, {_LEVEL} AS level FROM l),
  h AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER o AS h1, max(CASE WHEN level = 2 THEN n END) OVER o AS h2, max(CASE WHEN level = 4 THEN n END) OVER o AS h4 FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
  p AS (SELECT doc_id, n, level, h1, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END AS h2, CASE WHEN h4 > coalesce(h1, -1) AND h4 > coalesce(h2, -1) THEN h4 END AS h4 FROM h)
  SELECT doc_id, CAST(n AS INTEGER) AS line_no, level, concat_ws('/', '1:' || h1, '2:' || h2, '4:' || h4) AS path FROM p""")
def outline_paths(spark, sf_dir):
    """Short lines as headings of three levels, the shorter the higher; every line with the headings around it."""
    lines = _t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    words = F.size(F.split(F.trim("text"), " "))
    level = F.when(F.trim("text") == "", None).when(words <= 2, 1).when(words <= 6, 2).when(words <= 12, 4)
    tree = outline.outline_tree(lines, "doc_id", "line_no", "text", level, F.col("text"))
    return tree.select("doc_id", "line_no", "level", F.array_join(F.transform("path", lambda h: F.concat_ws(":", h["level"], h["line_no"])), "/").alias("path"))


@query("""WITH e AS (SELECT user_id, event_id, value, event_type, CAST(dayofyear(ts) - 1 AS BIGINT) AS day FROM events), d AS (SELECT user_id, day, count(*) FILTER (WHERE value >= 5) AS n, max(value) AS top, sum(value) FILTER (WHERE event_type = 'purchase') AS bought FROM e GROUP BY ALL),
  p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS page, CASE WHEN bought > 300 THEN 'http_error' ELSE 'ok' END AS status, n, CAST(floor(top / 10) AS BIGINT) AS print, top < 140 AS more FROM d),
  v AS (SELECT *, CASE WHEN status <> 'ok' THEN 'failed' WHEN n = 0 THEN 'empty_page' WHEN row_number() OVER (PARTITION BY user_id, print ORDER BY page) > 1 THEN 'repeated_page' WHEN NOT more THEN 'no_next_page' END AS event FROM p WHERE page < 12),
  f AS (SELECT user_id, min(page) AS stop, arg_min(event, page) AS event FROM v WHERE event IS NOT NULL GROUP BY user_id),
  g AS (SELECT v.user_id, any_value(f.event) AS event, count(*) FILTER (WHERE v.event IS DISTINCT FROM 'failed') AS done, any_value(CASE WHEN f.event = 'failed' THEN stop + 1 END) AS failed_page, coalesce(sum(n) FILTER (WHERE v.event IS NULL OR v.event = 'no_next_page'), 0) AS n FROM v LEFT JOIN f USING (user_id) WHERE page <= coalesce(stop, 99) GROUP BY v.user_id)
  SELECT user_id, CASE WHEN event = 'failed' AND done = 0 THEN 'fetch_failed' WHEN event = 'failed' OR (event IS NULL AND done >= 12) THEN 'partial' WHEN n > 0 THEN 'collected' ELSE 'ok' END AS status,
    CASE WHEN event = 'failed' THEN NULL WHEN event IS NULL AND done >= 12 THEN 'hard_limit_reached' ELSE event END AS stop_reason, done AS pages_completed, CAST(failed_page AS BIGINT) AS failed_page, CAST(n AS BIGINT) AS n_entries, event IS NOT NULL AND event <> 'failed' AS complete FROM g""")
def collection_outcomes(spark, sf_dir):
    """Each user's days as pages of a collection: how far it went and why it stopped."""
    e = _t(spark, sf_dir, "events").withColumn("day", F.dayofyear("ts"))
    d = e.groupBy("user_id", "day").agg(F.count_if(F.col("value") >= 5).alias("n"), F.max("value").alias("top"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("bought"))
    page = F.row_number().over(W.partitionBy("user_id").orderBy("day")) - 1
    pages = d.select("user_id", page.cast("bigint").alias("page"), F.when(F.col("bought") > 300, "http_error").otherwise("ok").alias("status"), "n", F.floor(F.col("top") / 10).alias("print"), (F.col("top") < 140).alias("more"))
    outcomes = collection.page_outcomes(pages, "user_id", "page", "status", "n", "print", "more", 12)
    return collection.collection_status(outcomes, "user_id", "page", "n", 12)


_ISLANDS = """WITH d AS (SELECT user_id, CAST(dayofyear(ts) AS INTEGER) AS v, count(*) AS c FROM events WHERE value > 30 GROUP BY ALL), m AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY user_id ORDER BY v) <= 1 THEN 0 ELSE 1 END AS new FROM d),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY v) AS scene FROM m), i AS (SELECT user_id, CAST(scene AS INTEGER) AS scene, min(v) AS first, max(v) AS last, count(*) AS n_values, CAST(sum(c) AS BIGINT) AS n_rows FROM s GROUP BY ALL),
  g AS (SELECT user_id, scene AS from_scene, lead(scene) OVER w AS to_scene, lead(first) OVER w - last AS gap FROM i WINDOW w AS (PARTITION BY user_id ORDER BY scene))"""


def _scenes(spark, sf_dir) -> DataFrame:
    return chronicle.scenes(_t(spark, sf_dir, "events").filter("value > 30").withColumn("day", F.dayofyear("ts")), "user_id", "day")


@query(f"{_ISLANDS} SELECT * FROM i")
def parallel_scenes(spark, sf_dir):
    return _scenes(spark, sf_dir)


@query(f"{_ISLANDS} SELECT *, gap <= 3 AS resolved FROM g WHERE to_scene IS NOT NULL")
def parallel_segments(spark, sf_dir):
    return chronicle.segments(_scenes(spark, sf_dir), "user_id", 3)


@query(f"""{_ISLANDS} SELECT user_id, count(*) AS scene_count, (SELECT count(*) FROM g WHERE g.user_id = i.user_id AND to_scene IS NOT NULL) AS segment_count, (SELECT count(*) FROM g WHERE g.user_id = i.user_id AND gap > 3) AS unresolved_count, min(first) AS first, max(last) AS last, max(last - first + 1) AS longest FROM i GROUP BY user_id""")
def parallel_stories(spark, sf_dir):
    found = _scenes(spark, sf_dir)
    return chronicle.stories(found, chronicle.segments(found, "user_id", 3), "user_id")


@query("""WITH c AS (SELECT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'place' WHEN 2 THEN 'annotation' ELSE 'appreciation' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN year(l_shipdate)::VARCHAR WHEN 1 THEN 'n' || l_suppkey % 5 WHEN 2 THEN CASE WHEN l_quantity > 45 THEN ' ' ELSE l_returnflag END ELSE l_linestatus END AS value, l_linenumber AS id, l_discount AS conf, 's' || l_suppkey % 3 AS src, l_partkey AS loc FROM lineitem),
  v AS (SELECT k, kind, value, count(*) AS n, max(conf) AS conf, arg_min(id, (-conf, id)) AS id FROM c WHERE trim(value) <> '' GROUP BY ALL),
  b AS (SELECT k, kind, sum(n) AS n_claims, count(*) AS n_values, arg_min(value, (-conf, id, value)) AS value FROM v GROUP BY ALL),
  l AS (SELECT k, string_agg(value, ',' ORDER BY value) FILTER (WHERE kind = 'annotation') AS a, string_agg(value, ',' ORDER BY value) FILTER (WHERE kind = 'appreciation') AS p FROM v GROUP BY k),
  s AS (SELECT k, string_agg(src || ':' || loc || ':' || n, ',' ORDER BY src) AS sources FROM (SELECT k, src, min(loc) AS loc, count(*) AS n FROM c GROUP BY ALL) GROUP BY k)
  SELECT l.k AS l_orderkey, d.value AS date, CAST(coalesce(d.n_claims, 0) AS BIGINT) AS n_dates, p.value AS place, coalesce(p.n_values, 0) AS n_places, coalesce(a, '') AS annotations, coalesce(l.p, '') AS appreciations, sources,
    concat_ws(',', CASE WHEN d.n_values > 1 THEN 'date' END, CASE WHEN p.n_values > 1 THEN 'place' END) AS controversy, d.value IS NOT NULL AND p.value IS NOT NULL AND a IS NOT NULL AND l.p IS NOT NULL AS complete
  FROM l LEFT JOIN b d ON d.k = l.k AND d.kind = 'date' LEFT JOIN b p ON p.k = l.k AND p.kind = 'place' LEFT JOIN s ON s.k = l.k""")
def fact_packages(spark, sf_dir):
    """Order lines as claims about a work, put together as nested packages and told flat."""
    li, m = _t(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 4
    kind = F.when(m == 0, "date").when(m == 1, "place").when(m == 2, "annotation").otherwise("appreciation")
    note = F.when(F.col("l_quantity") > 45, " ").otherwise(F.col("l_returnflag"))
    value = F.when(m == 0, F.year("l_shipdate").cast("string")).when(m == 1, F.concat(F.lit("n"), (F.col("l_suppkey") % 5).cast("string"))).when(m == 2, note).otherwise(F.col("l_linestatus"))
    claims = li.select("l_orderkey", kind.alias("kind"), value.alias("value"), F.col("l_linenumber").alias("id"), F.col("l_discount").alias("conf"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("src"), F.col("l_partkey").alias("loc"))
    made = packages.packages(claims, "l_orderkey", "kind", "value", "id", "conf", "src", "loc", ["date", "place"], ["annotation", "appreciation"])
    told = F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["locator"], s["n"]))
    return made.select(
        "l_orderkey", F.col("composition.date.value").alias("date"), F.col("composition.date.n_claims").alias("n_dates"), F.col("composition.place.value").alias("place"), F.col("composition.place.n_values").alias("n_places"),
        F.array_join("notes.annotation", ",").alias("annotations"), F.array_join("notes.appreciation", ",").alias("appreciations"), F.array_join(told, ",").alias("sources"), F.array_join("controversy", ",").alias("controversy"), "complete",
    )


def _people(spark, sf_dir) -> DataFrame:
    """Customers as person records: two ways of wrapping, one address or a list of them, postings from their orders."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    address = lambda n: F.struct((F.col("c_nationkey") + n).cast("string").alias("AddrId"), F.concat(F.lit(" n"), F.col("c_nationkey") + n).alias("AddrName"), F.when(k % 5 == 0, "").otherwise(F.lit("700")).alias("FirstYear"))
    one, two = F.to_json(F.struct(address(0).alias("Address"))), F.to_json(F.struct(F.array(address(0), address(1)).alias("Address")))
    posts = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("PostingId"), F.col("o_orderstatus").alias("Office")))).alias("p"))
    rows = c.join(posts, "c_custkey", "left")
    basic = F.to_json(F.struct(F.struct(k.alias("PersonId"), F.col("c_name").alias("ChName"), (900 + k % 80).alias("IndexYear")).alias("BasicInfo")))
    inner = F.concat(F.substring(basic, F.lit(1), F.length(basic) - 1), F.lit(',"PersonAddresses":'), F.when(k % 3 == 0, two).otherwise(one), F.lit(',"PersonPostings":{"Posting":'), F.coalesce(F.to_json("p"), F.lit("[]")), F.lit("}}"))
    wrapped = F.when(k % 2 == 0, F.concat(F.lit('{"Package":{"PersonAuthority":{"PersonInfo":{"Person":'), inner, F.lit("}}}}"))).when(k % 7 == 0, F.lit("[1, 2")).otherwise(F.concat(F.lit('{"PersonInfo":{"Person":'), inner, F.lit("}}")))
    return readers.person_records(rows.select("c_custkey", wrapped.alias("json")), "c_custkey", "json")


@query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 <> 0), a AS (SELECT c_custkey, 0 AS place, n FROM c UNION ALL SELECT c_custkey, 1, n + 1 FROM c WHERE c_custkey % 3 = 0)
  SELECT c_custkey::VARCHAR AS person_id, c_name AS name, (900 + c_custkey % 80)::VARCHAR AS index_year, CAST(place AS INTEGER) AS place, a.n::VARCHAR AS address_id, 'n' || a.n AS address, CASE WHEN c_custkey % 5 <> 0 THEN '700' END AS first_year FROM c JOIN a USING (c_custkey)""")
def person_addresses(spark, sf_dir):
    people = _people(spark, sf_dir)
    lists = readers.person_lists(people, "c_custkey", "PersonAddresses", "Address", {"address_id": "AddrId", "address": "AddrName", "first_year": "FirstYear"})
    return people.select("c_custkey", "person_id", "name", "index_year").join(lists, "c_custkey").drop("c_custkey")


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderkey::VARCHAR AS posting_id, o_orderstatus AS office FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 OR c_custkey % 7 <> 0""")
def person_postings(spark, sf_dir):
    return readers.person_lists(_people(spark, sf_dir), "c_custkey", "PersonPostings", "Posting", {"posting_id": "PostingId", "office": "Office"})


@query("""WITH c AS (SELECT p_partkey AS i, p_brand AS g, p_size, p_retailprice AS q, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
  f AS (SELECT * FROM c WHERE n <= 4 ORDER BY q DESC, i LIMIT 24), k AS (SELECT g, count(*) AS n FROM f GROUP BY g), m AS (SELECT greatest(10 - count(*), 0) AS missing FROM f WHERE p_size <= 5),
  r AS (SELECT c.i, c.q, row_number() OVER (PARTITION BY c.g ORDER BY c.q DESC, c.i) AS p, coalesce(k.n, 0) AS held FROM c LEFT JOIN k ON k.g = c.g WHERE p_size <= 5 AND c.i NOT IN (SELECT i FROM f)),
  t AS (SELECT i, row_number() OVER (ORDER BY q DESC, i) AS n FROM r WHERE p <= 4 - held) SELECT i, CAST(1 AS INTEGER) AS pass FROM f UNION ALL SELECT i, 2 FROM t, m WHERE n <= missing""")
def picks_with_top_up(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("g"), "p_size", F.col("p_retailprice").alias("q"))
    return stylometry.capped_picks(parts, "i", "g", [F.desc("q"), "i"], 4, 24, F.col("p_size") <= 5, 10).select("i", "pass")


@query(f"""WITH e AS (SELECT source, unnest(regexp_extract_all(text, '({"|".join(sorted(L.NUMBERS, key=lambda w: (-len(w), w)))})')) AS w FROM documents), v(w, c, x) AS (VALUES {", ".join(f"('{w}', '{c}', {x}::DOUBLE)" for w, (c, x) in L.NUMBERS.items())}),
  g AS (SELECT source, count(*) AS hits, sum(x) AS weight, count(*) FILTER (WHERE c = 'single') AS a, count(*) FILTER (WHERE c = 'hundred') AS b FROM e JOIN v USING (w) GROUP BY source), s AS (SELECT source, sum(n_chars)::DOUBLE AS n FROM documents GROUP BY source)
  SELECT source, coalesce(hits, 0) AS hits, coalesce(weight, 0.0::DOUBLE) AS weight, round(coalesce(weight, 0) * 100 / n, 6) AS density, coalesce(a, 0) AS n_first, coalesce(b, 0) AS n_second, round(coalesce(a, 0)::DOUBLE / nullif(b, 0), 6) AS ratio FROM s LEFT JOIN g USING (source)""")
def intensity_density(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    table = F.create_map(*[v for w, (c, x) in L.NUMBERS.items() for v in (F.lit(w), F.struct(F.lit(c).alias("c"), F.lit(x).alias("x")))])
    hits = docs.select("source", F.explode(lexicon.leftmost_matches("text", list(L.NUMBERS))).alias("w")).withColumn("v", table[F.col("w")]).select("source", "v.c", "v.x")
    return stylometry.weighted_density(hits, docs.select("source", F.col("n_chars").cast("double").alias("n")), "source", "c", "x", "n", ("single", "hundred"))


@query("""WITH a AS (SELECT l_orderkey AS g, l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS to_id FROM lineitem) SELECT g, from_id, to_id FROM a WHERE to_id IS NOT NULL AND NOT (from_id % 3 = 0 AND to_id % 2 = 0)""")
def undocumented_transitions(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), "l_shipdate", "l_linenumber", F.col("l_partkey").alias("id"))
    every = joins.adjacent_pairs(rows, "g", ["l_shipdate", "l_linenumber", "id"], "id")
    return joins.adjacent_pairs(rows, "g", ["l_shipdate", "l_linenumber", "id"], "id", every.filter("from_id % 3 = 0 AND to_id % 2 = 0"))


@query("""WITH l AS (SELECT user_id AS k, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1) SELECT c_custkey, last_id, kind FROM customer LEFT JOIN l ON k = c_custkey""")
def last_row_lookup(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "ts", F.col("event_id").alias("last_id"), F.col("event_type").alias("kind"))
    found, missing = joins.last_lookup(_t(spark, sf_dir, "customer").select("c_custkey"), events, ["c_custkey"], ["ts", "last_id"], ["last_id", "kind"])
    return found.unionByName(missing, allowMissingColumns=True)


_ROUTE = """n AS (SELECT l_orderkey AS r, l_linenumber AS o, l_partkey AS node FROM lineitem WHERE l_discount <= 0.05), g AS (SELECT r, node AS f, lead(node) OVER (PARTITION BY r ORDER BY o, node) AS t, row_number() OVER (PARTITION BY r ORDER BY o, node) AS leg FROM n), legs AS (SELECT * FROM g WHERE t IS NOT NULL),
  s AS (SELECT r, CASE WHEN leg % 2 = 0 THEN f ELSE t END AS a, CASE WHEN leg % 2 = 0 THEN t ELSE f END AS b, CASE f % 4 WHEN 0 THEN 'by boat down the river' WHEN 1 THEN 'on horse and by boat' WHEN 2 THEN 'walked' ELSE 'somehow' END AS note FROM legs WHERE (f + t) % 3 <> 0),
  w AS (SELECT r, a AS f, b AS t, note, 'forward' AS direction FROM s UNION ALL SELECT r, b, a, note, 'reversed' FROM s), best AS (SELECT r, f, t, arg_min(note, (direction, note)) AS note, min(direction) AS direction FROM w GROUP BY ALL),
  told AS (SELECT legs.*, note, direction, CASE WHEN contains(note, 'boat') OR contains(note, 'river') THEN 'water' WHEN contains(note, 'horse') THEN 'horse' WHEN contains(note, 'walk') THEN 'foot' WHEN direction IS NOT NULL THEN 'unknown' END AS mode, nullif(CASE WHEN contains(note, 'boat') THEN 'boat' WHEN contains(note, 'horse') THEN 'horse' WHEN contains(note, 'walk') THEN 'walk' END, '') AS basis FROM legs LEFT JOIN best USING (r, f, t))"""
_TRANSPORT = [("water", "boat|river"), ("horse", "horse"), ("foot", "walk")]


def _routes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("node"), "l_discount")
    precise = F.col("l_discount") <= 0.05
    legs = promotion.route_legs(li, "r", "o", "node", precise)
    f, t, even = F.col("from_id"), F.col("to_id"), F.col("leg") % 2 == 0
    note = F.when(f % 4 == 0, "by boat down the river").when(f % 4 == 1, "on horse and by boat").when(f % 4 == 2, "walked").otherwise("somehow")
    ways = legs.filter("(from_id + to_id) % 3 <> 0").select("r", F.when(even, f).otherwise(t).alias("from_id"), F.when(even, t).otherwise(f).alias("to_id"), note.alias("note"))
    return promotion.assembled_routes(li.filter(precise), legs, ways, "r", "node", _TRANSPORT)


@query(f"WITH {_ROUTE} SELECT r, CAST(leg AS INTEGER) AS leg, f AS from_id, t AS to_id, note, direction, mode, basis FROM told")
def assembled_routes(spark, sf_dir):
    return _routes(spark, sf_dir)[0]


@query(f"""WITH {_ROUTE}, c AS (SELECT r, count(DISTINCT node) AS n_nodes FROM n GROUP BY r), m AS (SELECT r, mode, count(*) AS k FROM told GROUP BY ALL), x AS (SELECT r, string_agg(mode || ':' || k, ',' ORDER BY mode) FILTER (WHERE mode IS NOT NULL) AS modes FROM m GROUP BY r)
  SELECT r, n_nodes, (SELECT count(*) FROM told WHERE told.r = c.r) AS n_legs, (SELECT count(direction) FROM told WHERE told.r = c.r) AS n_documented, coalesce(modes, '') AS modes FROM c LEFT JOIN x USING (r)""")
def route_counts(spark, sf_dir):
    told = F.array_join(F.transform(F.map_entries("n_by_mode"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return _routes(spark, sf_dir)[1].withColumn("modes", told).drop("n_by_mode")


@query("""WITH m AS (SELECT doc_id, 't' || toxic AS label, 'rules' AS method FROM labels UNION SELECT doc_id, 'q' || quality, 'llm' FROM labels WHERE quality = 1)
  SELECT d.doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(string_agg(DISTINCT method, ',' ORDER BY method), '') AS methods FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""")
def hits_with_methods(spark, sf_dir):
    h = _t(spark, sf_dir, "labels")
    m = h.select("doc_id", F.concat(F.lit("t"), "toxic").alias("label"), F.lit("rules").alias("method")).unionByName(h.filter("quality = 1").select("doc_id", F.concat(F.lit("q"), "quality").alias("label"), F.lit("llm").alias("method"))).withColumn("line_no", F.lit(1))
    hits = _t(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("line_no"))
    return search.with_mentions(hits, m, method="method").select("doc_id", F.array_join("labels", ",").alias("labels"), F.array_join("methods", ",").alias("methods"))


@query("""WITH q AS (SELECT list_transform(embedding::DOUBLE[], lambda x: x) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE label IN (1, 2, 3) AND vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
  r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM s) SELECT vec_id, score, CAST(place AS INTEGER) AS place FROM r WHERE place BETWEEN 6 AND 15""")
def vector_filtered_page(spark, sf_dir):
    """The second page of the best vectors of some labels whose documents are of quality; both filters hold before anything is scored."""
    e = _t(spark, sf_dir, "embeddings")
    query_vector = [float(x) for x in e.filter("vec_id = 0").select("embedding").first()[0]]
    tags = _t(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return search.vector_top_k(e, query_vector, 10, where=F.col("label").isin(1, 2, 3), tags=tags, offset=5).drop("relevance")


_PROBE = """k AS (SELECT c_custkey AS k, 'c' || c_custkey AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'tang' ELSE 'song' END AS era, CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 10 END AS seed FROM customer),
  i AS (SELECT *, CASE WHEN k % 5 <> 4 AND k % 8 <> 3 THEN k * 10 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END END AS a, CASE WHEN k % 5 <> 4 AND k % 3 <> 0 AND k > 0 THEN CASE WHEN k % 7 = 0 THEN k * 10 + 5 ELSE k * 10 END END AS b FROM k),
  p AS (SELECT *, list_distinct(list_filter([a, b], lambda x: x IS NOT NULL)) AS ids, k % 9 = 0 AND k % 5 <> 4 AS nothing FROM i),
  r AS (SELECT *, CASE WHEN len(ids) > 1 THEN 'identity_ambiguous' WHEN len(ids) = 1 AND nothing THEN 'needs_disambiguation' WHEN seed IS NOT NULL THEN 'audited_seed' WHEN len(ids) = 1 THEN 'probe_unique' ELSE 'name_query' END AS status FROM p),
  reg AS (SELECT k, owner, era, status, CASE WHEN status = 'identity_ambiguous' THEN NULL WHEN status = 'needs_disambiguation' THEN ids[1] ELSE coalesce(seed, ids[1]) END AS author_id, array_to_string(list_sort(ids), ',') AS candidates, CASE WHEN status IN ('identity_ambiguous', 'needs_disambiguation') THEN seed END AS stale FROM r)"""


def _registry(spark, sf_dir) -> DataFrame:
    k, text = F.col("c_custkey"), lambda x: x.cast("string")
    era, other = F.when(k % 2 == 0, "tang").otherwise("song"), F.when(k % 2 == 0, "song").otherwise("tang")
    owner = F.concat(F.lit("c"), text(k))
    c = _t(spark, sf_dir, "customer")
    owners = c.select(owner.alias("owner"), era.alias("era"), F.when(k % 6 == 0, k * 10).alias("seed_id"))
    ids = F.array(F.when(k % 8 == 3, "bad").otherwise(text(k * 10 + F.when(k % 12 == 0, 1).otherwise(0))), text(F.when(k % 7 == 0, k * 10 + 5).otherwise(k * 10)), F.lit("77"))
    probes = c.filter("c_custkey % 5 <> 4").select(
        owner.alias("owner"), F.lit(1).alias("probe_no"), F.array(owner, F.concat(owner, F.lit(" ")), F.lit("someone")).alias("names"), ids.alias("ids"), F.array(era, F.when(k % 3 == 0, other).otherwise(era), era).alias("source_eras"),
        F.when(k % 9 == 0, 0).otherwise(20).alias("page_size"), F.lit(0).alias("n_records"),
    )
    return registry.probed(owners, probes, {"tang": ["tang"], "song": ["song"]})


@query(f"WITH {_PROBE} SELECT owner, status, CAST(author_id AS BIGINT) AS author_id, candidates, coalesce(stale::VARCHAR, '') AS stale FROM reg")
def registry_probes(spark, sf_dir):
    ids = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return _registry(spark, sf_dir).select("owner", "status", "author_id", ids("candidate_ids").alias("candidates"), ids("stale_ids").alias("stale"))


@query(f"""WITH {_PROBE}, f AS (SELECT 'c' || o_custkey AS owner, o_orderkey AS n, o_custkey * 10 + CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'song' ELSE 'tang' END AS e, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 't' || o_orderkey END AS seen FROM orders),
  g AS (SELECT f.*, status, author_id FROM f JOIN reg USING (owner) WHERE seen <> '' AND e = era AND id > 0), w AS (SELECT *, coalesce(author_id, first_value(id) OVER (PARTITION BY owner ORDER BY n)) AS own FROM g),
  x AS (SELECT owner, any_value(own) AS own, arg_max(seen, n) FILTER (WHERE id = own) AS seen, arg_max(id, n) FILTER (WHERE id <> own) AS other FROM w GROUP BY owner)
  SELECT owner, CASE WHEN status IN ('identity_ambiguous', 'needs_disambiguation', 'audited_seed') OR seen IS NULL THEN status ELSE 'discovered' END AS status, CAST(CASE WHEN status IN ('identity_ambiguous', 'needs_disambiguation') OR seen IS NULL THEN author_id ELSE own END AS BIGINT) AS author_id,
    CASE WHEN status NOT IN ('identity_ambiguous', 'needs_disambiguation') THEN seen END AS verified_at, CAST(CASE WHEN status NOT IN ('identity_ambiguous', 'needs_disambiguation') THEN other END AS BIGINT) AS discovery_conflict FROM reg LEFT JOIN x USING (owner)""")
def registry_discoveries(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    owner = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    found = o.select(owner.alias("owner"), k.alias("n"), (F.col("o_custkey") * 10 + F.when(k % 11 == 0, 3).otherwise(0)).alias("author_id"), owner.alias("verified_name"), F.when(k % 5 == 0, "song").otherwise("tang").alias("verified_era"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("verified_at"))
    return registry.discovered(_registry(spark, sf_dir), found).select("owner", "status", "author_id", "verified_at", "discovery_conflict")


@query("""WITH l AS (SELECT 'n' || n_nationkey AS name, 600 + n_regionkey * 100 AS low, 720 + n_regionkey * 100 AS high FROM nation), p AS (SELECT s_suppkey AS person, 'n' || s_nationkey AS pri, 'n' || (s_suppkey * 7 % 25) AS alias, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 500 + s_suppkey * 13 % 700 END AS s, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 520 + s_suppkey * 13 % 700 END AS e, [500 + s_suppkey * 29 % 600, 520 + s_suppkey * 17 % 650] AS ys FROM supplier),
  m AS (SELECT name, person, CAST(coalesce(coalesce(s, e) <= high AND coalesce(e, s) >= low, false) AS INTEGER) AS o, len(list_filter(ys, lambda y: y BETWEEN low AND high)) AS d, CAST(name = pri AS INTEGER) AS a, CAST(name = alias AS INTEGER) AS b FROM l JOIN p ON name = pri OR name = alias),
  z AS (SELECT name, person, 100 * o + 10 * d + 3 * a + b AS sc, o > 0 OR d > 0 AS fit FROM m), t AS (SELECT name, sc, count(*) AS n, min(person) AS p FROM z WHERE fit GROUP BY ALL), best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY sc DESC) = 1),
  ov AS (SELECT 'n3' AS name, min(person) AS bound FROM p WHERE pri = 'n3'), q AS (SELECT l.name, sc, n, p, bound, (SELECT max(z.sc) FROM z WHERE z.name = l.name AND z.person = bound) AS bsc FROM l LEFT JOIN best USING (name) LEFT JOIN ov USING (name)),
  w AS (SELECT *, CASE WHEN name = 'n5' THEN 'fixed_homonyms' WHEN bound IS NOT NULL THEN 'override' WHEN sc IS NULL THEN 'no_era_match' WHEN n > 1 THEN 'top_score_tie' ELSE 'unique_highest_score' END AS reason FROM q)
  SELECT name, reason, CAST(CASE reason WHEN 'override' THEN bound WHEN 'unique_highest_score' THEN p END AS BIGINT) AS person, CAST(CASE WHEN reason = 'override' THEN bsc WHEN reason IN ('unique_highest_score', 'top_score_tie') THEN sc END AS INTEGER) AS score FROM w""")
def identity_audit(spark, sf_dir):
    """Names of an era against persons with names, aliases, an own era and known years; one name bound by hand, one that stays ambiguous."""
    local = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), (600 + F.col("n_regionkey") * 100).alias("low"), (720 + F.col("n_regionkey") * 100).alias("high"))
    s, sup = F.col("s_suppkey"), _t(spark, sf_dir, "supplier")
    years = F.array((500 + s * 29 % 600).cast("int"), (520 + s * 17 % 650).cast("int"))
    people = sup.select(
        s.alias("person"), F.concat(F.lit("n"), "s_nationkey").alias("primary"), F.array(F.concat(F.lit("n"), s * 7 % 25)).alias("aliases"), F.when(s % 4 != 0, 500 + s * 13 % 700).cast("int").alias("low"), F.when(s % 6 != 0, 520 + s * 13 % 700).cast("int").alias("high"), years.alias("years")
    )
    bound = sup.filter("s_nationkey = 3").agg(F.min("s_suppkey")).first()[0]
    return linkage.identity_audit(local, people, {"n3": bound} if bound is not None else {}, {"n5": []}).drop("n_winners")


_ALIASES, _IMAGERY = ["the", "en", "der", "ontion", "de"], ["tion", "eau", "schaft", "ing"]
_SCORE = "CASE WHEN contains(c, 'the') OR contains(c, 'der') OR ends_with(c, 'en') OR ends_with(c, 'de') THEN 3 ELSE 0 END + " + " + ".join([f"2 * contains(c, '{a}')::INTEGER" for a in _ALIASES] + [f"contains(c, '{w}')::INTEGER" for w in _IMAGERY])


@query(rf"""WITH r AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'))) AS c, generate_subscripts(regexp_extract_all(text, '[^.!?;\n]*[.!?;]|[^.!?;\n]+'), 1) AS i FROM documents),
  k AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r WHERE c <> ''), s AS (SELECT *, {_SCORE} AS score FROM k WHERE length(c) BETWEEN 3 AND 44),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC) AS place FROM s QUALIFY place <= 3), h AS (SELECT doc_id, count(*) AS have FROM f GROUP BY doc_id),
  m AS (SELECT k.doc_id, k.c, min(k.n) AS n FROM k WHERE length(k.c) BETWEEN 2 AND 60 AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.c = k.c) GROUP BY ALL),
  p AS (SELECT m.*, coalesce(have, 0) + row_number() OVER (PARTITION BY m.doc_id ORDER BY n) AS place FROM m LEFT JOIN h USING (doc_id) WHERE coalesce(have, 0) < 2 QUALIFY place <= 2)
  SELECT doc_id, CAST(n AS INTEGER) AS clause_no, c AS clause, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM f UNION ALL SELECT doc_id, CAST(n AS INTEGER), c, NULL, CAST(place AS INTEGER) FROM p""")
def display_picks(spark, sf_dir):
    """The clauses of every document that are worth showing, filled up where there are too few."""
    return segment.display_picks(segment.split_clauses(_t(spark, sf_dir, "documents")), _ALIASES, _IMAGERY)


_PLACES = {"ontion": "p1", "schaft": "p2", "ción": "p3", "eau": "p4", "elle": "p4", "x": "p9"}
_SIGNS = {"spring": "th", "summer": "re", "autumn": "es", "winter": "en"}
_VALUES = {"tion": 0.5, "ing": 0.2, "ent": -0.4, "ier": 0.1, "der": -0.2, "und": 0.0, "ado": 0.3, "ing ": 0.7, "the ": -0.1, "an": 0.9, "en": -0.8, "re": 0.4, "er": 0.6}


def _place_sql() -> str:
    named = [(a, p) for a, p in _PLACES.items() if len(a) >= 2]
    words = ", ".join(f"{{'w': '{w}', 'v': {v}::DOUBLE}}" for w, v in _VALUES.items())
    signs = ", ".join(f"{{'s': '{s}', 'k': {i}, 'n': (length(text) - length(replace(text, '{w}', ''))) // {len(w)}}}" for i, (s, w) in enumerate(_SIGNS.items()))
    return f"""WITH d AS (SELECT doc_id, source, text, lang AS label, (n_chars % 21 - 10) / 10.0::DOUBLE AS valence, list_filter([{words}], lambda e: contains(text, e.w))[1:10] AS ws, [{signs}] AS ss FROM documents),
  a(alias, place) AS (VALUES {", ".join(str(x) for x in named)}), m AS (SELECT DISTINCT doc_id, place FROM d JOIN a ON contains(text, alias)), t AS (SELECT * FROM m JOIN d USING (doc_id)),
  s AS (SELECT place, count(*) AS mentions_n, count(DISTINCT source) AS owners_n, round(avg(CASE WHEN len(ws) > 0 THEN valence END), 3) AS mean_valence FROM t GROUP BY place),
  l AS (SELECT place, label, row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, label) AS r FROM t GROUP BY place, label), z0 AS (SELECT place, unnest(ss) AS x FROM t), z AS (SELECT place, x.s AS season, row_number() OVER (PARTITION BY place ORDER BY sum(x.n) DESC, x.k) AS r FROM z0 GROUP BY place, x.s, x.k HAVING sum(x.n) > 0),
  i0 AS (SELECT place, unnest(ws) AS e FROM t), i AS (SELECT place, e.w AS w, count(*) AS n, round(avg(e.v), 3) AS v FROM i0 GROUP BY place, e.w), j AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, w) AS r FROM i QUALIFY r <= 8), top AS (SELECT place, string_agg(w || ':' || n, ',' ORDER BY r) AS imagery FROM j GROUP BY place),
  c AS (SELECT 'p' || s_suppkey % 6 AS place, count(*) AS composed_n, min((s_suppkey % 50 + 80)::DOUBLE) AS lon FROM supplier WHERE s_suppkey % 3 <> 2 AND s_suppkey % 5 <> 0 GROUP BY 1)
  SELECT place, coalesce(c.lon, CASE WHEN place <> 'p2' THEN 100.5::DOUBLE END) AS lon, coalesce(composed_n, 0) AS composed_n, coalesce(mentions_n, 0) AS mentions_n, coalesce(owners_n, 0) AS owners_n, round(coalesce(composed_n, 0)::DOUBLE / (coalesce(composed_n, 0) + coalesce(mentions_n, 0)), 4) AS locality, mean_valence, label AS modal_label, season AS top_season, coalesce(imagery, '') AS imagery
  FROM c FULL JOIN s USING (place) LEFT JOIN (SELECT place, label FROM l WHERE r = 1) USING (place) LEFT JOIN (SELECT place, season FROM z WHERE r = 1) USING (place) LEFT JOIN top USING (place) WHERE coalesce(c.lon, CASE WHEN place IN ('p1', 'p3', 'p4') THEN 100.5 END) IS NOT NULL"""


@query(_place_sql())
def place_archives(spark, sf_dir):
    """Places named in all documents and placed works of suppliers, with imagery, mood, season and locality."""
    docs = _t(spark, sf_dir, "documents").select("source", "text", F.col("lang").alias("label"), ((F.col("n_chars") % 21 - 10) / 10.0).alias("valence"))
    s = F.col("s_suppkey")
    works = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), s % 6).alias("place"), F.when(s % 5 != 0, (s % 50 + 80).cast("double")).alias("lon"), F.lit(30.0).alias("lat"), F.when(s % 3 == 0, "A").when(s % 3 == 1, "B").otherwise("C").alias("grade"))
    gazetteer = spark.createDataFrame([("p1", 100.5, 30.0), ("p2", None, 30.0), ("p3", 100.5, 31.0), ("p4", 100.5, 32.0)], "place string, lon double, lat double")
    met = places.mentions(docs, _PLACES, _VALUES, _SIGNS, keep=["source", "label", "valence"])
    found = places.archives(met, works, gazetteer, "source", "valence", "label", list(_SIGNS))
    return found.withColumn("imagery", F.array_join(F.transform("imagery", lambda e: F.concat_ws(":", e["word"], e["n"])), ",")).drop("lat")


@query("""WITH r AS (SELECT c_custkey AS k FROM customer), c AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'event' ELSE 'work' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'unlinked' WHEN 1 THEN 'ambiguous' ELSE 'linked' END AS link, year(o_orderdate) AS y, 'n' || o_orderkey % 5 AS place, o_orderpriority AS src FROM orders),
  w AS (SELECT o_custkey AS k, year(o_orderdate) AS a, year(o_orderdate) + 1 AS b, 'n' || o_orderkey % 4 AS wp FROM orders WHERE o_orderkey % 10 = 0), v AS (SELECT * FROM c WHERE kind = 'work' AND link = 'linked'),
  g AS (SELECT v.k, v.id, bool_or(coalesce(y BETWEEN a AND b, false)) AS inside, bool_or(coalesce(y BETWEEN a AND b AND place <> wp, false)) AS other FROM v LEFT JOIN w ON w.k = v.k GROUP BY ALL)
  SELECT k AS c_custkey, (SELECT count(*) FROM w WHERE w.k = r.k) AS reviewed_nodes, (SELECT count(*) FROM c WHERE c.k = r.k AND y < 1998) AS chronology_rows, (SELECT count(*) FROM c WHERE c.k = r.k AND kind = 'event') AS new_events,
    (SELECT count(*) FROM v WHERE v.k = r.k) AS linked_works, (SELECT count(*) FROM c WHERE c.k = r.k AND kind = 'work' AND link = 'unlinked') AS unlinked_works, (SELECT count(*) FROM c WHERE c.k = r.k AND kind = 'work' AND link = 'ambiguous') AS ambiguous_works,
    (SELECT count(*) FROM c WHERE c.k = r.k AND (kind = 'event' OR link = 'linked')) AS reviewable, (SELECT count(*) FROM g WHERE g.k = r.k AND other) AS conflicts, (SELECT count(*) FROM g WHERE g.k = r.k AND NOT inside) AS gaps,
    coalesce((SELECT string_agg(src || ':' || n, ',' ORDER BY src) FROM (SELECT src, count(*) AS n FROM c WHERE c.k = r.k GROUP BY src)), '') AS sources FROM r""")
def journey_reports(spark, sf_dir):
    """Orders as candidates of their customers: what can be reviewed, what conflicts with reviewed windows, where windows are missing."""
    o, k = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), F.col("o_orderkey")
    year, link = F.year("o_orderdate"), F.when(k % 4 == 0, "unlinked").when(k % 4 == 1, "ambiguous").otherwise("linked")
    candidates = o.select("c_custkey", k.alias("id"), F.when(k % 3 == 0, "event").otherwise("work").alias("kind"), link.alias("link"), year.alias("year"), F.concat(F.lit("n"), k % 5).alias("place"), F.col("o_orderpriority").alias("source"))
    windows = o.filter("o_orderkey % 10 = 0").select("c_custkey", year.alias("win_start"), (year + 1).alias("win_end"), F.concat(F.lit("n"), k % 4).alias("win_place"))
    told = report.journey_report(_t(spark, sf_dir, "customer"), "c_custkey", windows, candidates.filter("year < 1998"), windows, candidates)
    return told.withColumn("sources", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@query("""SELECT o_orderkey, 'By checked sources ' || o_orderstatus || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' about ' ELSE ' in ' END || year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' || (year(o_orderdate) + 1) END || ' at old n' || o_custkey % 9 || ', now ' || CASE WHEN o_custkey % 2 = 0 THEN 'r1 n' ELSE 'r1n' END || o_custkey % 9 || '.' AS sentence FROM orders""")
def fact_sentences(spark, sf_dir):
    o, k, c = _t(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        "o_orderkey", F.concat("o_orderstatus", k).alias("title"), F.year("o_orderdate").alias("a"), (F.year("o_orderdate") + F.when(k % 3 == 0, 0).otherwise(1)).alias("b"), (k % 2 == 0).alias("approx"),
        F.concat(F.lit("old n"), c % 9).alias("h"), F.lit("r1").alias("p"), F.when(c % 2 == 0, F.concat(F.lit("r1 n"), c % 9)).otherwise(F.concat(F.lit("n"), c % 9)).alias("m"),
    )
    words = {"sentence": "By checked sources {title}{verb}{years} at {historical}, now {modern}.", "exact": " in ", "about": " about ", "between": "-"}
    return rows.select("o_orderkey", report.fact_sentence("title", "a", "b", "approx", "h", "p", "m", words).alias("sentence"))


@query("""SELECT event_type, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(sum(CASE WHEN value > 10 THEN user_id ELSE 0 END) AS BIGINT) AS used FROM events GROUP BY event_type""")
def usage_sums(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.when(F.col("value") > 10, F.col("user_id")).alias("used"))
    return report.usage_sums(e, "event_type", ["k", "used"])
