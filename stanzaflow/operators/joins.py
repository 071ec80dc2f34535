"""Joins beyond equality: intervals, bands, nearest rows, clusters, ordered fall-backs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, KM_PER_DEGREE, haversine_km, overlaps
from .order import carried


def band_join(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, width: int) -> DataFrame:
    """Rows with equal ``key`` whose values differ by at most ``width``.

    Both sides are cut into bins of the band's width and the left is sent to three bins, so the
    join is an equality on (key, bin): a heavy key is spread over its bins and only neighbours meet.
    """
    size = max(1, width)
    a = left.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(left_value) / size) + d)))
    b = right.withColumn("_bin", F.floor(F.col(right_value) / size))
    return a.join(b, [key, "_bin"]).filter(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("_bin")


def interval_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bin_size: int) -> DataFrame:
    """Rows with equal ``key`` whose closed intervals overlap; each pair once.

    Intervals are cut into bins; a pair that shares several bins is kept in the first common one.  Ends must be given
    (use ``overlaps`` on a key join for open ends).
    """
    spread = lambda df, s, e, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size))))
    x = spread(left.filter(F.col(a[0]) <= F.col(a[1])), *a, "_bin")
    y = spread(right.filter(F.col(b[0]) <= F.col(b[1])), *b, "_bin")
    both = x.join(y, [key, "_bin"])
    first = F.greatest(F.floor(F.col(a[0]) / bin_size), F.floor(F.col(b[0]) / bin_size))
    return both.filter(overlaps(*a, *b) & (F.col("_bin") == first)).drop("_bin")


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_value: str, right_value: str, right_id: str, width: int | None = None) -> DataFrame:
    """For each left row the right row of its key whose value is nearest; ties go to the smallest right value's id.

    The candidates are the last right row that isn't behind and the first that isn't before: values carried over the union of both
    sides in rising and in falling order, so no pairs are made and a key of any size is spread over many tasks.  With ``width``, rows
    further off are no candidates; rows without a key or value have no nearest one.
    """
    best = right.filter(F.col(key).isNotNull() & F.col(right_value).isNotNull()).groupBy(key, F.col(right_value).alias("_t")).agg(F.min(right_id).alias("_id"))
    both = left.filter(F.col(key).isNotNull() & F.col(left_value).isNotNull()).select(key, left_id, F.col(left_value).alias("_t"), F.lit(1).alias("_side")).unionByName(
        best.select(key, "_t", F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    up = carried(both, [key], ["_t", "_side"], {"_a": F.col("_v")})
    found = carried(up, [key], [F.desc("_t"), F.asc("_side")], {"_b": F.col("_v")}).filter("_side = 1")
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("_t")).alias("distance"), F.col(f"{c}.id").alias("id")))
    one = found.select(left_id, F.array_min(F.array_compact(F.array(entry("_a"), entry("_b")))).alias("_n"))
    out = one.filter("_n is not null").select(left_id, F.col("_n.id").alias(right_id), F.col("_n.distance").alias("distance"))
    return out if width is None else out.filter(F.col("distance") <= width)


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The dyadic blocks ``struct<level, block>`` that make up the whole numbers from ``low`` to ``high``, two of a level at most."""
    start = F.struct(low.alias("lo"), (high + 1).alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        go = lo < hi
        odd_lo, odd_hi = go & (lo % 2 == 1), go & (hi % 2 == 1) & ~((lo % 2 == 1) & (lo + 1 >= hi))
        block = lambda b: F.struct(level.cast("int").alias("level"), b.alias("block"))
        out = F.when(odd_lo, F.array_append(acc["out"], block(lo))).otherwise(acc["out"])
        out = F.when(odd_hi, F.array_append(out, block(hi - 1))).otherwise(out)
        up = lambda x: F.shiftright(x, 1)
        return F.struct(up(F.when(odd_lo, lo + 1).otherwise(lo)).alias("lo"), up(hi).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["out"]


def nearest_interval(rows: DataFrame, spans: DataFrame, key: str, row_id: str, value: str, span: tuple[str, str], span_id: str) -> DataFrame:
    """For each row the interval of its key that holds its value, else the one least far off; ties go to the smallest id.

    ``row_id, span_id, inside, distance``.  Values and ends are whole numbers; intervals are closed, and those without an end or with ends the
    wrong way round count for nothing.  Which interval holds a value changes at borders only.  Each border is looked up among the intervals cut into
    blocks whose lengths are powers of two (a border lies in one block of each length, so equal blocks are joined, not intervals), and the
    rows get the last border before them, the last end before them and the first start behind them as values carried in order.
    """
    own = spans.select(F.col(key).alias("_k"), F.col(span[0]).cast("bigint").alias("_s"), F.col(span[1]).cast("bigint").alias("_e"), F.col(span_id).alias("_id")).filter("_k is not null and _s <= _e")
    range_ = own.agg(F.min("_s").alias("low"), F.max("_e").alias("high")).first()
    low = range_["low"] or 0
    levels = max(1, ((range_["high"] or 0) + 2 - low).bit_length())
    cut = own.select("_k", "_id", F.explode(_blocks(F.col("_s") - low, F.col("_e") - low, levels)).alias("b")).groupBy("_k", "b.level", "b.block").agg(F.min("_id").alias("_id"))
    borders = own.select("_k", F.explode(F.array(F.col("_s"), F.col("_e") + 1)).alias("_t")).distinct()
    looked = borders.select("_k", "_t", F.posexplode(F.sequence(F.lit(0), F.lit(levels))).alias("level", "_l")).select("_k", "_t", "level", F.expr("shiftright(_t - {0}, level)".format(low)).alias("block"))
    held = looked.join(cut, ["_k", "level", "block"], "left").groupBy("_k", "_t").agg(F.min("_id").alias("_inside"))
    ends = own.groupBy("_k", (F.col("_e") + 1).alias("_t")).agg(F.min("_id").alias("_end"))
    starts = own.groupBy("_k", F.col("_s").alias("_t")).agg(F.min("_id").alias("_start"))
    marks = held.join(ends, ["_k", "_t"], "left").join(starts, ["_k", "_t"], "left")
    marks = marks.select(
        "_k", "_t", F.lit(0).alias("_side"), F.struct(F.col("_inside").alias("id")).alias("_in"), F.when(F.col("_end").isNotNull(), F.struct((F.col("_t") - 1).alias("t"), F.col("_end").alias("id"))).alias("_before"),
        F.when(F.col("_start").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_start").alias("id"))).alias("_behind"),
    )
    points = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("bigint").alias("_t"), F.lit(1).alias("_side"), F.col(row_id).alias("_row"))
    both = points.unionByName(marks, allowMissingColumns=True)
    up = carried(both, ["_k"], ["_t", "_side"], {"_now": F.col("_in"), "_last": F.col("_before")})
    found = carried(up, ["_k"], [F.desc("_t"), F.asc("_side")], {"_next": F.col("_behind")}).filter("_side = 1")
    off = lambda c, d: F.when(F.col(c).isNotNull(), F.struct(F.lit(True).alias("outside"), d.alias("distance"), F.col(f"{c}.id").alias("id")))
    inside = F.when(F.col("_now.id").isNotNull(), F.struct(F.lit(False).alias("outside"), F.lit(0).cast("bigint").alias("distance"), F.col("_now.id").alias("id")))
    best = F.array_min(F.array_compact(F.array(inside, off("_last", F.col("_t") - F.col("_last.t")), off("_next", F.col("_next.t") - F.col("_t")))))
    out = found.select(F.col("_row").alias(row_id), best.alias("b")).filter("b is not null")
    return out.select(row_id, F.col("b.id").alias(span_id), (~F.col("b.outside")).alias("inside"), "b.distance")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the latest right row of its key that isn't later: a union and a value carried on in order, no range join.

    Of several right rows of one time the greatest values count.  A key of any size is spread over many tasks.
    """
    mark = F.struct(*[F.col(v) for v in values])
    latest = right.groupBy(key, F.col(right_time).alias("_t")).agg(F.max(mark).alias("_v")).withColumn("_side", F.lit(0))
    both = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).unionByName(latest, allowMissingColumns=True)
    told = carried(both, [key], ["_t", "_side"], {"_last": F.col("_v")})
    return told.filter("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def within_km(points: DataFrame, id_col: str, km: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``id, n_near``: how many other points lie within a distance.

    The globe is cut into latitude bands as high as the distance, and each band into cells at least as wide as
    the distance is anywhere in the band or its neighbours (next to a pole a band is one cell).  A point meets the
    points of its own and the neighbouring cells only, by an equality join.  Points of one place meet the others as one.
    """
    step = km / KM_PER_DEGREE
    last = int(180 // step)

    def n_cells(band):
        edge = F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)) + step
        width = step / F.cos(F.radians(F.least(edge, F.lit(89.0))))
        return F.when(edge < 89, F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))).otherwise(F.lit(1)).cast("int")

    def cell(x, band):
        return F.least(F.floor((x + 180) / (F.lit(360.0) / n_cells(band))).cast("int"), n_cells(band) - 1)

    band = F.floor((F.col("_y") + 90) / step).cast("int")
    own = points.select(F.col(id_col), F.col(lon).alias("_x"), F.col(lat).alias("_y"))
    here = own.groupBy("_x", "_y").agg(F.count(id_col).alias("_n")).withColumn("_band", band)
    right = here.select(F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), "_n", "_band", cell(F.col("_x"), F.col("_band")).alias("_cell"))
    bands = here.drop("_n").withColumn("_band", F.explode(F.sequence(F.greatest(F.col("_band") - 1, F.lit(0)), F.least(F.col("_band") + 1, F.lit(last)))))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("_x"), F.col("_band")) + d, n_cells(F.col("_band")))))
    left = bands.withColumn("_cell", F.explode(around))
    near = left.join(right, ["_band", "_cell"]).filter(haversine_km("_x", "_y", "_ox", "_oy") <= km).groupBy("_x", "_y").agg(F.sum("_n").alias("_n"))
    # every row of a place finds the same ones; rows of the point itself don't count
    found = own.join(near, ["_x", "_y"]).groupBy(id_col).agg(F.sum("_n").alias("_n"))
    same = own.join(own.select(id_col, F.col("_x").alias("_ox"), F.col("_y").alias("_oy")), id_col).filter(haversine_km("_x", "_y", "_ox", "_oy") <= km).groupBy(id_col).agg(F.count("*").alias("_own"))
    counts = found.join(same, id_col).select(id_col, (F.col("_n") - F.col("_own")).alias("n_near"))
    return points.select(id_col).join(counts, id_col, "left").select(id_col, F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))


def cluster_diameter(points: DataFrame, group: str, id_col: str, lon: str, lat: str) -> DataFrame:
    """``group, n, diameter``: the largest distance between two points of each group (0 for one point).

    Points of one place count once.  The outermost points in six directions give a lower bound.  A point at the angle r from
    the group's middle is no further than r + R from any other, R being the largest angle; where that is below the bound
    the point can't be an end of the diameter, so only points near the rim are compared with each other.
    """
    x, y = F.radians("_x"), F.radians("_y")
    own = points.select(group, F.col(lon).alias("_x"), F.col(lat).alias("_y")).distinct()
    vec = own.select(group, "_x", "_y", (F.cos(y) * F.cos(x)).alias("_a"), (F.cos(y) * F.sin(x)).alias("_b"), F.sin(y).alias("_c"))
    place = F.struct("_x", "_y")
    outer = vec.groupBy(group).agg(F.array(*[f(place, k) for f in (F.max_by, F.min_by) for k in ("_a", "_b", "_c")]).alias("_o"), *[F.avg(k).alias(f"_m{k}") for k in ("_a", "_b", "_c")])
    apart = F.flatten(F.transform("_o", lambda p: F.transform("_o", lambda q: haversine_km(p["_x"], p["_y"], q["_x"], q["_y"]))))
    mid = outer.select(group, F.array_max(apart).alias("_low"), "_m_a", "_m_b", "_m_c")
    norm = F.sqrt(F.col("_m_a") * F.col("_m_a") + F.col("_m_b") * F.col("_m_b") + F.col("_m_c") * F.col("_m_c"))
    cosine = (F.col("_a") * F.col("_m_a") + F.col("_b") * F.col("_m_b") + F.col("_c") * F.col("_m_c")) / norm
    angle = F.when(norm > 1e-9, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).otherwise(F.lit(math.pi))
    placed = vec.join(mid, group).select(group, "_x", "_y", "_low", angle.alias("_r"))
    far = placed.groupBy(group).agg(F.max("_r").alias("_far"))
    rim = placed.join(far, group).filter((F.col("_r") + F.col("_far")) * EARTH_KM >= F.col("_low") - 0.001)
    pairs = rim.select(group, "_x", "_y").join(rim.select(group, F.col("_x").alias("_ox"), F.col("_y").alias("_oy")), group)
    wide = pairs.groupBy(group).agg(F.max(haversine_km("_x", "_y", "_ox", "_oy")).alias("diameter"))
    sizes = points.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.join(wide, group, "left").withColumn("diameter", F.round(F.coalesce("diameter", F.lit(0.0)), 3))


def first_available(requests: DataFrame, sources: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Each request with the values of the first source, in order, that has its keys; ``source_no`` tells which."""
    listed = None
    for k, s in enumerate(sources):
        own = s.select(*keys, *values).withColumn("source_no", F.lit(k + 1))
        listed = own if listed is None else listed.unionByName(own)
    best = listed.groupBy(*keys).agg(F.min(F.struct("source_no", *values)).alias("_b"))
    return requests.join(best, keys, "left").select(*requests.columns, "_b.source_no", *[F.col(f"_b.{v}").alias(v) for v in values])


def adjacent_pairs(rows: DataFrame, group: str, order: list, id_col: str, documented: DataFrame | None = None) -> DataFrame:
    """``group, from_id, to_id``: each row with the next one of its group, without pairs that ``documented(group, from_id, to_id)`` tells of already."""
    nxt = F.lead(id_col).over(W.partitionBy(group).orderBy(*order))
    pairs = rows.withColumn("to_id", nxt).filter("to_id is not null").select(group, F.col(id_col).alias("from_id"), "to_id")
    return pairs if documented is None else pairs.join(documented, [group, "from_id", "to_id"], "left_anti")


def last_lookup(rows: DataFrame, others: DataFrame, keys: list[str], order: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each row with the ``values`` of the last row of ``others`` that has its keys, and the rows that have none.

    ``order`` is the total order in which a later row replaces an earlier one; keys are compared by equality, unknown ones fit nothing.
    """
    last = others.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    found = rows.join(last, keys, "left")
    return found.filter("_v is not null").select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values]), found.filter("_v is null").select(*rows.columns)
