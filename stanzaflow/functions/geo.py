"""Coordinates, distances, years and paths as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, table_of

EARTH_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid_point(lon, lat, west: float = -180, east: float = 180, south: float = -90, north: float = 90) -> Column:
    """Both given, finite, inside the box, and not the (0, 0) that stands for unknown."""
    x, y = _c(lon).try_cast("double"), _c(lat).try_cast("double")
    inside = x.between(west, east) & y.between(south, north) & ~F.isnan(x) & ~F.isnan(y) & ~((x == 0) & (y == 0))
    return F.coalesce(inside, F.lit(False))


def score_decay(km, hint=1.0, best: float = 5000, scale: float = 300) -> Column:
    """Points for a guess that is so far off."""
    return F.round(F.lit(best) * F.exp(-_c(km) / scale) * (hint if isinstance(hint, Column) else F.lit(hint)))


def year_range(x) -> Column:
    """``struct<low, high, approximate>`` of the 3- and 4-digit years in a text; nulls if there are none."""
    text = F.coalesce(_c(x).cast("string"), F.lit(""))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("low"), F.array_max(years).alias("high"), text.rlike(r"(?i)\b(?:ca?\.|circa|about)|约|約|前后|左右|\?").alias("approximate"))


def era_year(name, number, eras: dict[str, tuple[int, int]]) -> Column:
    """Year of a reign: its first year plus the number less one, null beyond its last year."""
    first = F.create_map(*[v for n, (a, _) in eras.items() for v in (F.lit(n), F.lit(a))])
    last = F.create_map(*[v for n, (_, b) in eras.items() for v in (F.lit(n), F.lit(b))])
    year = F.element_at(first, _c(name)) + _c(number) - 1
    return F.when((_c(number) >= 1) & (year <= F.element_at(last, _c(name))), year)


def han_number(x) -> Column:
    """A numeral below one hundred in Chinese digits, ``元`` as 1, ``廿`` as 20 and ``卅`` as 30; null for what is no such numeral."""
    digits = "一二三四五六七八九"
    text = _c(x)
    for short, long in (("元", "一"), ("廿", "二十"), ("卅", "三十"), ("^十", "一十")):
        text = F.regexp_replace(text, short, long)
    value = lambda pattern: F.instr(F.lit(digits), F.regexp_extract(text, pattern, 1))
    number = F.when(F.contains(text, F.lit("十")), value("^(.)十")).otherwise(0) * 10 + F.when(text.rlike(f"[{digits}]$"), value("(.)$")).otherwise(0)
    return F.when(text.rlike(f"^(?:[{digits}]十)?[{digits}]?$") & (text != ""), number)


# fixed values: bounds of a year, the longest reign number, and the longest reign that stands for a range
FIRST_YEAR, LAST_YEAR, LONGEST_NUMBER, LONGEST_REIGN = 500, 2000, 40, 15


def year_of(x, patterns: list[str], eras: dict[str, tuple[int, int]]) -> Column:
    """``struct<low, high, precision>`` of the year a text speaks of, null if it names none.

    In order: the first of the ``patterns`` (one group each) that gives a year within bounds; the only 3- or 4-digit year within bounds;
    a reign and its year number; the first or last years of a reign; a reign short enough to be a range.
    """
    text = F.coalesce(_c(x).cast("string"), F.lit(""))
    names = "|".join(sorted((f"\\Q{n}\\E" for n in eras), key=len, reverse=True))
    table = table_of({n: {"low": a, "high": b} for n, (a, b) in eras.items()}, "map<string,struct<low:int,high:int>>")
    found = lambda low, high, kind: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(kind).alias("precision"))
    bounded = lambda y: y.between(FIRST_YEAR, LAST_YEAR)
    steps = []
    for pattern in patterns:
        y = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
        steps.append(F.when(bounded(y), found(y, y, "approximate")))
    years = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), F.lit(1)), lambda y: y.cast("int")), bounded))
    steps.append(F.when(F.size(years) == 1, found(F.get(years, F.lit(0)), F.get(years, F.lit(0)), "approximate")))
    if eras:
        # mentions of a reign with what stands behind it: a numbered year, the first or last years, or all of its years
        tail = "[元一二三四五六七八九十廿卅]+\\s*[年載载]|年?\\s*[初末间間]"
        mentions = F.regexp_extract_all(text, F.lit(f"((?:{names})\\s*(?:{tail}))"), F.lit(1))
        name = lambda m: F.regexp_extract(m, f"^({names})", 1)
        told = F.transform(mentions, lambda m: F.struct(F.element_at(table, name(m)).alias("reign"), F.regexp_replace(m, f"^(?:{names})\\s*", "").alias("tail")))
        first = lambda pattern: F.get(F.filter(told, lambda t: t["tail"].rlike(pattern)), F.lit(0))

        def of_number(t: Column) -> Column:
            n = han_number(F.regexp_replace(t["tail"], "\\s*[年載载]$", ""))
            year = t["reign"]["low"] + n - 1
            return F.when(n.between(1, LONGEST_NUMBER) & (year <= t["reign"]["high"] + 1), found(year, year, "era_year"))

        def of_edge(t: Column) -> Column:
            low, high = t["reign"]["low"], t["reign"]["high"]
            return F.when(F.endswith(t["tail"], F.lit("初")), found(low, low + 2, "era_early")).when(F.endswith(t["tail"], F.lit("末")), found(high - 2, high, "era_late"))

        def of_span(t: Column) -> Column:
            low, high = t["reign"]["low"], t["reign"]["high"]
            return F.when(high - low <= LONGEST_REIGN, found(low, high, "era_range"))

        steps += [let(first("^[^年初末间間]"), of_number), let(first("[初末]$"), of_edge), let(first("[间間]$"), of_span)]
    return F.coalesce(*steps)


def nominal_age(year, birth) -> Column:
    """Age counted from one at birth."""
    return _c(year) - _c(birth) + 1


def overlaps(start1, end1, start2, end2, open_years: int = 1_000_000_000) -> Column:
    """Closed intervals that share a year; a null end is open."""
    low = lambda c: F.coalesce(_c(c), F.lit(-open_years))
    high = lambda c: F.coalesce(_c(c), F.lit(open_years))
    return (low(start1) <= high(end2)) & (low(start2) <= high(end1))


def fnv1a(x) -> Column:
    """32-bit FNV-1a over the code points of a text, as an unsigned number."""
    text = _c(x)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def bezier_path(x1, y1, x2, y2, bend_sign, points: int = 28, bend: float = 0.12) -> Column:
    """``array<struct<t, x, y>>`` along a quadratic curve whose middle is off the straight line by a share of its length."""
    cx = (_c(x1) + _c(x2)) / 2 - (_c(y2) - _c(y1)) * bend * _c(bend_sign)
    cy = (_c(y1) + _c(y2)) / 2 + (_c(x2) - _c(x1)) * bend * _c(bend_sign)

    def at(i):
        t = i / F.lit(float(points - 1))
        along = lambda a, c, b: (1 - t) * (1 - t) * _c(a) + 2 * (1 - t) * t * c + t * t * _c(b)
        return F.struct(t.alias("t"), along(x1, cx, x2).alias("x"), along(y1, cy, y2).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def ease_in_out_cubic(t) -> Column:
    return F.when(_c(t) < 0.5, 4 * F.pow(_c(t), F.lit(3))).otherwise(1 - F.pow(-2 * _c(t) + 2, F.lit(3)) / 2)


KM_PER_DEGREE = math.pi * EARTH_KM / 180
