"""Outlines: lines under headings of several levels, their properties, and records with nested people.

A heading ends every heading of its own or a deeper level.  For each level the last heading seen is carried from line to line over all
partitions (``order.carried``), and one counts as long as no higher heading came after it: a stack without walking the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import carried

STARS = r"^(\*+)\s+(.*)$"
PROPERTY = r"^\s*:([A-Za-z_]+):\s*(.*)$"


def star_level(text: str = "text") -> tuple[Column, Column]:
    """Level and title of a heading that begins with stars; nulls for other lines."""
    stars = F.regexp_extract(text, STARS, 1)
    heading = stars != ""
    return F.when(heading, F.length(stars)), F.when(heading, F.trim(F.regexp_extract(text, STARS, 2)))


def outline_tree(lines: DataFrame, file: str, line_no: str, text: str, level: Column | None = None, title: Column | None = None) -> DataFrame:
    """``lines`` with ``level`` (null for a line that is no heading) and ``path``: the headings around a line from the highest down, as structs of
    ``level, line_no, title``; a heading's path ends with itself.

    ``level`` and ``title`` tell headings from other lines, by default those that begin with stars.  Line numbers are unique in a
    file; levels may be left out (a third level right below a first) and any number deep.
    """
    own_level, own_title = star_level(text)
    marked = lines.withColumn("level", (own_level if level is None else level).cast("int")).withColumn("_title", own_title if title is None else title)
    levels = sorted(r[0] for r in marked.select("level").filter("level is not null").distinct().collect())  # as many as an outline is deep
    if not levels:
        return marked.drop("_title").withColumn("path", F.array().cast(f"array<struct<level:int,line_no:{lines.schema[line_no].dataType.simpleString()},title:string>>"))
    heading = F.struct("level", F.col(line_no).alias("line_no"), F.col("_title").alias("title"))
    last = carried(marked, [file], [line_no], {f"_h{n}": F.when(F.col("level") == n, heading) for n in levels})
    kept = []
    for i, n in enumerate(levels):
        fresh = F.lit(True)
        for higher in levels[:i]:
            fresh &= F.col(f"_h{higher}").isNull() | (F.col(f"_h{higher}.line_no") < F.col(f"_h{n}.line_no"))
        kept.append(F.when(fresh, F.col(f"_h{n}")))
    return last.withColumn("path", F.array_compact(F.array(*kept))).drop("_title", *[f"_h{n}" for n in levels])


def outline_properties(tree: DataFrame, file: str, line_no: str, text: str) -> DataFrame:
    """``file, heading_no, key, value``: the ``:KEY: value`` lines right under each heading, the first of a key."""
    key, value = F.regexp_extract(text, PROPERTY, 1), F.trim(F.regexp_extract(text, PROPERTY, 2))
    rows = tree.filter(F.col("level").isNull() & (key != "") & (F.size("path") > 0)).select(file, line_no, F.element_at("path", -1)["line_no"].alias("heading_no"), key.alias("key"), value.alias("value"))
    return rows.groupBy(file, "heading_no", "key").agg(F.min_by("value", line_no).alias("value"))


def nested_records(tree: DataFrame, file: str, line_no: str, text: str, record: int, people: str, category: int | None = None) -> DataFrame:
    """``file, record_no, title, category, properties, people``: a row for each heading of the level ``record``.

    ``properties`` is the map of the heading's own property lines; ``category`` the title of the heading of that level around it; ``people``
    the headings below one titled ``people``, in order, as structs of ``name`` and their ``properties``.
    """
    props = outline_properties(tree, file, line_no, text).groupBy(file, "heading_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_props"))  # keys of one heading
    props = props.withColumnRenamed(file, "_file")
    none = F.create_map().cast("map<string,string>")
    above = lambda n: F.get(F.filter("path", lambda h: h["level"] == n), F.lit(0))
    heads = tree.filter("level is not null").join(props, (F.col(file) == F.col("_file")) & (F.col(line_no) == F.col("heading_no")), "left").withColumn("properties", F.coalesce("_props", none))
    records = heads.filter(F.col("level") == record).select(file, F.col(line_no).alias("record_no"), F.element_at("path", -1)["title"].alias("title"), *([above(category)["title"].alias("category")] if category is not None else []), "properties")
    parent = F.get("path", F.size("path") - 2)
    persons = heads.filter((F.size("path") >= 2) & (F.col("level") > record) & parent["title"].startswith(people) & above(record).isNotNull())
    persons = persons.select(file, above(record)["line_no"].alias("record_no"), F.struct(F.col(line_no).alias("no"), F.element_at("path", -1)["title"].alias("name"), "properties").alias("p"))
    # maps don't sort, so the people of a record are put in order by their numbers
    listed = persons.groupBy(file, "record_no").agg(F.array_sort(F.collect_list("p"), lambda a, b: (a["no"] - b["no"]).cast("int")).alias("_p"))
    people_of = F.transform("_p", lambda p: F.struct(p["name"].alias("name"), p["properties"].alias("properties")))
    empty = F.array().cast("array<struct<name:string,properties:map<string,string>>>")
    return records.join(listed, [file, "record_no"], "left").withColumn("people", F.coalesce(people_of, empty)).drop("_p")
