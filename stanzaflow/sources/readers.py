"""Readers: JSON arrays and lines, CSV with a byte-order mark, JSONP, HTML sections, catalogs, nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from .scratch import stored

BOM = "﻿"


def read_records(spark: SparkSession, path: str, schema: str, required: list[str], where: Column | None = None, limit: int | None = None, order: list | None = None) -> DataFrame:
    """A JSON array of objects: rows with empty required fields are left out, then a filter, then the first ``limit`` in order."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    for name in required:
        df = df.filter(F.coalesce(F.trim(F.col(name)), F.lit("")) != "")
    if where is not None:
        df = df.filter(where)
    return df.orderBy(*order).limit(limit) if limit is not None else df


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped.  A bad line is an error, or with ``strict=False`` is kept in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    whole = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    return spark.read.schema(whole).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as text columns, without the byte-order mark that may stand before the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The published version of a versioned table (see ``writers.publish``)."""
    version = spark.read.option("recursiveFileLookup", "true").json(f"{root}/manifest").orderBy(F.desc("published_no")).first()["version"]
    return spark.read.parquet(f"{root}/{version}")


def unwrap_jsonp(x) -> Column:
    """The JSON inside ``callback(...);``, or a bare JSON text; null for a literal null or what isn't JSON."""
    text = F.trim(F.col(x) if isinstance(x, str) else x)
    inner = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^[\w.$]+\s*\((.*)\)\s*;?\s*$", 1), F.lit("")), text)
    kept = F.when(F.trim(inner) != "null", inner)
    return F.when(F.try_parse_json(kept).isNotNull(), F.trim(kept))


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tags: tuple[str, ...] = ("h1", "h2", "h3", "p"), least: int = 1, entities: dict[str, str] = ENTITIES) -> DataFrame:
    """``id, block_no, tag, text`` of well-formed block elements by regular expression, markup and ``entities`` (those of the common kind) resolved.

    For pages written by one template; for any page the extraction in the training-data operators decides by trees.
    """
    names = "|".join(tags)
    clean = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(clean, F.lit(rf"(?is)<(?:{names})\b[^>]*>.*?(?=</?(?:{names}|article|main|div|section|footer|aside|nav|ul|body)\b|\z)"), F.lit(0))
    rows = pages.select(F.col(id_col), F.posexplode(found).alias("block_no", "raw"))
    text = F.regexp_replace("raw", r"(?s)<[^>]*>", " ")
    for entity, char in entities.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    out = rows.select(id_col, "block_no", F.lower(F.regexp_extract("raw", r"(?i)^<([a-z0-9]+)", 1)).alias("tag"), F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"))
    return out.filter(F.length("text") >= least)


def titled_sections(blocks: DataFrame, id_col: str = "page_id", least: int = 8) -> DataFrame:
    """``id, heading, text``: paragraphs under the heading last seen, each text once for a page, short ones left out."""
    heading = F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(W.partitionBy(id_col).orderBy("block_no"))
    paragraphs = blocks.withColumn("heading", heading).filter((F.col("tag") == "p") & (F.length("text") >= least))
    return paragraphs.groupBy(id_col, "text").agg(F.min(F.struct("block_no", "heading")).alias("f")).select(id_col, F.col("f.block_no").alias("block_no"), F.col("f.heading").alias("heading"), "text")


def guarded_sections(pages: DataFrame, wanted: str, headings: list[str], id_col: str = "page_id", html_col: str = "html", least: int = 8) -> DataFrame:
    """``id, heading, excerpt``: the paragraphs under one of ``headings``, of pages whose title or first heading holds the ``wanted`` one.

    ``wanted`` is a column; where it is empty every page counts.  A page that is about something else gives nothing, whatever it holds.
    """
    title = F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title", 1)
    first = F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?is)<h1\b[^>]*>(.*?)</h1", 1)
    holds = lambda x: F.contains(F.regexp_replace(x, r"(?s)<[^>]*>", " "), F.col(wanted))
    about = pages.filter((F.coalesce(wanted, F.lit("")) == "") | holds(title) | holds(first))
    sections = titled_sections(html_blocks(about, id_col, html_col), id_col, 1).filter(F.col("heading").isin(headings))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda p: p["text"]), " ")
    return sections.groupBy(id_col, "heading").agg(joined.alias("excerpt")).filter(F.length("excerpt") >= least)


def outline_records(lines: DataFrame, file_col: str, line_no: str, text_col: str) -> DataFrame:
    """``file, heading, line_no, text``: lines of an outline file under the heading (``** ...``) last seen; ``operators.outline`` keeps all levels."""
    heading = F.last(F.when(F.col(text_col).rlike(r"^\*+ "), F.regexp_replace(text_col, r"^\*+ ", "")), ignorenulls=True)
    seen = lines.withColumn("heading", heading.over(W.partitionBy(file_col).orderBy(line_no)))
    return seen.filter(~F.col(text_col).rlike(r"^\*+ ") & (F.trim(text_col) != "")).select(file_col, "heading", line_no, F.col(text_col).alias("text"))


def _kind(v: Column) -> Column:
    """``object``, ``array`` or ``scalar``."""
    kind = F.schema_of_variant(v)
    return F.when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("scalar")


def _opened(rows: DataFrame, v: str) -> DataFrame:
    """Each row beside the members of its variant, ``pos, key, value``; scalars have none."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(v).outer()))


def payload_tree(payloads: DataFrame, id_col: str, json_col: str, marker: str) -> DataFrame:
    """``id, path, value`` of all scalars below a JSON text, however deep, and ``block``: the nearest member above that has ``marker``.

    Each level opens what is left of the level above with ``variant_explode``, beside its row, and is stored; the walk ends at the level that
    has nothing left to open.  Texts that aren't JSON give none; a null member is a scalar without a value.
    """
    level = payloads.select(F.col(id_col), F.lit("$").alias("path"), F.try_parse_json(F.col(json_col)).alias("v"), F.lit(None).cast("string").alias("block")).filter("v is not null")
    out = None
    while True:
        seen = stored(level.withColumn("kind", _kind(F.col("v"))).withColumn("block", F.coalesce(F.try_variant_get("v", f"$.{marker}", "string"), "block")), "payload-level")
        leaf = seen.filter("kind = 'scalar'").select(id_col, "path", F.try_variant_get("v", "$", "string").alias("value"), "block")
        out = leaf if out is None else out.unionByName(leaf)
        more = seen.filter("kind <> 'scalar'")
        if more.isEmpty():
            return out
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = _opened(more, "v").select(id_col, F.concat("path", step).alias("path"), F.col("value").alias("v"), "block")


# fixed values: where a payload may hold its person
_PERSON = ["$.Package.PersonAuthority.PersonInfo.Person", "$.Package.PersonAuthority.Person", "$.Package.PersonInfo.Person", "$.Package.Person", "$.PersonAuthority.PersonInfo.Person", "$.PersonAuthority.Person", "$.PersonInfo.Person", "$.Person"]


def person_records(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, person_id, name, index_year, person`` of the JSON texts that hold a person, at any of the places where one is wrapped.

    Id and name are taken from the record, or from its basic data.  ``person`` is the variant that ``person_lists`` opens; other texts give none.
    """
    members = lambda x: F.try_variant_get(x, "$", "map<string,variant>")  # noqa: E731  # null for what isn't an object
    held = lambda v: F.filter(F.array(*[F.try_variant_get(v, p, "variant") for p in _PERSON]), lambda x: members(x).isNotNull())
    text = lambda path: F.nullif(F.trim(F.try_variant_get("person", path, "string")), F.lit(""))
    # the text is parsed once for all the places
    rows = payloads.select(F.col(id_col), let(F.try_parse_json(F.col(json_col)), lambda v: F.get(held(v), F.lit(0))).alias("person")).filter("person is not null")
    return rows.select(
        id_col, F.coalesce(text("$.id"), text("$.c_personid"), text("$.BasicInfo.PersonId")).alias("person_id"), F.coalesce(text("$.Name"), text("$.BasicInfo.ChName")).alias("name"),
        text("$.BasicInfo.IndexYear").alias("index_year"), "person",
    )


def person_lists(people: DataFrame, id_col: str, holder: str, member: str, fields: dict[str, str]) -> DataFrame:
    """``id, place`` and the ``fields`` of each entry of a list in person records, e.g. ``PersonAddresses`` with ``Address``.

    A list of one is often written as the entry itself; entries that aren't objects are left out.  ``fields`` gives each column its member name;
    values are texts, empty ones null.
    """
    path = f"$.{holder}.{member}"
    rows = people.select(F.col(id_col), F.try_variant_get("person", path, "variant").alias("_l"), F.try_variant_get("person", path, "array<variant>").alias("_many")).filter("_l is not null")
    # one list either way: a union of both ways has more partitions than the join behind it is planned for
    entries = rows.select(F.col(id_col), F.posexplode(F.when(_kind(F.col("_l")) == "object", F.array("_l")).otherwise(F.col("_many"))).alias("place", "_e"))
    kept = entries.filter(_kind(F.col("_e")) == "object")
    return kept.select(id_col, "place", *[F.nullif(F.trim(F.try_variant_get("_e", f"$.{m}", "string")), F.lit("")).alias(c) for c, m in fields.items()])


def payload_events(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, key, value`` of a JSON object's members as text; texts that aren't objects give none."""
    members = F.from_json(json_col, "map<string,string>")
    return payloads.select(F.col(id_col), F.explode(members).alias("key", "value"))


def zip_authors(rows: DataFrame, id_col: str, names: str, ids: str, eras: str) -> DataFrame:
    """Parallel arrays as rows; missing entries are null."""
    z = F.explode_outer(F.arrays_zip(F.col(names).alias("name"), F.col(ids).alias("author_id"), F.col(eras).alias("era")))
    return rows.select(F.col(id_col), z.alias("z")).select(id_col, "z.name", "z.author_id", "z.era")


def page_fingerprint(rows: DataFrame, page_col: str, order: list[str]) -> DataFrame:
    """``page, fingerprint, repeated``: a page whose content an earlier page had ends a paged collection."""
    cells = F.array_sort(F.collect_list(F.to_json(F.struct(*order))))
    prints = rows.groupBy(page_col).agg(F.sha2(F.array_join(cells, "\x1f"), 256).alias("fingerprint"))
    earlier = F.row_number().over(W.partitionBy("fingerprint").orderBy(page_col)) > 1
    return prints.withColumn("repeated", earlier)
