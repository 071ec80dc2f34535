"""State machines over ordered events, such as reviews of a record, whatever the number of events of a record.

Each event asks a record to go to a state; whether it may depends on the state the events before it left.  With finitely many
states an event is a table that tells for each state where it leads, and tables of events in a row can be put together before the
state in front of them is known.  So the events are cut into blocks of ``BLOCK`` within a total order, each block is folded to its
table, the tables of a record's blocks are folded in turn (in as many levels as it takes), and then every block is gone
through again with the state it really starts from.  No task ever holds more than a block of a record's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import table_of
from ..sources.scratch import stored
from .order import numbered

BLOCK = 256


def code_of(name: str, names: list[str]) -> Column:
    """A state's number, null if it is none of the names."""
    return F.nullif(F.array_position(F.lit(names), F.col(name)).cast("int") - 1, F.lit(-1))


def _entry_states(blocks: DataFrame, n_states: int, block: int) -> DataFrame:
    """``key, block, entry``: the state in front of each block of ``blocks(key, block, table, first)``."""
    top = blocks.agg(F.max("block")).first()[0]
    if top is None or top < block:  # a record's blocks fit in one list
        listed = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("_t"), F.first("first").alias("first"))
        start = F.struct(F.col("first").alias("s"), F.array().cast("array<int>").alias("seen"))
        seen = F.aggregate("_t", start, lambda acc, b: F.struct(F.element_at(b["table"], acc["s"] + 1).alias("s"), F.array_append(acc["seen"], acc["s"]).alias("seen")))["seen"]
        both = F.zip_with("_t", seen, lambda b, e: F.struct(b["block"].alias("block"), e.alias("entry")))
        return listed.select("key", F.explode(both).alias("z")).select("key", "z.block", "z.entry")
    lists = blocks.withColumn("_up", F.floor(F.col("block") / block)).groupBy("key", "_up").agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("_t"), F.first("first").alias("first"))
    lists = stored(lists, "state-lists")
    whole = F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)), lambda s: F.aggregate("_t", s, lambda acc, b: F.element_at(b["table"], acc + 1)))
    above = _entry_states(lists.select("key", F.col("_up").alias("block"), whole.alias("table"), "first"), n_states, block)
    entered = lists.drop("first").join(above.select("key", F.col("block").alias("_up"), F.col("entry").alias("first")), ["key", "_up"])
    # below, each list is a record of its own that starts from the state in front of it
    own = entered.select(F.struct("key", "_up").alias("key"), "first", F.posexplode("_t").alias("_i", "b")).select("key", "first", F.col("_i").cast("bigint").alias("block"), F.col("b.table").alias("table"), F.col("b.block").alias("_block"))
    inner = _entry_states(own.drop("_block"), n_states, block)
    return inner.join(own.select("key", "block", "_block"), ["key", "block"]).select("key.key", F.col("_block").alias("block"), "entry")


def transitions(records: DataFrame, events: DataFrame, key: str, state: str, to: str, order: list, moves: dict[str, list[str]], allowed: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Every event with ``before`` and ``after``, the record's states around it, and ``refused``, null or why nothing changed.

    ``records(key, state)`` hold the states to begin with, ``events(key, to, ...)`` what is asked for, in the total ``order``.  ``moves`` names the
    states that may follow each state; ``allowed`` is a further condition on the event itself.  Reasons, the first that holds:
    ``unknown_record``, ``unknown_state`` (the state asked for, or the record's own, isn't in ``moves``), ``not_allowed`` (the
    condition is false or null), ``no_move``.  A refused event changes nothing, and the next one is judged from the state before it.
    Of several rows of a record the smallest state counts; an event without a key belongs to no record.
    """
    names = sorted({*moves, *[m for ms in moves.values() for m in ms]})
    matrix = table_of([[names.index(t) if t in moves.get(s, []) else i for t in names] for i, s in enumerate(names)], "array<array<int>>")
    own = records.groupBy(F.col(key).alias("_k")).agg(F.min(state).alias("_own")).select("_k", code_of("_own", names).alias("_first"))
    rows = events.withColumn("_to", code_of(to, names)).withColumn("_ok", F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True))
    placed = numbered(rows, key, *order, name="_at")
    slim = placed.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.floor(F.col("_at") / block).alias("block"), F.struct("_at", "_to", "_ok").alias("e"))
    parts = slim.groupBy("key", "block").agg(F.array_sort(F.collect_list("e")).alias("_e"))
    parts = stored(parts.join(own, F.col("key") == F.col("_k"), "left"), "state-parts")

    def step(s: Column, e: Column) -> Column:
        return F.when(e["_ok"] & e["_to"].isNotNull(), F.element_at(F.element_at(matrix, s + 1), e["_to"] + 1)).otherwise(s)

    live = parts.filter("_first is not null")
    folded = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda s: F.aggregate("_e", s, step))
    numbers = live.groupBy("key").agg(F.min("block").alias("_b0"))
    blocks = live.select("key", "block", folded.alias("table"), F.col("_first").alias("first")).join(numbers, "key").withColumn("block", F.col("block") - F.col("_b0"))
    entry = _entry_states(stored(blocks.select("key", "block", "table", "first"), "state-blocks"), len(names), block)
    entry = entry.join(numbers, "key").select("key", (F.col("block") + F.col("_b0")).alias("block"), "entry")
    start = F.struct(F.col("entry").alias("s"), F.array().cast("array<struct<at:bigint,b:int,a:int>>").alias("out"))

    def replay(acc: Column, e: Column) -> Column:
        after = step(acc["s"], e)
        return F.struct(after.alias("s"), F.array_append(acc["out"], F.struct(e["_at"].alias("at"), acc["s"].alias("b"), after.alias("a"))).alias("out"))

    done = live.join(entry, ["key", "block"]).select(F.explode(F.aggregate("_e", start, replay)["out"]).alias("o")).select(F.col("o.at").alias("_at"), F.col("o.b").alias("_b"), F.col("o.a").alias("_a"))
    strangers = parts.filter("_k is null").select(F.explode("_e").alias("e")).select(F.col("e._at").alias("_at"), F.lit(True).alias("_unknown"))
    told = placed.join(done, "_at", "left").join(strangers, "_at", "left")
    may = F.array_contains(F.element_at(table_of({s: moves.get(s, []) for s in names}, "map<string,array<string>>"), F.col("before")), F.col(to))
    named = told.withColumn("before", F.get(F.lit(names), F.col("_b"))).withColumn("after", F.get(F.lit(names), F.col("_a")))
    why = (
        F.when(F.col("_unknown") | F.col(key).isNull(), "unknown_record")
        .when(F.col("before").isNull() | F.col("_to").isNull(), "unknown_state")
        .when(~F.col("_ok"), "not_allowed")
        .when(~may, "no_move")
    )
    return named.select(*events.columns, "before", "after", why.alias("refused"))


def settled_states(records: DataFrame, history: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """``records`` with the state that their history leads to, and ``n_refused``; ``order`` is the events' total order."""
    last = history.groupBy(key).agg(F.max_by("after", F.struct(*order)).alias("_after"), F.count_if(F.col("refused").isNotNull()).alias("n_refused"))
    kept = [c for c in records.columns if c != state]
    return records.join(last, key, "left").select(*kept, F.coalesce("_after", state).alias(state), F.coalesce("n_refused", F.lit(0)).cast("bigint").alias("n_refused"))
