"""Pending values and what became of them: an ordered fold of events for each key and slot.

Events of a key have an order (seq, distinct within the key), an action and, for one slot, a value:

* set: the slot's pending value is this one;
* apply: the slot's pending value, if there is one, becomes its current one;
* discard: the slot's pending value goes;
* approve: if the key has any pending value, a version is kept of its current ones, those that aren't empty become current, and all of them go;
* reject: all pending values go.

A key may have any number of events.  Its events are cut into chunks of bounded length by seq; in each, the events of a slot are folded into what the chunk
does to whatever comes in (leave, clear or set what is pending; take what was pending before, or set what is current), and windows over the chunks
give what comes in.  A window sees one row a chunk, not its events.  For versions each chunk with an approval is replayed from what came in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = ("approve", "reject")


def _spread(events: DataFrame, key: str, slots: Sequence[str], chunk: int) -> DataFrame:
    """Events by slot: those that concern all slots stand at each; other slots, actions and null keys or orders are none."""
    every = F.array(*[F.lit(s) for s in slots])
    one = F.when(F.col("action").isin(*ALL), every).when(F.col("action").isin("set", "apply", "discard") & F.col("slot").isin(*slots), F.array("slot"))
    kept = events.filter(F.col(key).isNotNull() & F.col("seq").isNotNull())
    return kept.select(key, "seq", "action", F.explode(one).alias("slot"), "value", F.floor(F.col("seq") / chunk).alias("chunk"))


def _folded(spread: DataFrame, key: str) -> DataFrame:
    """What each chunk does to a slot: pending ('' leaves it, 'clear' or 'set' with a value), whether it takes the old one, and what it makes current."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "action", "value")))
    text = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("pending"), text.alias("pending_value"), F.lit("").alias("takes"), F.lit(False).alias("made"), text.alias("current"))

    def step(s: Column, e: Column) -> Column:
        sets, moves = e["action"] == "set", e["action"].isin("apply", "approve")
        filled = (e["action"] == "apply") | (F.coalesce(s["pending_value"], F.lit("")) != "")
        moved = moves & (s["pending"] == "set") & filled
        return F.struct(
            F.when(sets, "set").otherwise("clear").alias("pending"), F.when(sets, e["value"]).alias("pending_value"),
            F.when(moves & (s["pending"] == ""), e["action"]).otherwise(s["takes"]).alias("takes"), (s["made"] | moved).alias("made"), F.when(moved, s["pending_value"]).otherwise(s["current"]).alias("current"),
        )

    return spread.groupBy(key, "slot", "chunk").agg(F.aggregate(rows, start, step).alias("f")).select(key, "slot", "chunk", "f.*")


def _incoming(folded: DataFrame, key: str) -> DataFrame:
    """Chunks with what is pending and current before and after them."""
    order = Window.partitionBy(key, "slot").orderBy("chunk")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    effect = F.struct((F.col("pending") == "set").alias("there"), F.col("pending_value").alias("value"))  # every event of a slot sets or clears
    got = folded.withColumns({"in_pending": F.last(effect).over(before), "out_pending": F.last(effect).over(upto)})
    had = F.coalesce(F.col("in_pending.there"), F.lit(False))
    taken = had & ((F.col("takes") == "apply") | ((F.col("takes") == "approve") & (F.coalesce(F.col("in_pending.value"), F.lit("")) != "")))
    change = F.when(F.col("made"), F.struct(F.col("current").alias("value"))).when(taken, F.struct(F.col("in_pending.value").alias("value")))
    got = got.withColumn("change", change)
    return got.withColumns({"in_current": F.last("change", ignorenulls=True).over(before)["value"], "out_current": F.last("change", ignorenulls=True).over(upto)["value"]})


def state(events: DataFrame, key: str, slots: Sequence[str], chunk: int = 4096) -> DataFrame:
    """After all events: key, slot, current and pending value (null: none), and whether anything is pending; a row for each key and slot with an event."""
    chunks = _incoming(_folded(_spread(events, key, slots, chunk), key), key)
    last = F.max_by(F.struct("out_current", "out_pending"), "chunk")
    got = chunks.groupBy(key, "slot").agg(last.alias("s"))
    return got.select(key, "slot", F.col("s.out_current").alias("current"), F.col("s.out_pending.value").alias("pending"), F.col("s.out_pending.there").alias("is_pending"))


def versions(events: DataFrame, key: str, slots: Sequence[str], chunk: int = 4096) -> DataFrame:
    """A row for each approval that found something pending: key, seq, version (1 is the first), and the current value of each slot before it."""
    spread = _spread(events, key, slots, chunk)
    chunks = _incoming(_folded(spread, key), key)
    needed = spread.filter(F.col("action") == "approve").select(key, "chunk").distinct()
    plain = events.filter(F.col(key).isNotNull() & F.col("seq").isNotNull()).select(key, "seq", "action", "slot", "value", F.floor(F.col("seq") / chunk).alias("chunk"))
    replayed = plain.join(needed, [key, "chunk"]).groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "action", "slot", "value"))).alias("events"))
    entries = F.struct("slot", F.struct(F.coalesce(F.col("in_pending.there"), F.lit(False)).alias("there"), F.col("in_pending.value").alias("pending"), F.col("in_current").alias("current")).alias("s"))
    start = chunks.join(needed, [key, "chunk"]).groupBy(key, "chunk").agg(F.map_from_entries(F.collect_list(entries)).alias("start"))
    text = F.lit(None).cast("string")
    none = F.struct(F.lit(False).alias("there"), text.alias("pending"), text.alias("current"))
    slot = lambda m, s: F.coalesce(F.element_at(m, F.lit(s)), none)
    first = F.struct(*[slot(F.col("start"), s).alias(f"s{i}") for i, s in enumerate(slots)], F.array().cast(f"array<struct<seq:long,{','.join(f's{i}:string' for i in range(len(slots)))}>>").alias("kept"))

    def step(state_: Column, e: Column) -> Column:
        some = F.lit(False)
        for i in range(len(slots)):
            some = some | state_[f"s{i}"]["there"]
        fields = []
        for i, s in enumerate(slots):
            old = state_[f"s{i}"]
            mine = e["slot"] == s
            filled = F.coalesce(old["pending"], F.lit("")) != ""
            moved = old["there"] & (((e["action"] == "apply") & mine) | ((e["action"] == "approve") & filled))
            gone = (e["action"].isin("apply", "discard") & mine) | e["action"].isin(*ALL)
            sets = (e["action"] == "set") & mine
            fields.append(F.struct(F.when(sets, True).when(gone, False).otherwise(old["there"]).alias("there"), F.when(sets, e["value"]).when(~gone, old["pending"]).alias("pending"), F.when(moved, old["pending"]).otherwise(old["current"]).alias("current")).alias(f"s{i}"))
        version = F.array(F.struct(e["seq"].alias("seq"), *[state_[f"s{i}"]["current"].alias(f"s{i}") for i in range(len(slots))]))
        return F.struct(*fields, F.when((e["action"] == "approve") & some, F.concat(state_["kept"], version)).otherwise(state_["kept"]).alias("kept"))

    plain_events = F.transform("events", lambda e: F.struct(e["seq"].cast("long").alias("seq"), F.coalesce(e["action"], F.lit("")).alias("action"), F.coalesce(e["slot"], F.lit("")).alias("slot"), e["value"].alias("value")))
    kept = replayed.join(start, [key, "chunk"]).select(key, F.explode(F.aggregate(plain_events, first, step)["kept"]).alias("v"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return kept.select(key, F.col("v.seq").alias("seq"), *[F.col(f"v.s{i}").alias(s) for i, s in enumerate(slots)]).withColumn("version", number)
