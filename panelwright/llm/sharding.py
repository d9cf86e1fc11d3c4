"""Balanced label propagation: documents with equal texts gather in the same shards.

Documents are linked when their texts are equal. Every document starts with a label drawn from its
id. In each round the linked documents join their neighbours' labels, turn to the one that most of
them have, and move there as far as the shard's quota has room; the others keep their place or wait
for the next round, when they turn to the best shard that is still open, or draw one with room for
them. Rounds end when no waiting unit fits anywhere; the fewer than ``shards`` units left then fill the
remaining room one after another. A quota is the shard's
final number of rows, so linked documents never crowd a shard, and documents without links fill
what is left: row counts differ by one at most.

Rows with equal texts move as units. A unit is a whole group, or, for groups beyond an eighth of a
quota, the part of it that shares a hash of the id; there are fewer than eight such groups a shard,
so their list is bounded. A group that holds a third of all rows thus fills one shard after another
and is cut only where a quota ends. Places within shards and among loose rows come from bucketed
ranks, so no shard is sorted in one task.

Defined results: NULL texts have no links. Rows that repeat a ``doc_id`` and text move together and
get a slot each. Rows with a NULL ``doc_id`` are placed like others. With fewer rows than shards
some shards stay empty; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import stored, with_slots

_UNITS_PER_QUOTA = 8
_ROWS_PER_TASK = 50_000


def _as_array(values: list[int], kind: str = "bigint") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _running(df: DataFrame, key: str, first: Column, order: list[str], rows: int) -> DataFrame:
    """``_sum``: running sum of ``rows`` within ``key``, by ``first`` and then by ``order``.

    As in ``with_slots`` a key is cut into buckets whose sums are added up first.
    """
    buckets = max(1, -(-rows // _ROWS_PER_TASK))
    dealt = df.withColumn("_b", first * buckets + F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = dealt.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(
        F.sum("rows").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("_k").orderBy("_kb")) - F.col("_n")).drop("_n")
    inner = dealt.withColumn("_own", F.sum("rows").over(
        Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return (inner.join(sums, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")))
            .withColumn("_sum", F.col("_own") + F.col("_before"))
            .drop("_b", "_own", "_k", "_kb", "_before"))


def _admit(units: DataFrame, wish: str, room: list[int], n_units: int) -> DataFrame:
    """``label`` of units whose wish has room; the others keep theirs. ``moved`` says which."""
    asking = _running(units.filter(F.col(wish).isNotNull()), wish, F.lit(0), ["g", "chunk"], n_units)
    fits = F.col("_sum") <= F.get(_as_array(room), F.col(wish))
    asking = asking.withColumn("label", F.when(fits, F.col(wish)).otherwise(F.col("label"))) \
        .withColumn("moved", fits).drop("_sum")
    rest = units.filter(F.col(wish).isNull()).withColumn("moved", F.lit(False))
    return asking.unionByName(rest).drop(wish)


def _wishes(units: DataFrame, room: list[int], rounds_done: int, moving: bool) -> DataFrame:
    """Where each unit would go: the open shard with most of its group, if that is more than here.

    A unit without a label whose group has no open shard draws one among those with room for it, by
    their room. Units with a label stay if not ``moving``.
    """
    open_ = [s for s, r in enumerate(room) if r > 0]
    if not open_:
        return units.withColumn("wish", F.lit(None).cast("int"))
    votes = (units.filter(F.col("label").isNotNull()).groupBy("g", "label")
             .agg(F.sum("rows").alias("rows"))
             .groupBy(F.col("g").alias("_g"))
             .agg(F.collect_list(F.struct("rows", (-F.col("label")).alias("l"))).alias("votes")))
    joined = units.join(votes, F.col("g") == F.col("_g"), "left")
    is_open = lambda v: F.get(_as_array(room), -v["l"]) >= F.col("rows")
    best = F.array_max(F.filter("votes", is_open))
    here = F.array_max(F.filter("votes", lambda v: v["l"] == -F.col("label")))
    fitting = [F.when(F.col("rows") <= r, F.lit(r)).otherwise(0).cast("long") for r in room]
    ends = F.array(*[sum(fitting[1:s + 1], fitting[0]) for s in range(len(room))])
    ticket = F.pmod(F.xxhash64("g", "chunk", F.lit(rounds_done)), F.nullif(sum(fitting[1:], fitting[0]), F.lit(0)))
    drawn = F.when(ticket.isNotNull(), F.size(F.filter(ends, lambda e: e <= ticket)).cast("int"))
    better = F.when(best > here, -best["l"]) if moving else F.lit(None)
    wish = F.when(F.col("label").isNull(), F.coalesce(-best["l"], drawn)).otherwise(better)
    return joined.withColumn("wish", wish.cast("int")).drop("_g", "votes")


def sharded(docs: DataFrame, shards: int = 24, rounds: int = 16, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``rounds`` bounds the moves of units that have a place; those that wait go on while any fits.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    meta = docs.select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), F.sha2(F.col(text), 256).alias("g"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("first"))
    meta = stored(meta, "shard-rows")
    total = meta.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    part = max(1, quota[0] // _UNITS_PER_QUOTA)
    large = (meta.filter(F.col("g").isNotNull()).groupBy("g").agg(F.count("*").alias("n"))
             .filter(F.col("n") > max(part, 1)).collect() if part > 1 else [])
    chunk = F.lit(0)
    if large:
        parts = F.create_map(*[x for r in large for x in (F.lit(r.g), F.lit(math.ceil(r.n / part)))])
        chunk = F.coalesce(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.try_element_at(parts, F.col("g"))),
                           F.lit(0))
    meta = meta.withColumn("chunk", chunk.cast("int"))
    ballots = meta.filter(F.col("g").isNotNull()).groupBy("g", "chunk", "first").agg(
        F.count("*").alias("n"))
    units = ballots.groupBy("g", "chunk").agg(
        F.sum("n").alias("rows"), F.max(F.struct("n", (-F.col("first")).alias("l"))).alias("v"))
    names = [r.g for r in large]
    units = units.filter((F.col("rows") > 1) | F.col("g").isin(names)) if names else units.filter(
        F.col("rows") > 1)
    units = stored(units.select("g", "chunk", "rows", F.lit(None).cast("int").alias("label"),
                                (-F.col("v")["l"]).alias("wish")), "shard-units")
    n_units = units.count()
    units = stored(_admit(units, "wish", quota, n_units), "shard-units")
    done = 0
    while True:
        state = units.groupBy("label").agg(
            F.sum("rows").alias("rows"), F.min("rows").alias("least"),
            F.sum(F.col("moved").cast("int")).alias("moved")).collect()
        load = {r.label: r.rows for r in state}
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        waits = any(r.label is None and r.least <= max(room) for r in state)
        moving = done < rounds - 1 and any(r.moved for r in state)
        if not waits and not moving:
            break
        units = stored(_admit(_wishes(units.drop("moved"), room, done, moving), "wish", room, n_units),
                       "shard-units")
        done += 1
    placed = units.filter(F.col("label").isNotNull()).select(
        F.col("g").alias("_g"), F.col("chunk").alias("_chunk"), "label")
    joined = stored(meta.join(placed, (F.col("g") == F.col("_g")) & (F.col("chunk") == F.col("_chunk")),
                              "left").drop("_g", "_chunk", "first"), "shard-labels")
    # each of these has more rows than any shard has room, so they are fewer than the shards
    starts, filled = {}, 0
    waiting = units.filter(F.col("label").isNull()).orderBy("g", "chunk").collect()
    for r in waiting:
        starts[f"{r.g}/{r.chunk}"] = filled
        filled += r.rows
    rest = joined.filter(F.col("label").isNull()).withColumn("_start", F.lit(None).cast("long"))
    if starts:
        rest = rest.withColumn("_start", F.try_element_at(
            F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]),
            F.concat_ws("/", "g", F.col("chunk").cast("string"))).cast("long"))
    loose = with_slots(rest.filter(F.col("_start").isNull()).withColumn("_all", F.lit(0)), "_all",
                       [F.col("g"), F.col("doc_id")], "_place", total, 5_000).drop("_all")
    loose = loose.withColumn("_place", F.col("_place") + filled)
    if starts:
        whole = with_slots(rest.filter(F.col("_start").isNotNull()).withColumn("_unit", F.col("_start")),
                           "_unit", [F.col("doc_id")], "_place", max(r.rows for r in waiting),
                           _ROWS_PER_TASK).drop("_unit")
        loose = loose.unionByName(whole.withColumn("_place", F.col("_place") + F.col("_start")))
    loose = loose.drop("_start")
    ends = [sum(room[:s + 1]) for s in range(shards)]
    fill = F.size(F.filter(_as_array(ends), lambda e: e <= F.col("_place"))).cast("int")
    loose = loose.withColumn("label", fill).drop("_place")
    every = joined.filter(F.col("label").isNotNull()).unionByName(loose).withColumnRenamed(
        "label", "shard")
    slotted = with_slots(every, "shard", [F.col("g"), F.col("doc_id")], "slot",
                         max(1, total // shards), _ROWS_PER_TASK)
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot")
