"""Helpers that several corpus operators share.

Words are maximal runs without the six ASCII blanks; lower case means A-Z only. The numpy helpers
work on one Arrow batch at a time and cut it into blocks, so that their memory follows the block
and the longest single text, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.runtime import stored  # noqa: F401

BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCK_BYTES = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def small_batches(df: DataFrame, rows: int = 1_000, size: int = 4 << 20) -> DataFrame:
    """``df``, after lowering the session's limits of rows and bytes in an Arrow batch if higher.

    Texts may be long, and a batch of them is held whole by the JVM and by the Python worker.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.max{}PerBatch"
    if not 0 < int(conf.get(name.format("Records"))) <= rows:
        conf.set(name.format("Records"), rows)
    set_size = conf.get(name.format("Bytes")).rstrip("bB")
    if not set_size.isdigit() or not 0 < int(set_size) <= size:
        conf.set(name.format("Bytes"), f"{size}b")
    return df


def in_few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in at most as many tasks as ``rows`` rows fill with ``each``, so that a small table is not
    written as one nearly empty file for each shuffle partition.

    ``rows`` bounds what the last stage of ``df`` reads, not only what it gives, so that tasks stay bounded.
    """
    return df.coalesce(max(1, -(-rows // each)))


def lower_ascii(text: str | Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: str | Column) -> Column:
    """Array of words of a text; empty for NULL and for blank texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def with_slots(df: DataFrame, group: str, order: list[Column], name: str, rows: int,
               per_task: int = 50_000) -> DataFrame:
    """``name``: the row's place in its group, gapless from 0, without sorting a group in one task.

    Rows of a group are dealt by the hash of ``order`` into as many buckets as hold about
    ``per_task`` rows if one group had them all. Bucket sizes give each bucket its first place, and
    a window ranks within the bucket. Ties in ``order`` are ranked one after another.
    """
    buckets = max(1, -(-rows // per_task))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    if buckets == 1:
        first = None
    else:
        counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
        first = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), (
            F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n"))
            .alias("_first"))
    ranked = dealt.withColumn("_rank", F.row_number().over(
        Window.partitionBy(group, "_bucket").orderBy(*order)) - 1)
    if first is None:
        return ranked.withColumn(name, F.col("_rank").cast("long")).drop("_bucket", "_rank")
    return (ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))
                        & (F.col("_bucket") == F.col("_b")))
            .withColumn(name, F.col("_first") + F.col("_rank"))
            .drop("_bucket", "_rank", "_g", "_b", "_first"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)[_FOLD]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of texts laid end to end: 64-bit hashes of their lower case, first bytes, lengths in
    bytes, and how many words stand before each text.

    ``edges`` are the texts' byte offsets, one more than texts. A word's hash is a polynomial of
    its bytes by place in the word, so that it does not depend on where the word stands.
    """
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = edges[:-1][edges[:-1] < len(data)]
    begins[inner] = ~blank[inner]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(edges), np.int64)
    size = np.add.reduceat(~blank, start, dtype=np.int64)
    inside = data[~blank]
    first = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(first, size)
    power = np.full(int(size.max()), _PRIME, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return (mix(np.add.reduceat(_BYTES[inside] * power[place], first)), start, size,
            np.searchsorted(start, edges))


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first row, bytes, edges) of a string column; NULL counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(edges, edges[row] + _BLOCK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, data[edges[row]:edges[last]], edges[row:last + 1] - edges[row]
        row = last


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first row, word hashes, words before each text) of a string column."""
    for row, data, edges in text_blocks(column):
        hashes, _, _, before = word_spans(data, edges)
        yield row, hashes, before


def windows(hashes: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``places`` after each position at which all of them exist."""
    n = max(0, len(hashes) - places[-1])
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(places):
        total += hashes[p:p + n] * mix(np.array([k + 1], np.uint64) * _PRIME)[0]
    return mix(total)


_BITMAP_BUCKET = 32_768
ID_BITS = 1 << 23


def bits_for(values: int) -> int:
    """Bits of a bitmap for so many values: 16 each or more, a power of two, 2^27 (16 MB) at most.

    With more than eight million values it lets ever more others pass; what follows stays exact.
    """
    return 1 << min(27, max(16, (16 * values).bit_length()))


def hash_place(column: str | Column, bits: int) -> Column:
    """Place of a whole number in a bitmap of ``bits`` (a power of two)."""
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("long")


def bitmap(values: DataFrame, place: Column, bits: int = ID_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits, however many values there are: those at ``place`` are set.

    It shows which rows surely have none of the values, before an exact join takes the others.
    """
    parts = (values.select(place.alias("p")).filter(F.col("p").isNotNull())
             .groupBy(F.shiftright("p", 15).alias("b"))
             .agg(F.bitmap_construct_agg(F.col("p") % _BITMAP_BUCKET).alias("bits")))
    out = np.zeros(max(bits, _BITMAP_BUCKET) // 8, np.uint8)
    for row in parts.collect():
        at = row.b * _BITMAP_BUCKET // 8
        out[at:at + _BITMAP_BUCKET // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def bits_at(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def rows_maybe_in(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``docs`` whose ``column`` may be in ``ids`` (same name): all that are, few others.

    A bitmap of fixed size drops the rest where they are read, so that few texts are shuffled in the
    join that has to follow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        bitmap(ids, hash_place(column, ID_BITS)).tobytes())

    def keep(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            place = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield b.filter(pa.array(bits_at(bits, place)))

    marked = docs.filter(F.col(column).isNotNull()).withColumn("_place", hash_place(column, ID_BITS))
    return small_batches(marked).mapInArrow(keep, marked.schema).drop("_place")
