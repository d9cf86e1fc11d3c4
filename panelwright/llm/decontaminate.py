"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few words in a row: words under a 1 are hashed together, words under a
0 are ignored, so a window still matches when an ignored word was replaced. The hashes of all
windows of the benchmark and of the corpus are joined; every hit names a document, an item and a
diagonal (how far the document's words are shifted against the item's). The words along the diagonal
are then compared one by one, and of the stretches with at least four matches for each mismatch the
one with the most matches is the overlap. An item is found when its overlap has at least
``min_matches`` equal words, or four fifths of the item's words if that is less.

From 12 ``min_matches`` on, the masks lose no overlap of items of ten words or more: a stretch of 30
words or more holds a shorter one that suffices, and the five masks hit every choice of mismatches in
shorter ones (`tests/llm` goes through all of them).

The corpus side emits only windows whose hash may be a benchmark hash, by a bitmap whose size is
bounded; the join decides exactly. Texts are read a second time for documents with hits alone.
Items of five to nine words have masks of their own length that ignore one place each, so that any one
word may be replaced.

Defined results: NULL, empty and short texts have no windows. Items with fewer than ``min_words``
words and NULL items are left out, as so few words are no evidence. Items that repeat are found
under each of their ids. Rows with a NULL ``doc_id`` are never reported. Rows that repeat an id are
told apart by a digest of the text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import (
    bitmap, bits_at, hashed_words, rows_maybe_in, small_batches, stored, windows,
)

MASKS = ("111111", "11100111", "11011011", "110101011", "1101100011")
_LONGEST = 10                 # items from so many words on are looked up by the masks
_MOST_BITS = 1 << 27
_MISMATCH = -4


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def short_seeds(n: int) -> list[tuple[int, ...]]:
    """Seeds for items of ``n`` < 10 words: all words but a fifth, whichever these are.

    Under five words none may differ. From five on one may: the first n - 1 places serve for the
    first and the last word, as an item has two such windows.
    """
    if n < 5:
        return [tuple(range(n))]
    return [tuple(range(n - 1))] + [
        tuple(i for i in range(n) if i != gone) for gone in range(1, n - 1)]


def _seed_hashes(words: np.ndarray, seeds: list[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """Hashes of all windows, seed by seed; seeds of different shape give different hashes."""
    for places in seeds:
        yield windows(words, places) ^ np.uint64(sum(1 << p for p in places))


def _per_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, hashes, before in hashed_words(column):
        for k in range(len(before) - 1):
            yield row + k, hashes[before[k]:before[k + 1]]


def benchmark_items(benchmark: DataFrame, min_words: int, item: str, text: str) -> DataFrame:
    """Rows (item_id, n, words): the items' word hashes as one binary each."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[k], len(w), w.tobytes()) for k, w in _per_text(b.column(1))
                    if len(w) >= min_words and ids[k] is not None]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary())], ["item_id", "n", "words"])
    return benchmark.select(F.col(item).cast("long"), F.col(text).cast("string")).mapInArrow(
        read, "item_id long, n int, words binary").distinct()


def item_seeds(items: DataFrame, seeds: list[tuple[int, ...]]) -> DataFrame:
    """Rows (hash, item_id, at): where the items have which window."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for item, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                own = seeds if len(words) >= _LONGEST else short_seeds(len(words))
                for h in _seed_hashes(words, own):
                    out[0].append(h.view(np.int64))
                    out[1].append(np.full(len(h), item, np.int64))
                    out[2].append(np.arange(len(h), dtype=np.int32))
            parts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([
                pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()),
                pa.array(parts[2].astype(np.int32), pa.int32())], ["hash", "item_id", "at"])
    return items.mapInArrow(read, "hash long, item_id long, at int")


def text_hits(docs: DataFrame, filled: np.ndarray, seeds: list[tuple[int, ...]]) -> DataFrame:
    """Rows (hash, doc_id, digest, place): windows of the texts that may be benchmark windows."""
    shared = docs.sparkSession.sparkContext.broadcast(filled.tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            digests = b.column(1).to_numpy(zero_copy_only=False)
            for row, words, before in hashed_words(b.column(2)):
                found: list[list[np.ndarray]] = [[], [], []]
                for places, h in zip(seeds, _seed_hashes(words, seeds), strict=True):
                    at = np.flatnonzero(bits_at(bits, (h & mask).astype(np.int64)))
                    text = np.searchsorted(before, at, side="right") - 1
                    whole = at + places[-1] < before[text + 1]
                    at, text = at[whole], text[whole]
                    found[0].append(h[at].view(np.int64))
                    found[1].append(text + row)
                    found[2].append((at - before[text]).astype(np.int32))
                h, text, at = (np.concatenate(c) for c in found)
                if len(h):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h, pa.int64()), pa.array(ids[text], pa.int64()),
                        pa.array(digests[text], pa.int64()), pa.array(at, pa.int32())],
                        ["hash", "doc_id", "digest", "place"])
    return docs.mapInArrow(read, "hash long, doc_id long, digest long, place int")


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Stretch along a diagonal with the most equal words among those with four for each mismatch,
    the first of such: first word in the document, words, equal words."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high <= low:
        return 0, 0, 0
    equal = doc[low + diagonal:high + diagonal] == item[low:high]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, _MISMATCH))])
    matches = np.concatenate([[0], np.cumsum(equal)])
    # for each end the earliest start with a sum that is not above the end's; it has the most matches
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(matches - matches[starts]))
    start = int(starts[end])
    if end > start:
        start += int(np.argmax(equal[start:end]))
    return low + diagonal + start, end - start, int(equal[start:end].sum())


def _verified(rows: DataFrame, min_matches: int) -> DataFrame:
    """Rows (doc_id, digest, text, candidates) to the overlaps that are long enough."""
    schema = ("doc_id long, digest long, item_id long, first_word long, n_words long, "
              "n_equal long, item_words long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = b.column(0).to_pylist(), b.column(1).to_pylist()
            candidates, out = b.column(3).to_pylist(), []
            for k, words in _per_text(b.column(2)):
                for c in candidates[k]:
                    item = np.frombuffer(c["words"], np.uint64)
                    first, n, equal = overlap(words, item, c["diagonal"])
                    if equal >= min(min_matches, -(-4 * len(item) // 5)):
                        out.append((ids[k], digests[k], c["item_id"], first, n, equal, len(item)))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             [f.split()[0] for f in schema.split(", ")])
    return rows.mapInArrow(read, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_matches: int = 12, min_words: int = 5,
                 text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and item found in it: doc_id, digest, item_id, first_word, n_words, n_equal,
    item_words. ``digest`` is ``xxhash64`` of the text."""
    seeds = [_places(m) for m in MASKS]
    items = stored(benchmark_items(benchmark, min_words, item, item_text), "items")
    lengths = items.filter(F.col("n") < _LONGEST).select("n").distinct().collect()
    short = [s for r in sorted(lengths) for s in short_seeds(r.n)]
    keys = stored(item_seeds(items, seeds), "item-seeds")
    bits = 1 << 20
    while bits < 512 * keys.count() and bits < _MOST_BITS:
        bits *= 2
    filled = bitmap(keys, F.expr(f"hash & {bits - 1}L"), bits)
    base = small_batches(docs).filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(
        F.col("doc_id").cast("long"), F.xxhash64(F.col(text)).alias("digest"),
        F.col(text).alias("text"))
    hits = text_hits(base, filled, list(dict.fromkeys(seeds + short)))
    pairs = hits.join(keys, "hash").select(
        "doc_id", "digest", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    pairs = stored(pairs, "diagonals")
    candidates = pairs.join(items, "item_id").groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("item_id", "diagonal", "words")).alias("candidates"))
    texts = rows_maybe_in(base, pairs.select("doc_id").distinct(), "doc_id")
    joined = texts.join(candidates, ["doc_id", "digest"]).select(
        "doc_id", "digest", "text", "candidates")
    best = F.max_by(F.struct("first_word", "n_words", "n_equal", "item_words"),
                    F.struct("n_equal", -F.col("first_word"))).alias("o")
    return (_verified(joined, min_matches).groupBy("doc_id", "digest", "item_id").agg(best)
            .select("doc_id", "digest", "item_id", "o.*"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in whose text no item was found, with all their columns."""
    bad = stored(contaminated(docs, benchmark, text=text, **how).select(
        F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct(), "contaminated")
    return docs.join(bad, (docs["doc_id"] == bad["_doc"])
                     & (F.xxhash64(docs[text]) == bad["_digest"]), "left_anti")
