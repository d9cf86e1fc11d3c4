"""Ranked lexical search by scanning texts with an automaton of all terms asked for.

Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z
lower-cased. The items' distinct terms, each guarded by a blank on both sides, make an Aho-Corasick
automaton, which goes to every task. Texts are translated byte by byte, anything between terms
becoming blanks, and run through it: each match is one occurrence of one term, since the guards admit
whole terms only. There is no index of the documents.

Two scans: the first counts, per task, terms and documents that hold them, and sums are added up; the
second scores each text for all items that its terms belong to and keeps the best rows of each item,
first within a task, then among dealt parts of the candidates, then overall.

Items whose terms fill more than ``block_bytes`` are taken in blocks, each with its own automaton and
its own scans, so that what is broadcast is bounded whatever the number of items.

Scores follow saturated term frequency in whole numbers, see ``Saturation``.

Defined results: NULL and empty texts have no terms; they count in nothing and are never found.
Rows that share an item id (NULL included) are one item with the terms of all of them; items without
terms find nothing. Every row of the documents is a candidate of its own, repeated ids too; equal
scores go by ascending ``doc_id``, NULL first. An empty table on either side gives an empty result,
and other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import lower_ascii, small_batches, stored

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

_CLEAN = bytearray(range(256))
for _b in range(128):
    if not chr(_b).isalnum():
        _CLEAN[_b] = 32
for _b in range(65, 91):
    _CLEAN[_b] += 32
_CLEAN = bytes(_CLEAN)

_SCAN_BYTES = 1 << 18
_CELLS = 1 << 20
_PARTS = 64


@dataclass(frozen=True)
class Saturation:
    """Score of a term: its weight times ``(unit * tf) div (1000 * tf + k * m)``.

    The weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and ``m = 100 - b + (b * n * N) div L``
    compares the text's number of terms ``n`` with the mean ``L / N`` of texts that have any.
    """

    unit: int = 1_000_000_000
    k: int = 20
    b: int = 50

    def weights(self, n_docs: int, df: np.ndarray) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1)))
                         for d in df], np.int64)

    def lengths(self, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        return 100 - self.b + (self.b * n * n_docs) // max(n_terms, 1)

    def gains(self, weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return weight * ((self.unit * tf) // (1000 * tf + self.k * m))


@dataclass(frozen=True)
class _Block:
    """A block of items: its terms, and the items of each term as ``items[starts[t]:starts[t + 1]]``."""

    name: str
    terms: list[str]
    starts: np.ndarray
    items: np.ndarray
    n_items: int


@functools.lru_cache(maxsize=2)
def _automaton(name: str, terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Kept by worker processes from one task to the next."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        found.add_word(f" {term.encode().decode('latin-1')} ", i)
    found.make_automaton()
    return found


_MATCH = np.dtype([("end", np.int64), ("term", np.int64)])


def scanned(texts: pa.Array, automaton: ahocorasick.Automaton | None, n_terms: int
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first row, terms in each text, and the found: row in the block, term, tf)."""
    raw = [(t or b"").translate(_CLEAN) for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.cumsum([0] + [len(t) + 1 for t in raw])
    row = 0
    while row < len(raw):
        last = int(np.searchsorted(sizes, sizes[row] + _SCAN_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(raw))
        joined = b" " + b" ".join(raw[row:last]) + b" "
        edges = sizes[row:last] - sizes[row]
        inside = np.frombuffer(joined, np.uint8) != 32
        begins = np.flatnonzero(inside[1:] & ~inside[:-1])
        before = np.searchsorted(begins, np.append(edges, len(joined)))
        if automaton is None:
            found = np.zeros(0, _MATCH)
        else:
            found = np.fromiter(automaton.iter(joined.decode("latin-1")), _MATCH)
        # A match ends on the blank after its term, so the text before that blank holds it.
        doc = np.searchsorted(edges, found["end"] - 1, side="right") - 1
        pairs, tf = np.unique(doc * max(n_terms, 1) + found["term"], return_counts=True)
        yield row, np.diff(before), pairs // max(n_terms, 1), pairs % max(n_terms, 1), tf
        row = last


def _item_terms(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Stored rows (item_id, terms, block), and the number of blocks."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    terms = items.select("item_id", F.explode(F.regexp_extract_all(
        text, F.lit(f"({TERM})"), 1)).alias("term")).distinct()
    size = F.sum(F.octet_length("term") + 64)
    sizes = terms.groupBy("item_id").agg(
        F.sort_array(F.collect_list("term")).alias("terms"), size.alias("bytes"))
    sizes = stored(sizes, "item-terms")
    total = sizes.agg(F.sum("bytes")).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return sizes.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), blocks


def _block(rows: list) -> _Block:
    """``rows``: (item_id, terms) of the block's items; items are numbered by their place."""
    terms = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    pairs = np.array(sorted((place[t], i) for i, r in enumerate(rows) for t in r["terms"]),
                     np.int64).reshape(-1, 2)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    return _Block(uuid.uuid4().hex, terms, starts, pairs[:, 1], len(rows))


def _counts(docs: DataFrame, shared, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and documents by term: sums over all tasks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton = _automaton(block.name, tuple(block.terms)) if block.terms else None
        df, n_docs, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            for _, n, _, term, _ in scanned(b.column(0), automaton, n_terms):
                df += np.bincount(term, minlength=n_terms)
                n_docs += int(np.count_nonzero(n))
                total += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n_docs, total]))],
            ["term", "n"])

    sums = docs.select("text").mapInArrow(read, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    found = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    df = np.array([found.get(i, 0) for i in range(n_terms)], np.int64)
    return found.get(-1, 0), found.get(-2, 0), df


class _Best:
    """The best rows of each item among those seen so far, bounded by items times ``limit``."""

    def __init__(self, n_items: int, limit: int):
        self.limit = limit
        self.least = np.ones(n_items, np.int64)     # score that a row needs to be looked at
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]
        self.fresh: list[list[np.ndarray]] = []
        self.waiting = 0

    def offer(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: rows by items; ``known`` is 0 for a NULL id, which goes first."""
        row, item = np.nonzero(scores >= self.least)
        self.fresh.append([item, scores[row, item], known[row], ids[row]])
        self.waiting += len(row)
        if self.waiting > max(4 * self.limit * len(self.least), 1 << 16):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        parts = [self.kept, *self.fresh]
        columns = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        item, score, known, ids = columns
        order = np.lexsort((ids, known, -score, item))
        item, score = item[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.limit - 1
        self.least[item[last]] = score[last]
        best = order[rank < self.limit]
        self.kept, self.fresh, self.waiting = [c[best] for c in columns], [], 0
        return self.kept


def _scored(docs: DataFrame, shared, facts, rule: Saturation, limit: int) -> DataFrame:
    """Rows (item, known, doc, score): the best of each task for the items of a block."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (n_docs, n_terms, weights) = shared.value, facts.value
        automaton = _automaton(block.name, tuple(block.terms))
        width = np.diff(block.starts)
        best = _Best(block.n_items, limit)
        step = max(1, _CELLS // block.n_items)
        for b in batches:
            known = np.asarray(b.column(0).is_valid()).astype(np.int64)
            ids = b.column(0).fill_null(0).to_numpy()
            for row, n, doc, term, tf in scanned(b.column(1), automaton, len(block.terms)):
                gain = rule.gains(weights[term], tf, rule.lengths(n, n_docs, n_terms)[doc])
                for first in range(0, len(n), step):
                    mine = slice(*np.searchsorted(doc, [first, first + step]))
                    many = width[term[mine]]
                    ends = np.cumsum(many)
                    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
                    item = block.items[np.repeat(block.starts[term[mine]], many) + inner]
                    size = min(step, len(n) - first)
                    scores = np.zeros(size * block.n_items, np.int64)
                    np.add.at(scores, np.repeat(doc[mine] - first, many) * block.n_items + item,
                              np.repeat(gain[mine], many))
                    at = slice(row + first, row + first + size)
                    best.offer(scores.reshape(size, -1), known[at], ids[at])
        item, score, known, ids = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids, mask=known == 0), pa.array(score)],
            ["item", "doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(read, "item long, doc_id long, score long")


def _ranked(found: DataFrame, limit: int, *parts: str) -> DataFrame:
    order = Window.partitionBy("item", *parts).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search(docs: DataFrame, items: DataFrame, limit: int = 50, rule: Saturation = Saturation(),
           block_bytes: int = 16 << 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the best texts of each item, scores above 0 only.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    terms, blocks = _item_terms(items, block_bytes)
    kind = dict(items.dtypes)["item_id"]
    results = []
    for number in range(blocks):
        rows = terms.filter(F.col("block") == number).select("item_id", "terms").collect()
        block = _block(rows)
        if not block.terms:
            continue
        shared = spark.sparkContext.broadcast(block)
        n_docs, n_terms, df = _counts(docs, shared, len(block.terms))
        facts = spark.sparkContext.broadcast((n_docs, n_terms, rule.weights(n_docs, df)))
        found = _scored(docs, shared, facts, rule, limit)
        dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
        best = _ranked(_ranked(dealt, limit, "part").drop("rank"), limit).drop("part")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                      f"_item long, item_id {kind}")
        # As many rows as the block has items, which its bytes bound.
        best = best.join(F.broadcast(names), F.col("item") == F.col("_item"))
        results.append(best.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, results)
