"""Near-duplicate documents: exact Jaccard join of word n-gram sets by partitioning their universe.

A document's set holds the hashes of its distinct five-word shingles. Sets are grouped into size
bands; a set takes part in its own band and, if a partner may be there, in the next smaller one. In
a band two sets with a Jaccard similarity of 0.8 differ in at most H elements. The universe is
hashed into m segments, so by the pigeonhole principle at least m - H segments of similar sets are
equal, and about half of H segments differ by one element at most if each is allowed to.

What is indexed is allocated by its cost, the number of sets under the same key:

- Large bands index the segments themselves, with ``slack`` more segments than H + 1; small bands index
  one-deletion neighbourhoods, half as many segments.
- Segments that are empty or crowded, that is, shared by more than ``group_limit`` sets as passages copied
  into many documents make them, are worth nothing. Similar sets that share no other key both have
  more such segments than ``slack``: these sets are *poor*, and are cut again into segments of single
  elements, the finest partition of the universe there is. With r elements, of which a similar set
  lacks a fifth at most, the first r / 5 + 1 of them are indexed, rare elements before crowded ones: the first
  element that two similar sets have in common is among those of both.
- Under crowded elements only pairs are left that have no rare element in common. A pair is made under the
  first crowded element in common, so that all elements before it count as differences, and so does what
  is left in number; where both have the same element before, it was made under that one. Sets of
  the kind "a common passage and much of their own" are never compared there, because their own
  elements alone are too many, nor are near copies that differ too much from their origin.

Equal sets are one record. Sets under one key are first compared with one of them, under crowded elements the one
with the least of its own, as the origin of a group of near copies has; what has become one
component is not compared again, so a large group of copies costs one comparison each. Sets that
remain under crowded elements take turns in being compared with those that had none yet. Pairs are
first tested by sizes and by the distance of small count vectors, which bounds the difference from
below, and then verified exactly on the whole sets. Links go through connected components.

Defined results: NULL, empty and blank texts have no shingles and link with nothing; with fewer than
five words the whole sequence is one shingle. Rows with a NULL ``doc_id`` are returned unlinked with
a NULL component. Rows that repeat an id are linked by each of their texts, and their component is
the smallest id that any of them reaches through its own text. An empty table gives an empty result.
Hashes have 64 bits and are taken for the shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import (
    bitmap, bits_at, bits_for, hash_place, hashed_words, in_few, mix, small_batches, stored, windows,
)
from panelwright.llm.components import components

_SMALL = 40          # largest set of the small bands
_CELLS = 128         # cells of the count vectors
_LEADERS = 256       # sets of a large group compared with all others in a round
_FIRST_LEADERS = 8   # and in the first round
_ROUND_PAIRS = 1 << 25  # more take part in a round as long as it cannot make more pairs than these
_BUCKETS = 1 << 16   # of keys, to find the heavy ones
_RECORDS, _SETS = 5_000, 1_000  # of which a task takes that many at least
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _salt(number: int) -> np.uint64:
    return np.uint64(number * int(_GOLDEN) % (1 << 64))


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high`` of the smaller set of a pair."""

    number: int
    low: int
    high: int

    @property
    def small(self) -> bool:
        return self.high <= _SMALL

    @property
    def differ(self) -> int:
        """H: elements in which similar sets differ at most."""
        return self.high // 4

    @functools.cached_property
    def slack(self) -> int:
        if self.small:
            return 0
        slack = 1
        while slack < max(2, (self.differ + 1) // 8):
            m = self.differ + 1 + slack
            empty = m * math.exp(-self.low / m)
            if slack >= empty + 2 * math.sqrt(empty):
                break
            slack += 1
        return slack

    @property
    def segments(self) -> int:
        return -(-(self.differ + 1) // 2) if self.small else self.differ + 1 + self.slack


@functools.cache
def _bands() -> tuple[Band, ...]:
    found, low = [], 1
    while low < 1 << 40:
        high = low * 5 // 4
        found.append(Band(len(found), low, high))
        low = high + 1
    return tuple(found)


_LOWS = np.array([b.low for b in _bands()])


def bands_of(size: int) -> list[Band]:
    """The bands a set takes part in: its own, and the one below if a partner may be there."""
    own = _bands()[int(np.searchsorted(_LOWS, size, side="right")) - 1]
    below = [_bands()[own.number - 1]] if own.number and -(-4 * size // 5) < own.low else []
    return [b for b in [own, *below] if b.differ]


def slots_of(size: int) -> list[tuple[int, Band]]:
    """The bands of a set with their slots: 0 own large band, 1 large band below, 2 small bands."""
    return [(2 if b.small else i, b) for i, b in enumerate(bands_of(size))] if size else []


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    return np.unique(windows(words, tuple(range(k))) + np.uint64(k))


def text_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, hashes, before in hashed_words(column):
        for k in range(len(before) - 1):
            yield row + k, shingles(hashes[before[k]:before[k + 1]], n)


def set_key(s: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(mix(s * _GOLDEN), dtype=np.uint64)
    b = np.add.reduce(mix(s ^ _GOLDEN), dtype=np.uint64)
    return int(mix(np.array([a + np.uint64(len(s))]))[0].view(np.int64)), int(b.view(np.int64))


def count_vector(s: np.ndarray) -> bytes:
    counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=_CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def segments(s: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment: the key of its elements and their number; and the segment of each element."""
    place = (mix(s + _salt(band.number)) % np.uint64(band.segments)).astype(np.int64)
    sums = np.zeros(band.segments, np.uint64)
    np.add.at(sums, place, mix(s))
    return sums, np.bincount(place, minlength=band.segments), place


def _signature(sums: np.ndarray, place: np.ndarray, band: Band, kind: int) -> np.ndarray:
    salt = _salt(band.number * 4 + kind)
    return mix(sums ^ mix(place.astype(np.uint64) * np.uint64(1 << 20) + salt)).view(np.int64)


def plain_keys(s: np.ndarray, band: Band) -> np.ndarray:
    """Keys of the segments that are not empty."""
    sums, sizes, _ = segments(s, band)
    full = np.flatnonzero(sizes)
    return _signature(sums[full], full, band, 0)


def deletion_keys(s: np.ndarray, band: Band) -> np.ndarray:
    """Keys of segments and of what is left of them without any one element."""
    sums, _, place = segments(s, band)
    one_less = _signature(sums[place] - mix(s), place, band, 1)
    return np.unique(np.concatenate([_signature(sums, np.arange(band.segments), band, 1), one_less]))


def _described(docs: DataFrame, n: int, text: str) -> DataFrame:
    """Rows (doc_id, n_shingles, rec, key2, cells, large) per row of ``docs``.

    ``large`` lists the set's large bands: its slot (0: own band, 1: the one below), empty segments and
    slack.
    """
    large = "array<struct<slot: int, empty: int, slack: int>>"
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("slot", "empty", "slack")]))
    schema = f"doc_id long, n_shingles long, rec long, key2 long, cells binary, large {large}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ids = b.column(0).to_pylist()
            for k, s in text_sets(b.column(1), n):
                shape = [(slot, band.segments - int(np.count_nonzero(segments(s, band)[1])),
                          band.slack) for slot, band in slots_of(len(s)) if slot < 2]
                out.append((ids[k], len(s), *set_key(s), count_vector(s), [dict(zip(
                    ("slot", "empty", "slack"), x, strict=True)) for x in shape]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.binary(), kind]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "n_shingles", "rec", "key2", "cells", "large"])
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(read, schema)


def _index_rows(texts: DataFrame, n: int) -> DataFrame:
    """Rows (key, rec, slot): what the sets of (doc_id, text) are indexed under."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, recs, slots = [], [], []
            for _, s in text_sets(b.column(1), n):
                own = set_key(s)[0]
                for slot, band in slots_of(len(s)):
                    k = deletion_keys(s, band) if band.small else plain_keys(s, band)
                    keys.append(k)
                    recs.append(np.full(len(k), own, np.int64))
                    slots.append(np.full(len(k), slot, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), pa.array(np.concatenate(recs)),
                    pa.array(np.concatenate(slots))], ["key", "rec", "slot"])
    return texts.select("doc_id", "text").mapInArrow(read, "key long, rec long, slot int")


def _crowded_elements(sets: DataFrame, group_limit: int) -> np.ndarray:
    """A bitmap in which every element of more than ``group_limit`` of the ``sets`` is marked.

    It has 16 bits for each of them, and 2^27 at most. Which elements count as crowded decides about the
    cost only, so the few others that it marks do no harm.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(raw.as_buffer(), np.int64))], ["element"])

    found = stored(sets.select("elements").mapInArrow(read, "element long").groupBy("element").count()
                   .filter(F.col("count") > group_limit).select("element"), "crowded")
    bits = bits_for(found.count())
    return bitmap(found, F.pmod(F.col("element"), F.lit(bits)), bits)


def _element_rows(sets: DataFrame, crowded: np.ndarray, percent: int) -> DataFrame:
    """Rows (key, rec, rare, need, common, prev) for ``sets`` (rec, elements): the elements indexed for each.

    ``common`` is the number of a set's elements from this one on, and ``need`` that of those before it less its
    share of the differences that a similar pair may have, both scaled by 100 + percent: two sets whose first
    common element this is can only be similar if their needs and what their rests differ in number add up
    to 0 or less. ``prev`` is the crowded element before this one. Sets with more rare elements than they may
    lack have rows of rare elements only.
    """
    shared = sets.sparkSession.sparkContext.broadcast(crowded.tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        last = np.uint64(len(bits) * 8 - 1)
        for b in batches:
            for rec, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                common = bits_at(bits, (s & last).astype(np.int64))
                order = np.concatenate([s[~common], s[common]])[:len(s) * (100 - percent) // 100 + 1]
                rare = len(s) - int(np.count_nonzero(common))
                place = np.arange(len(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order.view(np.int64)), pa.array(np.full(len(order), rec, np.int64)),
                     pa.array(place < rare), pa.array((100 + percent) * place - (100 - percent) * len(s)),
                     pa.array((100 + percent) * (len(s) - place)),
                     pa.array(np.roll(order, 1).view(np.int64), mask=place <= rare)],
                    ["key", "rec", "rare", "need", "common", "prev"])
    return sets.select("rec", "elements").mapInArrow(
        read, "key long, rec long, rare boolean, need long, common long, prev long")


class _Corpus:
    """The records of a corpus and how to get at their sets."""

    def __init__(self, docs: DataFrame, n: int, text: str):
        self.n = n
        self.docs = small_batches(docs).filter(F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
        self.rows = stored(_described(docs, n, text), "sets")
        real = self.rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        self.n_rows = self.rows.count()
        self.records = stored(in_few(real.groupBy("rec", "key2").agg(
            F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in (
                "n_shingles", "cells", "large")]), self.n_rows, _RECORDS), "records")

    def one_text_each(self) -> DataFrame:
        """(doc_id, text) of one row of each record, and maybe of some more."""
        chosen = self.records.select(F.col("doc").alias("doc_id")).distinct()
        others = self.rows.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(
            chosen, "doc_id", "left_anti")
        others = stored(in_few(others, 2 * self.n_rows), "copies")
        return self.docs.join(others, "doc_id", "left_anti")

    def sets_of(self, recs: DataFrame) -> DataFrame:
        """Rows (rec, elements) of the records in ``recs`` (rec), written once.

        Sets are formed where texts are read, of the documents that a bitmap of bounded size lets
        pass; the join then decides. No text is shuffled.
        """
        n = self.n
        ids = stored(recs.join(self.records.select("rec", "doc"), "rec").select("doc"), "wanted-ids")
        wanted = ids.count()
        size = bits_for(wanted)
        shared = self.docs.sparkSession.sparkContext.broadcast(
            bitmap(ids, hash_place("doc", size), size).tobytes())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                place = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = b.column(0).filter(pa.array(bits_at(bits, place)))
                for some in range(0, len(texts), 100):
                    found = [(set_key(s)[0], s.tobytes())
                             for _, s in text_sets(texts.slice(some, 100), n) if len(s)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.binary())], ["rec", "elements"])
        sets = self.docs.select("text", hash_place("doc_id", size)).mapInArrow(
            read, "rec long, elements binary")
        sets = sets.join(recs, "rec", "left_semi").dropDuplicates(["rec"])
        return stored(in_few(sets, wanted, _SETS), "elements")


def _similar(pairs: DataFrame, corpus: _Corpus, percent: int, sizes: DataFrame | None = None,
             sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    ``sizes`` and ``sets`` are the records' rows and sets where they are at hand for all pairs.
    """
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            ca, cb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, _CELLS)
                      .astype(np.int16) for i in (3, 5))
            apart = np.abs(ca - cb).sum(axis=1) if len(ca) else np.zeros(0)
            differ = (100 - percent) * (na + nb) / (100 + percent)
            fits = (apart <= differ + 1e-6) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield b.select([0, 1]).filter(pa.array(fits))

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sizes = (corpus.records if sizes is None else sizes).select("rec", "n_shingles", "cells")
    rows = pairs.count() + sizes.count()
    close = pairs
    for side in "ab":
        close = close.join(sizes.select(F.col("rec").alias(side), F.col("n_shingles").alias(f"n{side}"),
                                        F.col("cells").alias(f"c{side}")), side)
    close = close.select("a", "b", "na", "ca", "nb", "cb").mapInArrow(near, "a long, b long")
    close = stored(in_few(close, rows, _RECORDS), "close")
    n_close = close.count()
    if sets is None:
        recs = close.select(F.col("a").alias("rec")).union(close.select("b")).distinct()
        sets = corpus.sets_of(stored(in_few(recs, 2 * n_close), "wanted"))
    rows = n_close + sets.count()
    for side in "ab":
        close = close.join(sets.select(F.col("rec").alias(side), F.col("elements").alias(f"s{side}")), side)
    return in_few(close.select("a", "b", "sa", "sb").mapInArrow(equal, "a long, b long"), rows, _SETS)


def _members(rows: DataFrame) -> DataFrame:
    """Keys that several records have: (key, rec, ..., sets), ``sets`` being their number.

    ``rows`` are stored ones. Few keys have so many rows that one task had better not take them: they
    stand out in the row counts of hashed buckets of keys, of which there is a fixed number. Keys of such
    buckets are counted before they are dealt, and the join of their counts can be split; all others
    are dealt by key once.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(_BUCKETS)))
    sizes = stored(dealt.groupBy("bucket").count(), "bucket-sizes")
    mean = sizes.agg(F.avg("count")).head()[0] or 0.0
    # Less than a quarter of the buckets can have more than four times the mean.
    heavy = F.col("bucket").isin([r["bucket"] for r in sizes.filter(F.col("count") > 4 * mean).collect()])
    hot = stored(dealt.filter(heavy).drop("bucket"), "hot-keys")
    counts = stored(hot.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1"), "key-counts")
    rest = dealt.filter(~heavy).drop("bucket").withColumn(
        "sets", F.count("*").over(Window.partitionBy("key"))).filter("sets > 1")
    return rest.unionByName(hot.join(counts, "key"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x != y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_leader(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of everything under a key with one leader, the set with the least need."""
    rows = members.count()
    first = stored(in_few(members.groupBy("key").agg(
        F.min(F.struct("need", "rec", "common")).alias("first")), rows), "leaders")
    both = members.join(first, "key").filter(
        F.col("need") + F.col("first.need") + F.abs(F.col("common") - F.col("first.common")) <= 0)
    return in_few(_ordered(both.select(F.col("first.rec").alias("x"), F.col("rec").alias("y"))), rows)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members under keys that still span several components, with their ``root``."""
    rows = members.count()
    left = members.join(roots, "rec", "left").withColumn("root", F.coalesce("root", "rec"))
    spans = stored(in_few(left.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("need").alias("least"))
        .filter("low != high AND least <= 0").select("key"), rows), "open-keys")
    return stored(in_few(left.join(spans, "key", "left_semi"), 2 * rows), "open-members")


def _across(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of different components under a key that may be similar, one side in ``x`` and one in ``y``,
    all of whom have the same turn as ``x`` or a later one. Of one turn a pair is made once."""
    x, y = (side.select("key", F.col("rec").alias(name), F.col("root").alias(f"r{name}"),
                        F.col("need").alias(f"n{name}"), F.col("common").alias(f"c{name}"),
                        F.col("turn").alias(f"t{name}"), F.col("prev").alias(f"p{name}"))
            for side, name in ((x, "x"), (y, "y")))
    return _ordered(x.join(y, "key").filter(
        "rx != ry AND nx + ny + abs(cx - cy) <= 0 AND (tx < ty OR x < y) AND NOT coalesce(px = py, false)")
        .select("x", "y"))


def _poor(index: DataFrame, corpus: _Corpus, group_limit: int) -> DataFrame:
    """Records (rec) whose similar sets may share empty segments and crowded keys only."""
    crowded = index.filter(F.col("sets") > group_limit)
    hot = crowded.filter("slot < 2").groupBy("rec", "slot").agg(F.count("*").alias("hot"))
    shapes = corpus.records.select("rec", F.explode("large").alias("b")).select("rec", "b.*")
    large = shapes.join(hot, ["rec", "slot"], "left").filter(
        F.col("empty") + F.coalesce("hot", F.lit(0)) > F.col("slack")).select("rec")
    poor = large.union(crowded.filter("slot = 2").select("rec")).distinct()
    return stored(in_few(poor, index.count()), "poor")


def similar_records(corpus: _Corpus, percent: int = 80, group_limit: int = 8) -> DataFrame:
    """Rows (rec, root): the components of the records that have links."""
    if percent < 80:
        raise ValueError("the bands hold for a similarity of 80 percent or more")
    rows = stored(_index_rows(corpus.one_text_each(), corpus.n), "all-keys")
    index = stored(_members(rows), "shared-keys")
    sets = corpus.sets_of(_poor(index, corpus, group_limit))
    rows = stored(_element_rows(sets, _crowded_elements(sets, group_limit), percent), "elements")
    none = [F.lit(v).cast("long").alias(c) for c, v in (("need", 0), ("common", 0), ("prev", None))]
    plain = index.filter(F.col("sets") <= group_limit).select("key", "rec", *none).unionByName(
        _members(rows.filter("rare")).select("key", "rec", *none))
    members = stored(plain, "members")
    seen = stored(_with_leader(members), "pairs")
    links = stored(_similar(seen, corpus, percent), "links")
    roots = components(links)
    left = _open(members, roots).withColumn("turn", F.lit(0))
    pairs = _across(left, left).join(seen, ["a", "b"], "left_anti")
    links = stored(_similar(stored(pairs, "pairs"), corpus, percent), "links")
    return _crowded_groups(rows.filter("NOT rare"), sets, links, roots, corpus, percent)


def _crowded_groups(members: DataFrame, sets: DataFrame, links: DataFrame, roots: DataFrame,
                    corpus: _Corpus, percent: int) -> DataFrame:
    """The components (rec, root) after the ``members`` of crowded elements had their turns.

    Of a similar pair here at least one set has a need of 0 or less. These are compared with a leader
    first and then, where a key still spans several components, take turns: in its turn a set is compared
    with those of greater need and with those whose turn has not passed. The members' sets are at hand.
    ``links`` are not yet part of the components ``roots``.
    """
    sizes = corpus.records.join(members.select("rec").distinct(), "rec", "left_semi")
    sizes = stored(in_few(sizes, corpus.n_rows, _RECORDS), "crowd-records")
    found = stored(_similar(stored(_with_leader(members), "pairs"), corpus, percent, sizes, sets), "links")
    roots = components(links.unionByName(found), roots)
    crowd = _open(members, roots)
    most, size = crowd.groupBy("key").agg(F.count_if(F.col("need") <= 0).alias("turns"), F.count("*").alias(
        "sets")).agg(F.max("turns"), F.sum("sets")).head()
    if not most:
        return roots
    # Few have their turn at first, since whoever they link is not compared again: 8 a key, 128, and then
    # 256 or as many as keep the pairs of a round bounded, since a round of few pairs costs little more than none.
    shares, step = [], _FIRST_LEADERS
    while sum(shares) < most:
        shares.append(step)
        step = min(16 * step, max(_LEADERS, _ROUND_PAIRS // size))
    rounds = len(shares)
    drawn = F.pmod(F.xxhash64("rec"), F.lit(sum(shares)))
    turn = F.lit(rounds)
    for k in reversed(range(rounds)):
        turn = F.when(drawn < sum(shares[:k + 1]), k).otherwise(turn)
    turn = F.when(F.col("need") <= 0, turn).otherwise(rounds)
    crowd = crowd.withColumn("turn", turn)
    for done in range(rounds):
        pairs = stored(_across(crowd.filter(F.col("turn") == done), crowd), "pairs")
        found = stored(_similar(pairs, corpus, percent, sizes, sets), "links")
        if found.head(1):
            roots = components(found, roots)
        if done + 1 < rounds:
            crowd = _open(crowd.filter(F.col("turn") > done).drop("root"), roots)
            if not crowd.head(1):
                break
    return roots


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text",
                    group_limit: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    corpus = _Corpus(docs, n, text)
    roots = similar_records(corpus, percent, group_limit)
    of = corpus.records.select("rec", "key2", "doc").join(roots, "rec", "left").withColumn(
        "root", F.coalesce("root", "rec"))
    least = of.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stored(of.join(least, "root").select(
        F.col("rec").alias("_rec"), F.col("key2").alias("_key2"), "component_id"), "components")
    rows = corpus.rows
    return rows.join(named, (rows["rec"] == named["_rec"]) & (rows["key2"] == named["_key2"]), "left") \
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(
            F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, with all columns.

    Of rows that repeat an id one stays. Rows with a NULL ``doc_id`` stay.
    """
    found = near_duplicates(docs, **how)
    ids = stored(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("component_id").alias("_c")).filter("doc_id != _c").select(F.col("doc_id").alias("_d")),
        "later-copies")
    kept = docs.join(ids, docs["doc_id"] == ids["_d"], "left_anti")
    named = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.filter(F.col("doc_id").isNull()))
