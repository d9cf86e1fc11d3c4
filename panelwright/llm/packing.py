"""Best-fit decreasing packing of token sequences into windows.

Documents become token ids and an end id; what is longer than a window is first cut into full
windows. The pieces are dealt into groups of a bounded number, and each group is packed by itself:
longest piece first, each into the tightest open window that holds it. A segment tree over the
remaining capacities, of which there are only as many as a window has tokens, finds that window in a
dozen steps. Piece lengths of a group are a random draw from the corpus, and any group has short
pieces to fill gaps with, so packing by groups costs only the group's last windows. Groups are tasks
of their own; a lost executor repeats the groups it had, with the same result.

Defined results: a NULL or empty text is one piece of the end id alone. Rows with a NULL ``doc_id``
are packed like others. Repeated rows are packed once each. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import small_batches, stored, text_blocks
from panelwright.llm.subwords import shared_subwords

PIECES = ("doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long")
_PIECES_PER_GROUP = 1 << 15


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2,
               text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, copy, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each text.

    ``copy`` tells rows apart that repeat an id. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = shared_subwords(tokenizer)
        for batch in batches:
            doc, copy = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for row, data, edges in text_blocks(batch.column(2)):
                found, before = subwords.encode_texts(data, edges)
                for k in range(len(edges) - 1):
                    ids = np.append(found[before[k]:before[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start:start + window].tobytes()
                        rows.append((doc[row + k], copy[row + k], start, len(piece) // 4,
                                     zlib.crc32(piece), len(ids), *([piece] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (7 if with_ids else 6)
            kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [c.split()[0] for c in schema.split(", ")])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"),
                       F.col(text).cast("string"))
    return rows.mapInArrow(cut, schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest fit.

    Leaf ``c`` counts the windows with ``c`` tokens left; an inner node counts its leaves.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out an open window with the least capacity of at least ``length``."""
        at = self.leaves + length
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece, longest first, ties in the given order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, used = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable"):
        length = int(lengths[k])
        found = open_.tightest(length)
        number, left = found if found else (used, window)
        used += found is None
        bins[k], offsets[k] = number, window - left
        open_.put(number, left - length)
    return bins, offsets


def _packer(window: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Ids stay in Arrow: pandas would turn whole numbers next to a NULL into floats."""
    def pack(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("copy", "ascending")])
        bins, offsets = best_fit_decreasing(pieces["length"].to_numpy(), window)
        first = key[0].as_py() * _PIECES_PER_GROUP * 4
        return (pieces.drop_columns(["copy", "_group"])
                .append_column("sequence_id", pa.array(first + bins))
                .append_column("offset", pa.array(offsets)))
    return pack


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2,
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there.

    Pieces are written once; their number, and with it the number of groups, is known before they
    are dealt by the hash of (doc_id, start, copy).
    """
    pieces = stored(cut_pieces(docs, tokenizer, window, end_id, text, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // (_PIECES_PER_GROUP // 2)))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(groups)))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
              + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")
    return dealt.groupBy("_group").applyInArrow(_packer(window), schema)
