"""Document fingerprints: threshold-scaled sketches of character shingles.

A text's shingles are its runs of ``length`` code points (the whole text if it is shorter). Each has
a 64-bit hash, and the sketch holds every distinct hash below a fixed fraction, one in ``scale``, of
the hash range. Whether a hash is held depends on nothing but itself, so sketches of parts merge by
union into the sketch of the whole, and the share of one sketch that lies in another estimates how
much of one text is contained in another, however unequal they are.

A text of which no shingle is held keeps its least hash, so that only the empty text has an empty
sketch; merged sketches leave such a hash out again, as a part's least hash says nothing about the
whole. The fingerprint is the sketch's sorted hashes in base64.

``next_likeness`` compares neighbours in descending order of ids. Texts are dealt out by ranges of
ids; the greatest row of a range also visits the range above it, so each range is read once, in
order, with one text held back. An id that many rows share is split by the hash of its text.

Defined results: a NULL text counts as empty, two empty sketches are alike (1), an empty and another
one are not (0). Rows with a NULL ``doc_id`` come last, rows that share an id follow each other by
descending hash of their text, then by the text; a single row is its own neighbour. An empty table gives an
empty result, and other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import mix, small_batches, windows

SCALE, LENGTH = 16, 8
_LEAST_KEY = -(1 << 63)


def shingle_hashes(text: str, length: int = LENGTH) -> np.ndarray:
    """Hashes of a text's shingles by place."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(points):
        return points
    return windows(mix(points + np.uint64(1)), tuple(range(min(length, len(points)))))


def sketch(text: str, scale: int = SCALE, length: int = LENGTH) -> np.ndarray:
    """Sorted distinct shingle hashes below the threshold; the least one if there are none."""
    hashes = shingle_hashes(text, length)
    held = hashes[hashes <= np.uint64(((1 << 64) - 1) // scale)]
    return np.unique(held) if len(held) or not len(hashes) else hashes.min(keepdims=True)


def encoded(held: np.ndarray) -> str:
    return base64.b64encode(held.astype("<u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def compared(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Estimated resemblance of two texts, share of the first in the second, and the reverse."""
    if not len(a) or not len(b):
        return (float(len(a) == len(b)),) * 3
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a), both / len(b)


def fingerprint_of(text: str | Column, scale: int = SCALE, length: int = LENGTH) -> Column:
    """Column of fingerprints."""
    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: encoded(sketch(t, scale, length)))
    return made(F.col(text) if isinstance(text, str) else text)


def likeness_of(first: str | Column, second: str | Column) -> Column:
    """Struct of estimates for two columns of fingerprints; NULL counts as empty."""
    names = ["resemblance", "first_in_second", "second_in_first"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def estimates(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = zip(a.fillna("").map(decoded), b.fillna("").map(decoded), strict=True)
        return pd.DataFrame([compared(x, y) for x, y in pairs], columns=names, dtype=float)
    return estimates(first, second)


def merged(prints: DataFrame, group: str, fingerprint: str = "fingerprint",
           scale: int = SCALE) -> DataFrame:
    """Rows (group, hash): the sketch of all texts of a group together, one row a hash.

    Equal hashes meet on the map side first; no group is gathered in one task.
    """
    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        most = np.uint64(((1 << 64) - 1) // scale)
        return texts.fillna("").map(lambda t: [int(h) for h in decoded(t) if h <= most])

    return prints.select(F.col(group).alias("group"), F.explode(hashes(fingerprint)).alias("hash")) \
        .distinct()


def share_held(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows (group, n_hashes, share): how much of each group of ``parts`` lies in ``whole``.

    Both are rows of ``merged``; the groups of ``whole`` count as one text. One join by hash, in
    which each row of ``parts`` finds one row at most.
    """
    there = whole.select(F.col("hash").alias("_h")).distinct()
    found = parts.join(there, F.col("hash") == F.col("_h"), "left")
    return found.groupBy("group").agg(
        F.count("*").alias("n_hashes"), (F.count("_h") / F.count("*")).alias("share"))


def _placed(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, visit, key, tie, doc_id, text): every row in its range of ids, and the first of
    each range, in descending order, once more as a visitor of the range before it."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_KEY))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    cuts = rows.agg(F.percentile_approx(
        "key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")).head()["cuts"]
    edges, hot = [], False
    for cut in sorted(set(cuts or [])):
        times = cuts.count(cut)
        hot |= times > 1
        edges += [(cut, _LEAST_KEY + (k << 64) // times) for k in range(times)]
    # Texts are hashed for the ranges only if an id is so common that it is split.
    tie = F.xxhash64("text")
    at = F.struct(F.col("key").alias("k"), (tie if hot else F.lit(_LEAST_KEY)).alias("t"))
    rows = rows.withColumn("at", at)
    if edges:
        table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in edges])
        steps = F.array(*[F.lit(1 << b) for b in range(len(edges).bit_length() - 1, -1, -1)])
        rows = rows.withColumn("part", F.aggregate(steps, F.lit(0), lambda found, step: F.when(
            F.get(table, found + step - 1) <= F.col("at"), found + step).otherwise(found)))
    else:
        rows = rows.withColumn("part", F.lit(0))
    heads = sorted(rows.groupBy("part").agg(F.max("at").alias("at")).collect())
    if not heads:
        return rows.select("part", F.lit(0).alias("visit"), "key", tie.alias("tie"), "doc_id", "text")
    visits = [(h["at"]["k"], h["at"]["t"], heads[(i + 1) % len(heads)]["part"])
              for i, h in enumerate(heads)]
    # One row a range: as small as the session's number of shuffle partitions.
    visits = F.broadcast(docs.sparkSession.createDataFrame(visits, "_k long, _t long, _to int"))
    rows = rows.join(visits, (F.col("at.k") == F.col("_k")) & (F.col("at.t") == F.col("_t")), "left")
    own = F.struct(F.col("part"), F.lit(0).alias("visit"))
    visit = F.struct(F.col("_to").alias("part"), F.lit(1).alias("visit"))
    copies = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, visit))
    return rows.select(F.inline(copies), "key", tie.alias("tie"), "doc_id", "text")


def next_likeness(docs: DataFrame, scale: int = SCALE, length: int = LENGTH) -> DataFrame:
    """Every text, its edited text and the next text, in descending order of ids, compared.

    The edited text is the text with its last half, rounded down, replaced by as many code points
    from the start of the next text (or all of it); the first row follows the last. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (estimated
    resemblance), kept_in_edited and kept_in_next (share of the text's shingles there).
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for part, visit, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held is None and visit:
                    continue
                own = sketch(text, scale, length)
                if held is not None:
                    _, before, last, mine = held
                    half = len(last) // 2
                    changed = last[:len(last) - half] + text[:half]
                    edited = sketch(changed, scale, length)
                    near, kept, _ = compared(mine, edited)
                    near_next, kept_next, _ = compared(mine, own)
                    out.append((before, len(last), hashlib.sha256(changed.encode()).hexdigest(),
                                encoded(mine), encoded(edited), near, near_next, kept, kept_next))
                held = None if visit else (part, doc, text, own)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 4
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next", "kept_in_edited", "kept_in_next"]
    schema = ", ".join(f"{n} {'long' if i < 2 else 'string' if i < 5 else 'double'}"
                       for i, n in enumerate(names))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(small_batches(docs), 4 * n)
    return (placed.repartition(n, "part")
            .sortWithinPartitions("part", "visit", F.desc("key"), F.desc("tie"), "text")
            .select("part", "visit", "doc_id", "text").mapInArrow(read, schema))
