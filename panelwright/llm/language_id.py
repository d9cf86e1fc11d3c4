"""Language identification in two levels: the family first, then the languages within it.

A text becomes the square roots of its counts of byte n-grams (one to four bytes of the lower-cased
UTF-8, hashed into a fixed number of cells), scaled to length one. Linear support vector machines,
one for each pair of families and one for each pair of languages of a family, are fitted on a sample
of labelled texts whose size is bounded by ``sample_rows``, the same number for each language, drawn
by a hash of the id. The weights, a fixed number a pair, go to the tasks; every text is then
classified as a whole where it is read.

Defined results: NULL texts and texts without a letter are ``und`` with score 0. Without any
labelled text everything is ``und``; with one language all texts with letters are that one, with
score 1. Languages missing from ``families`` are families of their own. Repeated rows get equal
results; rows with a NULL ``doc_id`` are classified, and not learnt from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import small_batches, text_blocks

CELLS = 1 << 12
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance",
            "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}


def features(data: np.ndarray) -> np.ndarray:
    """Vector of one text, from its bytes."""
    counts = np.zeros(CELLS, np.int64)
    gram = np.zeros(len(data), np.uint32)
    for n in range(4):
        if len(data) <= n:
            break
        gram = (gram[:len(data) - n] * np.uint32(257) + data[n:]) if n else data.astype(np.uint32)
        cell = ((gram + np.uint32(n + 1)) * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount(cell, minlength=CELLS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, edges in text_blocks(column):
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield features(data[a:b])


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by accelerated gradient steps.

    ``y`` is 1 or -1. The last weight is the bias. Both classes count alike, whatever their sizes.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1.0 / (1.0 / c + 4.0)
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x @ v))
        grad = v / c - 2.0 * x.T @ (share * y * slack)
        new = v - step * grad
        v = new + k / (k + 3.0) * (new - w)
        w = new
    return w


@dataclass
class Pairwise:
    """One SVM for each pair of classes; the class that wins most pairs is chosen."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, CELLS + 1)))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Pairwise:
        classes = sorted(set(labels.tolist()))
        weights = []
        for a, b in combinations(classes, 2):
            two = (labels == a) | (labels == b)
            weights.append(fit_svm(x[two], np.where(labels[two] == a, 1.0, -1.0)))
        return cls(classes, np.array(weights).reshape(len(weights), x.shape[1] + 1))

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The class and a score: the logistic of its least margin, 1 if there is no other class."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margin = self.weights[:, :-1] @ x + self.weights[:, -1]
        wins, least = np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for m, (i, j) in zip(margin, combinations(range(len(self.classes)), 2), strict=True):
            wins[i if m >= 0 else j] += 1
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(self.classes)), key=lambda k: (wins[k], least[k]))
        return self.classes[best], float(1.0 / (1.0 + np.exp(-np.clip(4.0 * least[best], -50, 50))))


@dataclass
class LanguageModel:
    families: Pairwise
    languages: dict[str, Pairwise]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, families: Mapping[str, str]) -> LanguageModel:
        of = np.array([families.get(v, v) for v in labels.tolist()])
        return cls(Pairwise.fit(x, of), {f: Pairwise.fit(x[of == f], labels[of == f])
                                         for f in sorted(set(of.tolist()))})

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, sure = self.families.choose(x)
        language, within = self.languages[family].choose(x)
        return language, sure * within


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, sample_rows: int = 1600, families: Mapping[str, str] = FAMILIES,
          text: str = "text", label: str = "lang") -> LanguageModel | None:
    """Fit on at most ``sample_rows`` rows of (doc_id, text, lang), as many of each language."""
    usable = labelled.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                             & has_letter(F.col(text)))
    names = [r[0] for r in usable.select(label).distinct().limit(sample_rows).collect()]
    if not names:
        return None
    order = Window.partitionBy("_label").orderBy("_draw", "doc_id")
    drawn = (usable.select("doc_id", F.col(label).alias("_label"),
                           F.xxhash64(F.lit("sample"), "doc_id").alias("_draw"))
             .withColumn("_n", F.row_number().over(order))
             .filter(F.col("_n") <= max(1, sample_rows // len(names))))
    ids = [r.doc_id for r in drawn.select("doc_id").collect()]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([v.tobytes() for v in _vectors(b.column(1))], pa.binary())],
                ["label", "x"])
    sample = (usable.filter(F.col("doc_id").isin(ids))
              .select(F.col(label).alias("label"), F.lower(F.col(text)))
              .mapInArrow(vectors, "label string, x binary").limit(2 * sample_rows).collect())
    sample = sorted((r.label, bytes(r.x)) for r in sample)
    x = np.array([np.frombuffer(raw, np.float32) for _, raw in sample])
    return LanguageModel.fit(x, np.array([v for v, _ in sample]), families)


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str],
             text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``."""
    base = small_batches(docs).select(*keep, has_letter(F.col(text)).alias("_letter"),
                       F.lower(F.col(text)).alias("_text"))
    names = [*keep, "lang_pred", "score"]
    kept = base.select(*keep).schema
    schema = kept.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            letter = b.column(b.num_columns - 2).to_pylist()
            out = [model.predict(v) if ok and model else ("und", 0.0)
                   for ok, v in zip(letter, _vectors(b.column(b.num_columns - 1)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.float64())], names)
    return base.mapInArrow(classify, schema)
