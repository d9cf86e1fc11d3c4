"""Licence statements by TF-IDF cosine, and inheritance from the nearest licence file above.

A file's own licence is the template with the greatest cosine to one of its lines, to a stretch of its
text as long as a template and around an anchor, or to its whole text if it is a licence file, from
``threshold`` on. Stretches pass over line breaks, so a statement may share its line or be wrapped. Terms are runs of ASCII letters and digits in
lower case. Inverse document frequencies of the templates' terms are counted over all files; a term
that no template has weighs like one that no file has. A line can only reach the threshold if it
has one of a template's anchors: the heaviest terms, without which the rest of the template is too
light. Lines without anchors are passed over, which changes no result.

Files without a licence inherit that of the best licence file in their directory, or else in the
nearest directory above. Directories, not files, are joined with their ancestors.

The templates are a parameter and become constants of the plan; the frequencies of their terms are
as many numbers. Nothing else reaches the driver.

Defined results: NULL and empty texts have no own licence, but inherit. A NULL path has no
directory. Among equally good templates the first by name is taken, among equally good licence files
of a directory the first by path. Repeated rows are treated alike. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import lower_ascii, stored


@dataclass(frozen=True)
class Template:
    name: str
    text: str

    def terms(self) -> Counter:
        return Counter(t for t in re.split("[^a-z0-9]+", self.text.lower()) if t)


# Public licence statements: fixed values.
HEADERS = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("MIT", "Released under the MIT License."),
    Template("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    Template("proprietary", "All rights reserved."),
)


def terms(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda t: t != "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _numbers(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])


def frequencies(files: DataFrame, vocabulary: Sequence[str], text: str) -> tuple[int, dict[str, int]]:
    """Number of files, and of files that have each term of the vocabulary."""
    own = F.array_intersect(terms(F.coalesce(F.col(text), F.lit(""))), _strings(vocabulary))
    rows = (files.select(F.explode(F.concat(own, _strings([""]))).alias("t"))
            .groupBy("t").agg(F.count("*").alias("n")).collect())
    found = {r.t: r.n for r in rows}
    return found.pop("", 0), found


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies, and the templates' vectors scaled to length one."""

    idf: dict[str, float]
    other: float
    vectors: dict[str, dict[str, float]]

    @classmethod
    def of(cls, templates: Sequence[Template], files: int, found: dict[str, int]) -> Weights:
        weigh = lambda n: math.log((1 + files) / (1 + n)) + 1.0
        vocabulary = sorted({t for x in templates for t in x.terms()})
        idf = {t: weigh(found.get(t, 0)) for t in vocabulary}
        vectors = {}
        for x in templates:
            raw = {t: n * idf[t] for t, n in x.terms().items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            vectors[x.name] = {t: w / norm for t, w in raw.items()}
        return cls(idf, weigh(0), vectors)

    def anchors(self, threshold: float) -> list[str]:
        """Terms of which a text needs one to reach the threshold with any template."""
        needed = set()
        for vector in self.vectors.values():
            light = 0.0
            for t, w in sorted(vector.items(), key=lambda tw: (tw[1], tw[0])):
                light += w * w
                if light >= threshold * threshold - 1e-9:
                    needed.add(t)
        return sorted(needed)

    def best(self, own: Column) -> Column:
        """Struct (similarity, rank): the greatest cosine to the terms ``own``, and its template.

        ``rank`` is the negated place in the order of names, so that the first of ties is greatest.
        """
        idf = _numbers(self.idf)
        counted = F.transform(F.array_distinct(own), lambda t: F.struct(
            t.alias("t"), (F.size(F.filter(own, lambda u: u == t))
                           * F.coalesce(F.try_element_at(idf, t), F.lit(self.other))).alias("w")))
        square = F.aggregate(counted, F.lit(0.0), lambda a, c: a + c["w"] * c["w"])

        def dot(vector: dict[str, float]) -> Column:
            weights = _numbers(vector)
            return F.aggregate(counted, F.lit(0.0), lambda a, c: a + c["w"] * F.coalesce(
                F.try_element_at(weights, c["t"]), F.lit(0.0)))
        return F.array_max(F.array(*[F.struct(
            F.round(dot(self.vectors[name]) / F.sqrt(square), 9).alias("similarity"),
            F.lit(-i).alias("rank")) for i, name in enumerate(sorted(self.vectors))]))


def stretches(own: Column, anchors: Column, lengths: Sequence[int]) -> Column:
    """The stretches of ``lengths`` terms that have an anchor, each once."""
    def around(w: Column) -> Column:
        hits = F.array_compact(F.transform(w, lambda t, i: F.when(F.array_contains(anchors, t), i)))
        return F.flatten(F.transform(hits, lambda p: F.flatten(F.array(*[F.transform(
            F.sequence(F.greatest(p - (n - 1), F.lit(0)), p), lambda a: F.slice(w, a + 1, n))
            for n in lengths]))))
    # the terms are bound to a variable, so that they are formed once
    return F.array_distinct(F.flatten(F.transform(F.array(own), around)))


def directory(path: Column) -> Column:
    """Path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def own_licences(files: DataFrame, keep: list[str], weights: Weights, threshold: float, text: str,
                 is_licence_file: Column, lengths: Sequence[int]) -> DataFrame:
    """``keep`` columns, ``path``, ``_file`` (licence file or not) and ``_own`` (or NULL)."""
    anchors = _strings(weights.anchors(threshold))
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(raw, "\n"), terms), lambda t: F.arrays_overlap(t, anchors))
    units = files.select(*keep, "path", is_licence_file.alias("_file"), F.array_distinct(F.concat(
        lines, stretches(terms(raw), anchors, lengths))).alias("_lines"),
                         F.when(is_licence_file, terms(raw)).alias("_whole"))
    units = units.withColumn("_units", F.when(F.size("_whole") > 0, F.concat(
        "_lines", F.array("_whole"))).otherwise(F.col("_lines")))
    best = F.array_max(F.transform("_units", weights.best))
    scored = units.select(*keep, "path", "_file", best.alias("_own"))
    return scored.withColumn("_own", F.when(F.col("_own.similarity") >= threshold, F.col("_own")))


def scan(files: DataFrame, keep: list[str], is_licence_file: Column,
         templates: Sequence[Template] = HEADERS, threshold: float = 0.7,
         text: str = "text") -> DataFrame:
    """``keep`` columns, path, licence, similarity, origin (own, inherited, none), licence_path.

    ``files`` has a column ``path`` with ``/`` between its parts.
    """
    vocabulary = sorted({t for x in templates for t in x.terms()})
    lengths = sorted({sum(x.terms().values()) for x in templates})
    weights = Weights.of(templates, *frequencies(files, vocabulary, text))
    own = stored(own_licences(files, keep, weights, threshold, text, is_licence_file, lengths)
                 .withColumn("_dir", directory(F.col("path"))), "licences")
    named = own.filter(F.col("_file") & F.col("_own").isNotNull()).groupBy(
        F.col("_dir").alias("_at")).agg(F.min(F.struct(
            (-F.col("_own.similarity")).alias("s"), (-F.col("_own.rank")).alias("r"), "path")).alias("_l"))
    above = own.select("_dir").distinct().filter(F.col("_dir").isNotNull())
    parts = F.split("_dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("at")))
    nearest = (above.select("_dir", F.explode(F.array_distinct(steps)).alias("a"))
               .join(named, F.col("a.at") == F.col("_at"))
               .groupBy(F.col("_dir").alias("_d")).agg(F.max_by("_l", "a.depth").alias("_l")))
    nearest = stored(nearest, "directories")
    names = _strings(sorted(x.name for x in templates))
    inherited = F.col("_l").isNotNull()
    has = F.col("_own").isNotNull()
    return own.join(nearest, F.col("_dir") == F.col("_d"), "left").select(
        *keep, "path",
        F.when(has, F.get(names, -F.col("_own.rank"))).when(
            inherited, F.get(names, F.col("_l.r"))).alias("licence"),
        F.when(has, F.col("_own.similarity")).when(inherited, -F.col("_l.s")).alias("similarity"),
        F.when(has, F.lit("own")).when(inherited, F.lit("inherited")).otherwise(F.lit("none"))
        .alias("origin"),
        F.when(has, F.col("path")).when(inherited, F.col("_l.path")).alias("licence_path"))
