"""Line deduplication by levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by their 128-bit hash, with the number of
documents that hold the key and the largest of their ids. A batch of documents is reduced to such
rows, merge-anti-joined with every run (what remains is seen for the first time and becomes the
batch's own run; the others form a second run of increments), and when a level has ``fan_in`` runs
they are merged into one of the next level. No join or merge shuffles the runs again.

A key is a line without the six ASCII blanks at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points in at least ``min_docs`` documents lose their lines everywhere but in the
largest ``doc_id`` that holds them. Other lines stay, joined by a line feed.

Defined results: NULL text counts as one empty line and comes back as empty text. Rows with a NULL
``doc_id`` keep all lines and are not counted. Rows that repeat an id count as one document; each
keeps its own lines. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.common import BLANKS, lower_ascii, stored

KEY = ["h1", "h2"]


class LineRuns:
    """The runs of one corpus, as managed tables of the warehouse, which all executors share.

    The list of runs is the only state on the driver. ``close`` drops the tables.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = 4):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._tables.append(name)
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .format("parquet").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self._tables.remove(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Take in a batch: rows (h1, h2, doc_id), repeated ones allowed, of documents not yet seen."""
        once = lines.select(*KEY, "doc_id").distinct()
        counted = once.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        batch = self._write(counted)
        if not self.runs():
            self.levels[0].append(batch)
            return
        fresh = self.spark.table(batch)
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).select(*KEY), KEY, "left_anti")
        own = self._write(fresh)
        again = self._write(self.spark.table(batch).join(
            self.spark.table(own).select(*KEY), KEY, "left_anti"))
        self._drop(batch)
        self.levels[0] += [own, again]
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fan_in:
                continue
            merged = self._write(self._sum(level))
            for name in level:
                self._drop(name)
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)

    def _sum(self, names: list[str]) -> DataFrame:
        """Merge of runs: full joins of tables that are bucketed and sorted alike."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnsRenamed({"docs": "_docs", "last": "_last"})
            rows = rows.join(other, KEY, "full_outer").select(
                *KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"),
                F.greatest("last", "_last").alias("last"))
        return rows

    def totals(self) -> DataFrame:
        """Rows (h1, h2, docs, last) over all batches."""
        return self._sum(self.runs())

    def close(self) -> None:
        for name in list(self._tables):
            self._drop(name)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, text: str, min_chars: int, batches: int) -> DataFrame:
    """Rows (batch, doc_id, digest, at, h1, h2): the lines whose key is long enough."""
    keys = F.transform(_lines(F.col(text)), lambda line, i: F.struct(
        line_key(line).alias("key"), i.alias("at")))
    rows = (docs.filter(F.col("doc_id").isNotNull())
            .select("doc_id", _digest(F.col(text)).alias("digest"), F.explode(keys).alias("l"))
            .filter(F.char_length("l.key") >= min_chars))
    return rows.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "digest",
        F.col("l.at").alias("at"), F.xxhash64("l.key").alias("h1"),
        F.xxhash64(F.lit(1), "l.key").alias("h2"))


def kept_lines(docs: DataFrame, text: str = "text", min_chars: int = 20, min_docs: int = 3,
               batches: int = 4, fan_in: int = 4) -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept`` (text of the lines that stay), three
    names that ``docs`` may not have.

    ``batches`` cuts the documents by the hash of their id; the result does not depend on it.
    """
    spark = docs.sparkSession
    lines = stored(keyed_lines(docs, text, min_chars, batches), "lines")
    runs = LineRuns(spark, fan_in=fan_in)
    try:
        for b in range(batches):
            runs.add(lines.filter(F.col("batch") == b))
        common = runs.totals().filter(F.col("docs") >= min_docs).select(*KEY, "last")
        common = stored(common, "common-lines")
    finally:
        runs.close()
    dropped = (lines.join(common, KEY).filter(F.col("doc_id") != F.col("last"))
               .groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
               .agg(F.collect_set("at").alias("_at")))
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    t = F.col("_row").getField(text)
    joined = whole.join(dropped, (F.col("_row").getField("doc_id") == F.col("_doc"))
                        & (_digest(t) == F.col("_digest")), "left").withColumn("_lines", _lines(t))
    none = F.array().cast("array<int>")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_at", none))
    cut = joined.select(
        "_row", F.size("_lines").cast("long").alias("_n_lines"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("_n_dropped"),
        F.when(F.col("_at").isNull(), F.coalesce(t, F.lit(""))).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")).alias("_kept"))
    return cut.select("_row.*", "_n_lines", "_n_dropped", "_kept")


def dedup_lines(docs: DataFrame, text: str = "text", length: str = "n_chars",
                **how) -> DataFrame:
    """``docs`` with the text that stays; ``length``, if present, counts its code points."""
    kept = kept_lines(docs, text, **how)
    new = {text: F.col("_kept")}
    if length in docs.columns:
        new[length] = F.char_length("_kept").cast(docs.schema[length].dataType)
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
