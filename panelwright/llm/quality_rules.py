"""Quality rules whose thresholds follow each language and source.

Every text is measured once. Texts that pass two base rules feed quantile sketches per
(lang, source) and measure; the sketches' quartiles give fences, and a join brings each row the
fences of its group, which decide.

The sketch is a histogram over log-linear buckets of whole numbers: exact below 64, 32 buckets per
doubling above, so a quantile is off by 3 % at most. Two sketches merge by adding counts. The
result therefore does not depend on partitions or on retried tasks, and a source that holds a
third of all rows is summed on the map side like any other.

Defined results: a NULL, empty or blank text has no words and fails the base rules. NULL ``lang``
or ``source`` form groups of their own. Groups with fewer than ``min_rows`` passing texts use the
merged sketch of their language, then that of the whole table; if that is as small, no fence
applies. Repeated rows are judged one by one and alike. Other columns of the input are ignored by
``measured`` and kept by ``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import BLANKS, stored, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Base limits, the reach of the fences, and the least spread of each measure.

    ``reach`` spreads beyond the quartiles a text is rejected. A spread is the distance of the
    quartiles, at least ``least_*``: thousandths of a character, or ten-thousandths of the words or
    lines. It keeps groups of even texts from rejecting ordinary variation.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    reach: int = 3
    min_rows: int = 30
    least_word_length: int = 500
    least_symbols: int = 300
    least_dup_lines: int = 1000
    least_repeats: int = 1000

    def least(self) -> dict[str, int]:
        return {"word_length": self.least_word_length, "symbols": self.least_symbols,
                "dup_lines": self.least_dup_lines, "repeats": self.least_repeats}


MEASURES = ["word_length", "symbols", "dup_lines", "repeats"]


def _without(text: str, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, ""))


def measured(docs: DataFrame, keep: list[str], text: str = "text",
             rules: Rules = Rules()) -> DataFrame:
    """``keep`` columns, the counts of each text, the measures and ``base_failed``."""
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = t.withColumns({"_w": words("_t"), "_l": F.filter(
        F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")})
    t = t.withColumns({
        "_h": F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
        "n_words": F.size("_w").cast("long"),
        "word_chars": _without("_t", BLANKS).cast("long"),
        "n_symbols": (F.char_length("_t") - _without("_t", _SYMBOLS)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    }).drop("_t", "_w", "_l")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    t = t.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(empty)).drop("_h")
    twice = F.transform("_s", lambda s, k: F.when(
        F.get("_s", k - 1)["h"].eqNullSafe(s["h"]) | F.get("_s", k + 1)["h"].eqNullSafe(s["h"]),
        s["i"]))
    t = t.withColumn("_d", F.sort_array(F.array_compact(twice))).drop("_s")
    covered = F.transform("_d", lambda p, k: F.least(
        F.lit(3), F.coalesce(F.get("_d", k + 1) - p, F.lit(3))))
    t = t.withColumn("n_repeat_words", F.aggregate(
        covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_d")
    share = lambda part, whole, unit: F.when(
        F.col(whole) > 0, F.floor(F.col(part) * unit / F.col(whole))).otherwise(0).cast("long")
    return t.withColumns({
        "word_length": share("word_chars", "n_words", 1000),
        "symbols": share("n_symbols", "n_words", 10_000),
        "dup_lines": share("n_dup_lines", "n_lines", 10_000),
        "repeats": share("n_repeat_words", "n_words", 10_000),
        "base_failed": (F.col("n_words") < rules.min_words) | (
            100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    })


def bucket(value: str) -> Column:
    """Log-linear bucket of a whole number."""
    return F.when(F.col(value) < 64, F.col(value)).otherwise(F.expr(
        f"32 * (length(bin({value})) - 6) + shiftright({value}, length(bin({value})) - 6)")).cast("int")


def bucket_low(b: Column) -> Column:
    """Least number of a bucket."""
    shift = F.greatest(F.floor(b / 32).cast("int") - 1, F.lit(0))
    return F.when(b < 64, b.cast("long")).otherwise(
        (F.lit(32).cast("long") + b % 32) * F.pow(F.lit(2), shift).cast("long"))


def sketches(stats: DataFrame) -> DataFrame:
    """Rows (lang, source, measure, bucket, n) over the texts that pass the base rules."""
    long = stats.filter(~F.col("base_failed")).unpivot(
        ["lang", "source"], MEASURES, "measure", "value")
    return long.groupBy("lang", "source", "measure", bucket("value").alias("bucket")).agg(
        F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and measure: rows, and the least numbers of the buckets that hold the quartiles.

    A group has no more buckets than the measure has, about 2,000, so its array is bounded.
    """
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    cells = merged.groupBy(*keys, "measure").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"),
        F.sum("n").alias("rows"))

    def at(quarters: int) -> Column:
        found = F.aggregate(
            "cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("b")),
            lambda a, c: F.struct(
                (a["seen"] + c["n"]).alias("seen"),
                F.when((a["b"] < 0) & (4 * (a["seen"] + c["n"]) >= quarters * F.col("rows")),
                       c["bucket"]).otherwise(a["b"]).alias("b")))
        return bucket_low(found["b"])
    return cells.select(*keys, "measure", "rows", at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (lang, source): ``low_<measure>`` and ``high_<measure>``, inclusive."""
    levels = [_quartiles(sketch, keys) for keys in (["lang", "source"], ["lang"], [])]
    own, of_lang, of_all = [
        q.select(*[F.col(k).alias(f"{k}_{i}") for k in q.columns if k in ("lang", "source")],
                 F.col("measure").alias(f"m_{i}"), F.col("rows").alias(f"rows_{i}"),
                 F.struct("q1", "q3").alias(f"q_{i}")) for i, q in enumerate(levels)]
    q = (own.join(of_lang, F.col("lang_0").eqNullSafe(F.col("lang_1")) & (F.col("m_0") == F.col("m_1")))
         .join(of_all, F.col("m_0") == F.col("m_2")))
    chosen = F.when(F.col("rows_0") >= rules.min_rows, F.col("q_0")).when(
        F.col("rows_1") >= rules.min_rows, F.col("q_1")).when(
        F.col("rows_2") >= rules.min_rows, F.col("q_2"))
    q = q.select(F.col("lang_0").alias("_lang"), F.col("source_0").alias("_source"),
                 F.col("m_0").alias("m"), chosen.alias("q"))
    least = F.create_map(*[F.lit(x) for kv in rules.least().items() for x in kv])
    reach = rules.reach * F.greatest(F.col("q")["q3"] - F.col("q")["q1"], least[F.col("m")])
    q = q.select("_lang", "_source", "m", (F.col("q")["q1"] - reach).alias("low"),
                 (F.col("q")["q3"] + reach).alias("high"))
    return q.groupBy("_lang", "_source").agg(*[
        F.max(F.when(F.col("m") == m, F.col(side))).alias(f"{side}_{m}")
        for m in MEASURES for side in ("low", "high")])


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``kept``."""
    within = [F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
              for m in MEASURES]
    inside = within[0]
    for w in within[1:]:
        inside = inside & w
    joined = stats.join(limits, stats["lang"].eqNullSafe(limits["_lang"])
                        & stats["source"].eqNullSafe(limits["_source"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source")


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): counts, fences and ``kept``."""
    stats = stored(measured(docs, ["doc_id", "lang", "source"], rules=rules), "quality")
    return judged(stats, stored(fences(sketches(stats), rules), "fences"))


def quality_filter(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The verdict comes back to the texts by (doc_id, digest of text), so rows that repeat an id with
    another text get their own.
    """
    digest = F.xxhash64(F.col("text"))
    named = docs.select("doc_id", "lang", "source", "text", digest.alias("_digest"))
    stats = stored(measured(named, ["doc_id", "lang", "source", "_digest"], rules=rules), "quality")
    good = judged(stats, stored(fences(sketches(stats), rules), "fences")).filter("kept")
    mark = "_k"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_k"
    good = good.select(*[F.col(c).alias(f"{mark}_{c}") for c in ("doc_id", "_digest", "lang", "source")])
    on = F.lit(True)
    for c in ("doc_id", "lang", "source"):
        on = on & F.col(c).eqNullSafe(F.col(f"{mark}_{c}"))
    return docs.join(good, (digest == F.col(f"{mark}__digest")) & on, "left_semi")
