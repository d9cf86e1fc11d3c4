"""Feature collections: JSON documents of any size, read and written by several tasks each.

A document is cut at every closing brace, where a text source can also split a file. Whether a
piece starts inside a string, and how deep in braces it starts, follows from all pieces before
it. Each split of a file is first summed up in one row (parity of its quotes, change of depth if
it starts outside or inside a string); running sums over these rows give the state at the start
of each split, and a window inside the split gives it for each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from panelwright.runtime import stored

_FILE = ["path", "block"]
# Stands before a piece that starts inside a string, so that its first quote closes one.
_OPEN = '"~'


def _rows_to(last: int) -> WindowSpec:
    """The pieces of a block up to this one (0) or the one before it (-1)."""
    return Window.partitionBy(*_FILE).orderBy("place").rowsBetween(Window.unboundedPreceding, last)


def _blocks_before() -> WindowSpec:
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _outside(text: Column) -> Column:
    """``text``, which starts outside strings, with the inside of each string blotted out."""
    parts = F.split(text, '"', -1)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 0, part).otherwise(
        F.repeat(F.lit("~"), F.length(part)))), '"')


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, block, place (order within the block), raw, plain (escapes blotted out)."""
    raw = F.concat("value", F.lit("}"))
    return spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), raw.alias("raw"),
        F.regexp_replace(raw, r"\\.", "~~").alias("plain"))


def _change(plain: Column) -> Column:
    seen = _outside(plain)
    return _count(seen, "{") - _count(seen, "}")


def _block_states(pieces: DataFrame) -> DataFrame:
    """path, block, inside (0 or 1: starts in a string), depth (braces open at the start)."""
    counted = pieces.select(
        *_FILE, "place", (_count(F.col("plain"), '"') % 2).alias("odd"),
        _change(F.col("plain")).alias("change_0"),
        _change(F.concat(F.lit(_OPEN), "plain")).alias("change_1"))
    inside = F.coalesce(F.sum("odd").over(_rows_to(-1)), F.lit(0)) % 2
    sums = counted.withColumn("inside", inside).groupBy(*_FILE).agg(
        (F.sum("odd") % 2).alias("odd"),
        F.sum(F.when(F.col("inside") == 0, F.col("change_0")).otherwise(F.col("change_1"))).alias("change_0"),
        F.sum(F.when(F.col("inside") == 0, F.col("change_1")).otherwise(F.col("change_0"))).alias("change_1"))
    started = sums.withColumn(
        "inside", F.coalesce(F.sum("odd").over(_blocks_before()), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("change_0")).otherwise(F.col("change_1"))
    return started.withColumn("change", change).select(
        *_FILE, F.col("inside").alias("block_inside"),
        F.coalesce(F.sum("change").over(_blocks_before()), F.lit(0)).alias("block_depth"))


def _placed(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with what they hold of an object of the second level.

    path, block, place, text (NULL outside such objects), starts (0 or 1: an object starts
    here), object (how many started in this block so far), member (last name of a member of the
    document in this block so far).
    """
    inside = (F.col("block_inside") + F.coalesce(F.sum("odd").over(_rows_to(-1)), F.lit(0))) % 2
    known = (pieces.join(states, _FILE).withColumn("odd", _count(F.col("plain"), '"') % 2)
             .withColumn("inside", inside))
    opener = F.when(F.col("inside") == 1, F.lit(_OPEN)).otherwise(F.lit(""))
    known = (known.withColumn("plain", F.concat(opener, "plain"))
             .withColumn("raw", F.concat(opener, "raw"))
             .withColumn("seen", _outside(F.col("plain")))
             .withColumn("opens", _count(F.col("seen"), "{"))
             .withColumn("change", F.col("opens") - _count(F.col("seen"), "}")))
    known = known.withColumn("depth", F.col("block_depth")
                             + F.coalesce(F.sum("change").over(_rows_to(-1)), F.lit(0)))
    # Braces close at the end of a piece only, so an object starts at most once in it.
    within = F.col("depth") + F.col("opens") >= 2
    starts = within & (F.col("depth") < 2)
    first = F.locate("{", F.col("seen"))
    at = F.when(F.col("depth") == 1, first).otherwise(F.expr("locate('{', seen, locate('{', seen) + 1)"))
    known = known.withColumn("within", within).withColumn("starts", starts).withColumn("at", at)
    # What lies on the first level: all of a piece before an object, or a piece without any.
    top = F.when(F.col("starts"), F.substring("plain", F.lit(1), F.col("at") - 1)).when(
        ~F.col("within"), F.col("plain"))
    names = F.filter(F.regexp_extract_all(top, F.lit(r'"[^"]*"(\s*:)?'), F.lit(0)),
                     lambda name: name.endswith(":"))
    name = F.regexp_extract(F.try_element_at(names, F.lit(-1)), r'"([^"]*)"', 1)
    text = F.when(F.col("starts"), F.substring("raw", F.col("at"), F.length("raw"))).when(
        F.col("within"), F.substring("raw", F.length(opener) + 1, F.length("raw")))
    return known.select(
        *_FILE, "place", text.alias("text"), F.col("starts").cast("int").alias("starts"),
        F.sum(F.col("starts").cast("int")).over(_rows_to(0)).alias("object"),
        F.last(name, ignorenulls=True).over(_rows_to(0)).alias("member"))


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """path, feature: the JSON text of each object in the member ``features`` of each document.

    ``path`` is a file or a folder of files in UTF-8, each one JSON object. Elements of
    ``features`` that are no objects, and files without that member, give no row. No task holds
    more than a split of a file, and no row more than a feature.
    """
    pieces = _pieces(spark, path)
    states = stored(_block_states(pieces), "json-blocks")
    placed = stored(_placed(pieces, states), "json-pieces")
    blocks = placed.groupBy(*_FILE).agg(
        F.sum("starts").alias("objects"), F.max_by("member", "place").alias("last"))
    offsets = stored(blocks.select(
        *_FILE, F.coalesce(F.sum("objects").over(_blocks_before()), F.lit(0)).alias("objects_before"),
        F.last("last", ignorenulls=True).over(_blocks_before()).alias("member_before")), "json-offsets")
    numbered = placed.where("text IS NOT NULL").join(offsets, _FILE).where(
        F.coalesce("member", "member_before") == "features").select(
            "path", (F.col("objects_before") + F.col("object")).alias("object"),
            F.struct(*_FILE[1:], "place", "text").alias("piece"))
    return numbered.groupBy("path", "object").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select(
        "path", F.array_join(F.col("pieces.text"), "").alias("feature"))


def write_collections(features: DataFrame, path: str, key: str, feature: str,
                      features_per_file: int = 100_000) -> str:
    """Feature collections of about ``features_per_file`` features, one document a file.

    ``feature`` is a column of JSON texts; rows where it is NULL are left out. ``key`` deals the
    features out and orders them within a document. No features, no document.
    """
    rows = features.select(F.col(key).alias("key"), F.col(feature).alias("feature")).where(
        "feature IS NOT NULL")
    count = max(1, -(-rows.count() // features_per_file))
    dealt = rows.withColumn("document", F.pmod(F.xxhash64("key", "feature"), F.lit(count)))
    ordered = Window.partitionBy("document").orderBy("key", "feature")
    number = F.row_number().over(ordered)
    is_last = F.lead(F.lit(True)).over(ordered).isNull()
    lines = dealt.select("document", F.concat(
        F.when(number == 1, F.lit('{"type": "FeatureCollection", "features": [\n')).otherwise(F.lit("")),
        "feature", F.when(is_last, F.lit("\n]}")).otherwise(F.lit(","))).alias("value"))
    lines.write.partitionBy("document").text(path)
    return path
