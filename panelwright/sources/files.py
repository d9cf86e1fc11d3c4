"""CSV with text keys, GeoJSON features, model inputs and outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelwright.sources.geojson import collection_features


# How this library writes text so that every value comes back: NULL apart from empty text, quotes
# doubled, and line breaks and backslashes escaped, so that files can still be split at lines.
_EXACT = {"header": True, "escape": '"', "nullValue": "\\N", "charToEscapeQuoteEscaping": '"'}


def _escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescaped(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def read_keyed_csv(spark: SparkSession, path: str, text_keys: Sequence[str],
                   types: Mapping[str, str] | None = None, exact: bool = False) -> DataFrame:
    """CSV with a header whose key columns stay text, so leading zeros survive.

    Other columns are cast by ``types`` or else stay text; nothing is inferred. ``exact`` reads
    what ``write_csv`` wrote with ``exact``.
    """
    raw = spark.read.options(**(_EXACT if exact else {"header": True})).csv(path)
    if exact:
        raw = raw.select(*[_unescaped(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    wanted = dict(types or {})
    clash = set(text_keys) & set(wanted)
    if clash:
        raise ValueError(f"keys are text and take no type: {sorted(clash)}")
    missing = [c for c in (*text_keys, *wanted) if c not in raw.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return raw.select(*[F.col(c).cast(wanted[c]) if c in wanted else F.col(c) for c in raw.columns])


def feature_schema(properties: str) -> T.StructType:
    """One GeoJSON feature with the given property columns; coordinates stay JSON text."""
    return (T.StructType().add("type", "string").add("id", "string")
            .add("properties", T._parse_datatype_string(properties))
            .add("geometry", T.StructType().add("type", "string").add("coordinates", "string")))


def read_geojson(spark: SparkSession, path: str, properties: str,
                 one_feature_per_line: bool = False) -> DataFrame:
    """Features as rows (id, properties, geometry).

    A file with one feature per line is split like any text. Otherwise each file is a feature
    collection, and large ones are read by several tasks as well (``sources.geojson``).
    """
    feature = feature_schema(properties)
    if one_feature_per_line:
        features = spark.read.schema(feature).json(path)
    else:
        features = collection_features(spark, path).select(
            F.from_json("feature", feature).alias("f")).select("f.*")
    return features.select("id", "properties", "geometry")


def write_csv(df: DataFrame, path: str, exact: bool = False) -> str:
    """A folder of CSV files with headers.

    With ``exact``, text comes back unchanged from ``read_keyed_csv(..., exact=True)``, line breaks,
    quotes, backslashes, empty text and NULL included.
    """
    if exact:
        df = df.select(*[_escaped(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")
                         for c, t in df.dtypes])
    df.write.mode("overwrite").options(**(_EXACT if exact else {"header": True})).csv(path)
    return path


def read_inputs(spark: SparkSession, paths: Mapping[str, str], name: str,
                text_keys: Sequence[str], types: Mapping[str, str],
                exact: bool = False) -> DataFrame:
    """One of several named model inputs, as Parquet or as CSV by its file ending."""
    path = paths[name]
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_keyed_csv(spark, path, text_keys, types, exact)


def write_model_outputs(scored: DataFrame, key: str, columns: Mapping[str, str], folder: str,
                        prefix: str) -> dict[str, str]:
    """One CSV folder per model output, each row with its own key."""
    return {
        name: write_csv(scored.select(key, column), f"{folder.rstrip('/')}/{prefix}_{name}", exact=True)
        for name, column in columns.items()}
