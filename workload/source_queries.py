"""Tables, CSV and GeoJSON: what is written is read back and compared with its origin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright.operators.feeds import map_rows, with_shapes
from panelwright.runtime import scratch_path
from panelwright.sources import files, geojson, tables
from workload import standins as st
from workload.registry import query, round_all, table


def _fresh(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


@query("A1", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1""")
def run_query(spark, sf):
    view = _fresh("orders")
    table(spark, sf, "orders").createOrReplaceTempView(view)
    return round_all(tables.run_query(
        spark, f"SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM {view} GROUP BY 1"), 2)


@query("A3", """
SELECT name, CAST(position AS INTEGER) AS position, n FROM (
  SELECT * FROM (SELECT 0 AS position, 'c_custkey' AS name, count(c_custkey) AS n FROM customer)
  UNION ALL SELECT 1, 'c_name', count(c_name) FROM customer
  UNION ALL SELECT 2, 'c_nationkey', count(c_nationkey) FROM customer
  UNION ALL SELECT 3, 'c_acctbal', count(c_acctbal) FROM customer
  UNION ALL SELECT 4, 'c_mktsegment', count(c_mktsegment) FROM customer)""")
def list_columns(spark, sf):
    """Names and positions of a table's columns, with the values each one holds."""
    view = _fresh("customer")
    table(spark, sf, "customer").createOrReplaceTempView(view)
    names = tables.columns(spark, view)
    counts = spark.table(view).agg(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.count(c).alias("n"))
        for i, c in enumerate(names)]).alias("found"))
    return counts.select(F.inline("found"))


@query("A6 A9", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def load_from_frame(spark, sf):
    name = tables.load_table(spark, _fresh("supplier"), df=table(spark, sf, "supplier"),
                             path=scratch_path(spark, "supplier"))
    return tables.read_table(spark, name)


@query("A7 A9", "SELECT p_brand, count(*) AS parts, max(p_retailprice) AS dearest FROM part GROUP BY 1")
def load_from_query(spark, sf):
    view = _fresh("part")
    table(spark, sf, "part").createOrReplaceTempView(view)
    name = tables.load_table(
        spark, _fresh("brands"), path=scratch_path(spark, "brands"),
        query=f"SELECT p_brand, count(*) AS parts, max(p_retailprice) AS dearest FROM {view} GROUP BY 1")
    return tables.read_table(spark, name)


@query("A8 A9", """
SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def load_from_csv(spark, sf):
    """Types inferred from the file: keys come back as plain integers."""
    written = files.write_csv(table(spark, sf, "part"), scratch_path(spark, "part-csv"))
    name = tables.load_table(spark, _fresh("part"), file=written, path=scratch_path(spark, "part"))
    return tables.read_table(spark, name)


@query("A5 A9", """
SELECT 'replaced' AS mode, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM
  (SELECT c_nationkey AS n_nationkey FROM customer)
UNION ALL SELECT 'appended', 2 * count(*), 2 * sum(c_nationkey)::BIGINT FROM customer
UNION ALL SELECT 'dropped', count(*), sum(c_nationkey)::BIGINT FROM customer""")
def load_modes(spark, sf):
    """Loading twice replaces; loading without overwrite appends, unless the table was dropped
    between; dropping a missing table is fine."""
    keys = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    tables.drop_table(spark, _fresh("absent"))
    once, twice, dropped = _fresh("replaced"), _fresh("appended"), _fresh("dropped")
    for part in ("first", "second"):
        tables.drop_table(spark, dropped)
        tables.load_table(spark, dropped, df=keys, overwrite=False,
                          path=scratch_path(spark, f"dropped-{part}"))
    for name, overwrite in ((once, True), (twice, False)):
        place = scratch_path(spark, name)
        tables.load_table(spark, name, df=keys, path=place)
        tables.load_table(spark, name, df=keys, overwrite=overwrite, path=place)

    def counted(name: str, mode: str):
        return spark.table(name).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"),
                                     F.sum("n_nationkey").alias("keys"))
    return counted(once, "replaced").unionByName(counted(twice, "appended")).unionByName(
        counted(dropped, "dropped"))


@query("A4 A6", "SELECT least(count(*), 10) AS previewed FROM customer")
def preview(spark, sf):
    """Rows of a preview that are different rows of the table."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name")
    name = tables.load_table(spark, _fresh("people"), df=people, path=scratch_path(spark, "people"))
    some = tables.head(spark, name, 10, show=False)
    return some.join(people, ["c_custkey", "c_name"], "left_semi").distinct().agg(
        F.count("*").alias("previewed"))


def _awkward():
    """Names with line breaks, quotes and backslashes, empty ones and NULL."""
    turn = F.col("c_custkey") % 5
    return F.when(turn == 0, F.concat("c_name", F.lit('\n"quoted", \r\\n'))).when(
        turn == 1, F.lit("")).when(turn == 2, F.lit(None)).when(turn == 3, F.lit("\\N")).otherwise(
            F.col("c_name"))


@query("A10 A14", f"""
SELECT {st._key_sql('c_custkey')} AS fips, CASE c_custkey % 5
  WHEN 0 THEN c_name || chr(10) || '"quoted", ' || chr(13) || chr(92) || 'n' WHEN 1 THEN ''
  WHEN 2 THEN NULL WHEN 3 THEN chr(92) || 'N' ELSE c_name END AS c_name, c_acctbal FROM customer""")
def csv_text_key(spark, sf):
    people = table(spark, sf, "customer").select(
        st.county_key("c_custkey").alias("fips"), _awkward().alias("c_name"), "c_acctbal")
    written = files.write_csv(people, scratch_path(spark, "fips-csv"), exact=True)
    return files.read_inputs(spark, {"primary": written}, "primary", ["fips"],
                             {"c_acctbal": "double"}, exact=True)


def _feature_columns(spark, sf):
    """Customers as GeoJSON features; the place is made of key and nation."""
    point = F.array(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 180).cast("double"))
    return table(spark, sf, "customer").select(
        F.lit("Feature").alias("type"), st.county_key("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("NAME"), F.col("c_nationkey").alias("STATE")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"))


def _features(spark, sf, label: str) -> str:
    """One feature per line."""
    path = scratch_path(spark, label)
    _feature_columns(spark, sf).write.json(path)
    return path


_FEATURES_SQL = f"""
SELECT {st._key_sql('c_custkey')} AS id, c_name AS name, c_nationkey AS state, 'Point' AS shape,
       '[' || CAST(c_nationkey AS DOUBLE) || ',' || CAST(c_custkey % 180 AS DOUBLE) || ']' AS coordinates
FROM customer"""


def _flat(found):
    return found.select("id", F.col("properties.NAME").alias("name"), F.col("properties.STATE").alias("state"),
                        F.col("geometry.type").alias("shape"), F.col("geometry.coordinates").alias("coordinates"))


@query("A11", _FEATURES_SQL)
def geojson_features(spark, sf):
    found = files.read_geojson(spark, _features(spark, sf, "shapes"), "NAME string, STATE int",
                               one_feature_per_line=True)
    return _flat(found)


@query("A11", _FEATURES_SQL)
def geojson_collection(spark, sf):
    """Feature collections, each one JSON document that several tasks read."""
    features = _feature_columns(spark, sf)
    texts = features.select("id", F.to_json(F.struct(*features.columns)).alias("feature"))
    path = geojson.write_collections(texts, scratch_path(spark, "collections"), "id", "feature")
    return _flat(files.read_geojson(spark, path, "NAME string, STATE int"))


@query("A11 D9 J2", f"""
WITH v AS (SELECT {st._key_sql('user_id')} AS id, sqrt(avg(value * value)) AS size FROM events GROUP BY 1)
SELECT id, round(least(greatest(size, 60), 75), 6) + 0.0 AS colour, printf('%.4f', size) AS "Size ",
       c_name AS name FROM v LEFT JOIN customer ON {st._key_sql('c_custkey')} = id""")
def map_with_shapes(spark, sf):
    shapes = files.read_geojson(spark, _features(spark, sf, "map"), "NAME string, STATE int",
                                one_feature_per_line=True)
    sizes = table(spark, sf, "events").groupBy("user_id").agg(
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("size"))
    keyed = sizes.withColumn("id", st.county_key("user_id"))
    rows = map_rows(keyed, "id", "size", (60.0, 75.0), {"size": "Size "}, {"size": 4})
    named = shapes.select("id", F.col("properties.NAME").alias("name"))
    return round_all(with_shapes(rows, named, "id"))
