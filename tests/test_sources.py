import json

import pytest
from pyspark.sql import functions as F

from panelwright.operators.feeds import clamped, map_rows, scatter_rows, with_shapes
from panelwright.runtime import scratch_path
from panelwright.sources import files, geojson, tables


def _rows(spark, n=3):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("v"))


def test_load_replaces_appends_and_previews(spark, capsys):
    assert tables.load_table(spark, "loaded", df=_rows(spark), preview_rows=2) == "loaded"
    tables.load_table(spark, "loaded", df=_rows(spark, 5))
    assert tables.read_table(spark, "loaded").count() == 5
    tables.load_table(spark, "loaded", df=_rows(spark), overwrite=False)
    assert spark.table("loaded").count() == 8
    assert tables.columns(spark, "loaded") == ["k", "v"]
    assert tables.head(spark, "loaded", 4).count() == 4
    tables.drop_table(spark, "loaded")
    tables.drop_table(spark, "loaded")
    assert not spark.catalog.tableExists("loaded")


def test_load_takes_frame_before_query_before_file(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text("k,v\n7,1.5\n8,x\n")
    tables.load_table(spark, "t1", df=_rows(spark, 2), query="SELECT 1 AS k", file=str(csv))
    assert spark.table("t1").count() == 2
    tables.load_table(spark, "t1", query="SELECT 1 AS k", file=str(csv))
    assert [tuple(r) for r in spark.table("t1").collect()] == [(1,)]
    tables.load_table(spark, "t1", file=str(csv))
    assert dict(spark.table("t1").dtypes) == {"k": "int", "v": "string"}
    tables.load_table(spark, "t1", file=str(csv), schema="k long, v string")
    assert dict(spark.table("t1").dtypes) == {"k": "bigint", "v": "string"}
    with pytest.raises(ValueError):
        tables.load_table(spark, "t1")
    tables.drop_table(spark, "t1")


def test_statement_without_rows_gives_an_empty_frame(spark):
    assert tables.run_query(spark, "CREATE TABLE made (k INT) USING parquet").count() == 0
    assert tables.columns(spark, "made") == ["k"]
    tables.drop_table(spark, "made")


def test_text_keys_keep_their_zeros(spark, tmp_path):
    csv = tmp_path / "fips.csv"
    csv.write_text("fips,unemp\n01001,5.3\n56045,4.1\n")
    found = files.read_keyed_csv(spark, str(csv), ["fips"], {"unemp": "double"})
    assert [tuple(r) for r in found.collect()] == [("01001", 5.3), ("56045", 4.1)]
    with pytest.raises(ValueError):
        files.read_keyed_csv(spark, str(csv), ["fips"], {"fips": "int"})
    with pytest.raises(ValueError):
        files.read_keyed_csv(spark, str(csv), ["county"])


def test_inputs_by_name(spark, tmp_path):
    place = str(tmp_path / "alt1.parquet")
    _rows(spark).write.parquet(place)
    csv = tmp_path / "primary.csv"
    csv.write_text("k,v\n007,2.5\n")
    paths = {"alt1": place, "primary": str(csv)}
    assert files.read_inputs(spark, paths, "alt1", ["k"], {}).count() == 3
    assert files.read_inputs(spark, paths, "primary", ["k"], {"v": "double"}).first()["k"] == "007"
    with pytest.raises(KeyError):
        files.read_inputs(spark, paths, "alt9", ["k"], {})


@pytest.mark.parametrize("per_line", [False, True])
def test_geojson_features_join_by_key(spark, tmp_path, per_line):
    features = [
        {"type": "Feature", "id": f"0100{i}", "properties": {"STATE": "01", "NAME": f"n{i}"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [0, i], [i, i], [0, 0]]]}}
        for i in (1, 2)]
    text = ("\n".join(json.dumps(f) for f in features) if per_line
            else json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    place = tmp_path / "shapes.json"
    place.write_text(text)
    found = files.read_geojson(spark, str(place), "STATE string, NAME string", per_line)
    assert found.columns == ["id", "properties", "geometry"] and found.count() == 2
    first = found.filter("id = '01001'").first()
    assert first["properties"]["NAME"] == "n1"
    assert json.loads(first["geometry"]["coordinates"]) == [[[0, 0], [0, 1], [1, 1], [0, 0]]]
    values = spark.createDataFrame([("01001", 9.0), ("99999", None)], "id string, v double")
    rows = map_rows(values, "id", "v", (-7, 7), {"v": "Value "}, {"v": 4})
    joined = {r["id"]: r for r in with_shapes(rows, found, "id").collect()}
    assert joined["01001"]["colour"] == 7.0 and joined["01001"]["Value "] == "9.0000"
    assert joined["01001"]["geometry"]["type"] == "Polygon"
    assert joined["99999"]["geometry"] is None and joined["99999"]["colour"] is None


def test_model_outputs_are_written_under_their_keys(spark):
    scored = spark.createDataFrame([("01001", 0.5, 1.5), ("01003", -0.5, 2.5)],
                                   "fips string, residual double, yhat double")
    written = files.write_model_outputs(
        scored, "fips", {"residuals": "residual", "predict": "yhat"}, scratch_path(spark, "o"), "alt1")
    found = files.read_keyed_csv(spark, written["predict"], ["fips"], {"yhat": "double"}, exact=True)
    assert sorted(map(tuple, found.collect())) == [("01001", 1.5), ("01003", 2.5)]
    assert written["residuals"].endswith("alt1_residuals")


def test_scatter_rows_and_clamp(spark):
    rows = spark.createDataFrame([(1.0, 2, 3.0, 9.0)], "x double, p int, q double, s double")
    found = scatter_rows(rows, "x", ["p", "q"], "s").collect()
    assert sorted(map(tuple, found)) == [(1.0, 9.0, "p", 2.0), (1.0, 9.0, "q", 3.0)]
    assert tuple(rows.select(clamped("x", 2, 5), clamped("s", 2, 5)).first()) == (2.0, 5.0)


def _awkward_collection():
    names = ['plain', '}{', '"', '\\', '\\"}', '"features":[{', 'é}ü', '', '\n}', '}"}', '\\\\{"', '[{}]']
    features = [
        {"type": "Feature", "id": str(i), "properties": {"NAME": name + names[-1 - i % len(names)], "AT": {"n": i}},
         "geometry": {"type": "Point", "coordinates": [[i, j] for j in range(i % 7)]}}
        for i, name in enumerate(names * 3)]
    return {"type": "FeatureCollection", "name": 'a}b "features": [{', "bbox": [1, 2], "crs": {"id": "none", "in": {}},
            "other": [{"id": "no"}, {"id": "no}"}], "features": features, "note": {"id": "}"}, "more": ["}", {}]}


@pytest.mark.parametrize("split, indent", [(31, None), (53, 2), (400, None), (100_000, 2)])
def test_geojson_document_is_split_anywhere(spark, tmp_path, split, indent):
    document = _awkward_collection()
    for part, ending in (("a", ""), ("b", "\n")):
        (tmp_path / f"{part}.json").write_text(
            json.dumps(document, indent=indent, ensure_ascii=part == "a") + ending, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        raw = spark.read.text(str(tmp_path), lineSep="}")
        assert (raw.rdd.getNumPartitions() > 5) == (split < 1000)
        found = files.read_geojson(spark, str(tmp_path), "NAME string, AT struct<n: int>").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r["id"], r["properties"]["NAME"], r["properties"]["AT"]["n"], r["geometry"]["type"],
                  json.dumps(json.loads(r["geometry"]["coordinates"]))) for r in found)
    want = sorted((f["id"], f["properties"]["NAME"], f["properties"]["AT"]["n"], "Point",
                   json.dumps(f["geometry"]["coordinates"])) for f in document["features"] * 2)
    assert got == want


@pytest.mark.parametrize("text, rows", [
    ('{"type": "FeatureCollection", "features": []}', 0), ('{}', 0), ("", 0), ('{"features": null}', 0),
    ('{"features": [{}, null, 3, {"id": "x"}]}\n\n', 2), ('{"type": "Feature", "id": "1", "properties": {"a": {}}}', 0)])
def test_geojson_documents_with_little_in_them(spark, tmp_path, text, rows):
    (tmp_path / "one.json").write_text(text)
    assert files.read_geojson(spark, str(tmp_path / "one.json"), "NAME string").count() == rows


def test_collections_are_written_in_several_documents(spark, tmp_path):
    rows = spark.range(50).select("id", F.when(F.col("id") != 7, F.format_string(
        '{"type": "Feature", "id": "%d", "properties": {"NAME": "}"}}', "id")).alias("feature"))
    place = geojson.write_collections(rows, str(tmp_path / "out"), "id", "feature", features_per_file=10)
    written = [json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.txt")]
    assert len(written) > 2 and sum(len(d["features"]) for d in written) == 49
    found = files.read_geojson(spark, place, "NAME string")
    assert sorted(int(r["id"]) for r in found.collect()) == [i for i in range(50) if i != 7]
    geojson.write_collections(rows.limit(0), str(tmp_path / "none"), "id", "feature")
    assert not any(p.read_text() for p in (tmp_path / "none").rglob("*.txt"))
