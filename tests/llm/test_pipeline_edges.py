"""Ids beyond 2^53 next to NULL ones, empty tables and clashing names through packing and the pipeline."""

import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from panelwright.llm import packing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FAR = 2 ** 53 + 1


@pytest.fixture(scope="module")
def far_rows():
    draw = random.Random(9)
    rows = []
    for k in range(60):
        text = " ".join(f"word{draw.randrange(10 ** 6)}" for _ in range(70))
        rows.append((None if k % 7 == 3 else FAR + 2 * k, text, draw.choice(["en", None]), "s", len(text)))
    return rows + [(FAR + 1000, None, None, None, None), (FAR + 1002, "", "en", "s", 0)]


def test_packing_keeps_ids_next_to_null_ones(spark, far_rows, tokenizer):
    docs = spark.createDataFrame(far_rows, SCHEMA).repartition(3)
    got = packing.pack_documents(docs, tokenizer).collect()
    assert {r.doc_id for r in got} == {r[0] for r in far_rows}
    assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in far_rows)


def _through(spark, docs, folder):
    for name, stage in cp.STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def test_pipeline_keeps_ids_and_clashing_names(spark, far_rows, tmp_path):
    clashing = ["_k_doc_id", "_k__k_doc_id", "_digest", "_c", "_d", "rec", "key", "hash", "kept", "n"]
    docs = spark.createDataFrame(far_rows, SCHEMA).withColumns({c: F.lit("x") for c in clashing})
    good = cp.keep_good(spark, docs, "")
    assert good.columns == docs.columns
    got = _through(spark, docs, tmp_path)
    ids = {r.doc_id for r in got.collect()}
    assert ids == {r[0] for r in far_rows if r[1]}


def test_pipeline_of_nothing(spark, tmp_path):
    assert _through(spark, spark.createDataFrame([], SCHEMA), tmp_path).count() == 0


def test_quality_filter_with_reserved_looking_names(spark, far_rows):
    docs = spark.createDataFrame(far_rows, SCHEMA)
    odd = docs.withColumns({"_k_doc_id": F.lit(1), "_K__digest": F.lit(2)})
    assert quality_rules.quality_filter(odd).select("doc_id").count() == quality_rules.quality_filter(docs).count()
