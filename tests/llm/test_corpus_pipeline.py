import importlib

import pytest
from odd import strange

from ledgerlens.llm import queries

FOLDER = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    first = docs = queries.table(spark, FOLDER, "documents")
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES:
        done = stage(spark, docs, FOLDER)
        done.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.schema == first.schema
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            sizes.append(docs.count())
    quality, toxic, _, near, start = sizes[1], sizes[2], sizes[3], sizes[4], sizes[0]
    assert 0.7 * start < quality < start and toxic < quality and near < toxic == sizes[3]
    last = spark.read.parquet(f"{tmp_path}/near_dedup")
    assert docs.select("doc_id").distinct().count() == last.count()
    assert sorted(pipeline.run(spark, FOLDER).columns) == sorted(docs.columns)


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("rows", [100, 0])
def test_stages_take_strange_rows_and_none(spark, rows):
    docs = strange(spark).limit(rows)
    for name, stage in importlib.import_module("corpus_pipeline").STAGES:
        done = stage(spark, docs, FOLDER)
        found = done.collect()
        if name == "packing":
            assert len(found) == (0 if rows == 0 else 9 + 38)  # the long text takes 38 pieces
        else:
            assert done.schema == docs.schema
            assert len(found) <= docs.count()
            if name != "near_dedup":
                assert rows == 0 or len(found) >= 8  # nothing here is plainly bad or toxic
