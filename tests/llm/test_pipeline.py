"""The registered text queries on the small tables, and the pipeline stage by stage."""

import duckdb
import pytest

import check
import corpus_pipeline
from rowloom.llm.queries import ORACLES, QUERIES
from rowloom.llm.simhash import near_copies


@pytest.fixture(scope="module")
def db(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, sf_dir, name):
    count, problem = check.difference(spark, db, sf_dir, name)
    assert count and not problem, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_one_row_per_key(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    key = df.columns[0]
    given = "conversations" if key == "conv_id" else "documents"
    n = duckdb.sql(f"SELECT count(DISTINCT {key}) FROM '{sf_dir}/{given}.parquet'").fetchall()[0][0]
    assert df.select(key).distinct().count() == df.count() == n + (given == "conversations")


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = out.select("doc_id").distinct()
        assert ids.count() == out.count() and ids.join(docs, "doc_id", "left_anti").count() == 0
        if k < 4:
            assert out.columns == columns
        if name in ("secret_scan", "bpe"):
            assert out.count() == docs.count()
        else:
            assert out.count() < docs.count()
        if name == "simhash_near_dedup":
            assert near_copies(out).where("not stays").count() == 0
            assert docs.select("text").distinct().count() >= out.count() == out.select("text").distinct().count()
        if name == "secret_scan":
            assert out.where("text rlike 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}'").count() == 0
        docs = out
    assert docs.count() > before * 0.7
