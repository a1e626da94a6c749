"""Row numbers hold when executors come or go between two jobs."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import beside, storage
from scorelake.llm.near_text import near_duplicates
from scorelake.llm.quality_rules import references
from scorelake.llm.registry import QUERIES
from scorelake.llm import queries

SF_DIR = "/root/testdata/sf0.001"
CORES, SPLITS = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def folder(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(5, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.fixture
def changing(spark, monkeypatch):
    """From here on every table that is written changes the number of cores."""
    seen, path = [], storage.scratch_path

    def scratch_path(session, name):
        seen.append(name)
        session.conf.set(CORES, "12" if len(seen) % 2 else "1")
        return path(session, name)

    for module in (storage, beside):
        monkeypatch.setattr(module, "scratch_path", scratch_path)
    spark.conf.unset(SPLITS)
    yield seen
    spark.conf.unset(CORES)


def op2(spark, docs, folder):
    return near_duplicates(docs, size=2, limit=0.8).drop("row")


def op6(spark, docs, folder):
    return QUERIES["op6_sparse_suffix_repeats"](spark, folder)


def op1(spark, docs, folder):
    return QUERIES["op1_divergence_rules"](spark, folder)


@pytest.mark.parametrize("work", [op1, op2, op6, *(STAGES[n] for n in ("quality_rules", "minhash_near_dedup", "suffix_dedup"))])
def test_rows_do_not_depend_on_cores(spark, folder, work, request):
    queries.all_queries()
    read = lambda: spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(work(spark, read(), folder).collect(), key=repr)
    seen = request.getfixturevalue("changing")
    got = sorted(work(spark, read(), folder).collect(), key=repr)
    assert got == want and len(got) and seen


def test_a_table_of_the_driver_is_stored(spark, changing):
    held = spark.createDataFrame([(i,) for i in range(40)], "x long")
    table = storage.settled(held.where("x >= 0"))
    first = table.select(F.monotonically_increasing_id().alias("row"), "x").collect()
    spark.conf.set(CORES, "7")
    assert table.select(F.monotonically_increasing_id().alias("row"), "x").collect() == first and len(changing) == 1
