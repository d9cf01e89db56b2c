import hashlib

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, con, name):
    compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rewrite_cleaning_sees_the_end_of_long_texts(spark, tmp_path):
    text = "word  " * 200 + "\nI need to paraphrase"
    spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.QUERIES["rewrite_cleaning_whole"](spark, str(tmp_path)).collect()}
    clean = "word " * 199 + "word\nI need to paraphrase"
    assert all("needs_to" in r.dirt for r in got.values())
    assert got[3].clean_md5 == got[0].clean_md5 == hashlib.md5(clean.encode()).hexdigest()


def test_need_list_reads_decisions(spark, monkeypatch):
    """Other programs, other candidates."""
    from millrace.plans import training

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lit("").alias("page"))
    deleted = {r.doc_id for r in d.where("doc_id % 5 = 3 and doc_id % 7 <> 0").collect()}
    monkeypatch.setattr(training, "programs", lambda spark, sf: d.withColumn("program", F.when(F.col("doc_id") % 5 == 3, F.lit("<delete>\n<extract>\n<delete>")).otherwise(F.lit("<keep>\n<extract>\n<keep>"))))
    got = {r.doc_id for r in training.need_list(spark, SF).collect()}
    assert got and got <= deleted
