import os
import re

import duckdb
import pytest

import __spark_entry__
from larkspur.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sql, name, tmp_path):
    catalogue.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    sql.sql(f"CREATE OR REPLACE TABLE want AS {catalogue.oracle_sql()[name]}")
    sql.sql(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(r[0] for r in sql.sql("SELECT column_name FROM (DESCRIBE want)").fetchall())
    assert columns == sorted(r[0] for r in sql.sql("SELECT column_name FROM (DESCRIBE got)").fetchall())
    listed = ", ".join(columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert sql.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["greedy_dedup", "eval_cases", "eval_arms", "bootstrap_ci", "hybrid_search"])
def test_hits_meet_their_texts_where_these_lie(spark, name):
    """Documents too large to be broadcast stay in place: no shuffle has their texts."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set(key, before)
    moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange\n", part.lstrip())]
    documents = re.search(r"Scan parquet[^\n]*\nOutput \[\d+\]: \[doc_id#\d+L, (text#\d+)\]", plan)[1]
    assert moved and not [part for part in moved if documents in part]


def test_every_query_has_sql_but_two():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"bootstrap_ci", "vector_index_recall"}


def test_half_of_the_cells_have_most_neighbours(spark):
    (row,) = catalogue.queries()["vector_index_recall"](spark, SF).collect()
    assert 0.9 <= row.recall <= 1


def test_whole_packing_does_not_cut_long_texts(spark, tmp_path):
    spark.createDataFrame([("s", 1, "x" * 40_000), ("s", 2, "y" * 100), ("s", 3, "z" * 130_000)], "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["batch_packing_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.tokens, r.batch) for r in got) == [(1, 20_000, 0), (2, 50, 0), (3, 65_000, 1)]


def test_whole_drift_has_facts_of_every_label(spark, tmp_path):
    rows = [(100, 0, [1.0, 0.0, 0.0]), (1, 0, [1.0, 0.1, 0.0]), (2, 7, [1.0, 0.5, 0.0]), (200, 3, [0.0, 0.0, 1.0]), (3, 4, [0.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.queries()["drift_semantic_whole"](spark, str(tmp_path)).collect()
    assert [(r.claim_id, r.chain_key, r.similarity) for r in got] == [(100, 1, 0.995)]


def test_declarations_of_long_documents_are_not_cut(spark, tmp_path):
    spark.createDataFrame([(1, "line\n" * 900), (2, "short"), (3, "a b\n" * 480)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["declaration_strings"](spark, str(tmp_path)).collect()
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = own.sql(f"SELECT doc_id, chunk_index, start_line, end_line, digest FROM ({catalogue.oracle_sql()['declaration_strings']})").fetchall()
    assert len(got) == 6 and sorted(tuple(r) for r in got) == sorted(want)
