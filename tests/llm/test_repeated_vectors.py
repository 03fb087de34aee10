"""Operator 2 on repeated rows, against its SQL."""

from __future__ import annotations

import random

import pytest

from millrace.llm import vector_search
from oracle import difference, duck_rows, spark_rows

VECTORS = "vec_id long, embedding array<float>, copies string"


@pytest.mark.parametrize("shard", [8192, 40])
def test_repeated_rows_equal_the_sql(spark, tmp_path, monkeypatch, shard):
    import duckdb

    monkeypatch.setattr(vector_search, "SHARD", shard)
    monkeypatch.setattr(vector_search, "LEAF", 8)
    monkeypatch.setattr(vector_search, "BLOCK", 2)
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], "x") for k in range(300)]
    rows += [rows[7]] * 2 + [rows[8]] * 9 + [rows[50]] * 2 + [(8, [1.0, 1.0, 1.0, 1.0], "x"), (100, [2.0, 1.0, 0.5, 0.0], "x"), (100, rows[100][1], "y")]
    path = str(tmp_path / "embeddings")
    spark.createDataFrame(rows, VECTORS).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert difference(spark_rows(vector_search.top_k(spark.read.parquet(path))), duck_rows(con, vector_search.OP2_SQL)) is None


def test_a_repeated_candidate_is_listed_twice(spark):
    rows = [(0, [1.0]), (1, [9.0]), (1, [9.0]), (2, [8.0]), (3, [7.0]), (4, [6.0]), (5, [5.0])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, 1, 2, 3, 4]
