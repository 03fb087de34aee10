"""Loop steps join driving rows, bodies and parsed rows without broadcasting any of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace import run_pipeline

PAD = "x" * 2000


def _body(driver):
    """Long bodies that take little room in files."""
    v = F.col("id").cast("string")
    if driver == "json":
        return F.concat(F.lit('{"data":[{"v":"'), v, F.lit(f'","pad":"{PAD}"}}]}}'))
    return F.concat(F.lit('<Root><Dataset id="d"><Rows><Row><Col id="v">'), v, F.lit(f'</Col><Col id="pad">{PAD}</Col></Row></Rows></Dataset></Root>'))


ASKED = [*[k % 4010 for k in range(6000)], None]
KNOWN = {k for k in range(4000) if k % 10 != 3}


@pytest.fixture(params=["xml", "json"])
def looped(spark, tmp_path, request):
    answered = spark.range(4000).filter("id % 10 <> 3")
    answered.select(F.col("id").alias("q"), F.lit(200).alias("status_code"), _body(request.param).alias("body")).write.parquet(f"{tmp_path}/responses")
    spark.createDataFrame([(k,) for k in ASKED], "q bigint").write.parquet(f"{tmp_path}/asking")
    step = {
        "step_id": "s", "driver": request.param, "mode": "chained_loop", "endpoint": "e", "inputs": ["t"],
        "variables": {"q": {"source": "loop_row.q"}}, "response": {"columns": ["v"]},
        "error_handling": {"on_error": "skip_row"}, "output_dataset": "ds",
    }
    tables, responses = ({name: spark.read.parquet(f"{tmp_path}/{folder}")} for name, folder in (("t", "asking"), ("e", "responses")))
    return run_pipeline(spark, {"workflow_id": "w", "steps": [step]}, tables=tables, responses=responses)


def _plan_as_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_driving_and_parsed_rows_are_not_broadcast(looped):
    rows = looped.result().select("v")
    assert "Broadcast" not in _plan_as_run(rows)
    assert sorted(int(r["v"]) for r in rows.collect()) == sorted(k for k in ASKED if k in KNOWN)


def test_bodies_are_not_broadcast_for_errors(looped):
    errors = looped.errors["s"].select("q", "outcome", "err_msg")
    assert "Broadcast" not in _plan_as_run(errors)
    found = errors.collect()
    assert len(found) == len({*ASKED} - KNOWN) and {r["q"] for r in found} == {*ASKED} - KNOWN
    assert {(r["outcome"], r["err_msg"]) for r in found} == {("transport", "no response")}
