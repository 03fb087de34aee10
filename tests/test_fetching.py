"""Fetch functions, batch requests without a response, and how often responses are parsed."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace import TransportFailure, run_pipeline
from millrace.sources.fetching import PROBLEM, fetched_responses


# as a caller's own module would: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _spec(mode: str, on_error: str = "skip_row", **step) -> dict:
    variables = {"parameters": {"city": "{{ loop_row.city }}" if mode == "chained_loop" else "{{ inputs.city }}", "unit": "C"}}
    made = {
        "step_id": "weather",
        "driver": "json",
        "mode": mode,
        "endpoint": "weather",
        "inputs": ["trips"] if mode == "chained_loop" else [],
        "variables": variables,
        "response": {"columns": {"city": "string", "degrees": "bigint"}},
        "error_handling": {"code_field": "code", "msg_field": "message", "on_error": on_error},
        "output_dataset": "ds_weather",
    }
    return {"workflow_id": "w", "inputs": [{"name": "city", "default": "Oslo"}], "steps": [made | step]}


def _weather(requests: list[dict]) -> list[tuple[int, str]]:
    if any(r["city"] == "Nowhere" for r in requests):
        raise LookupError("no such city")
    # the body is what the step would send
    return [(200, json.dumps({"code": 200, "items": [{"city": json.loads(r["body"])["city"], "degrees": len(r["city"])}] * 2})) for r in requests]


@pytest.fixture
def trips(spark):
    cities = ["Oslo", "Rome", "Oslo", None, "Nowhere", "Lima", "Rome"]
    return spark.createDataFrame([(k, c) for k, c in enumerate(cities)], "trip int, city string").repartition(3)


def test_every_driving_row_is_answered(spark, trips):
    run = run_pipeline(spark, _spec("chained_loop"), tables={"trips": trips}, fetchers={"weather": _weather})
    assert sorted(map(tuple, run.result().collect())) == sorted([("Oslo", 4), ("Rome", 4), ("Lima", 4)] * 2 + [("Oslo", 4), ("Rome", 4)] * 2)
    errors = {r.city: r.err_msg for r in run.errors["weather"].collect()}
    assert errors == {"Nowhere": "LookupError: no such city", None: "no response"}


def test_batch_step_fetches_once(spark):
    run = run_pipeline(spark, _spec("batch"), inputs={"city": "Rome"}, fetchers={"weather": _weather})
    assert list(map(tuple, run.result().collect())) == [("Rome", 4)] * 2
    assert run.errors["weather"].count() == 0
    with pytest.raises(TransportFailure):
        run_pipeline(spark, _spec("batch", "fail"), inputs={"city": "Nowhere"}, fetchers={"weather": _weather})


def test_one_bad_request_does_not_spoil_its_batch(spark):
    def fetch(requests):
        assert len(requests) <= 3
        if any(r["k"] % 4 == 1 for r in requests):
            raise ValueError("odd one")
        return [(200, str(r["k"])) for r in requests]

    asked = spark.range(20).select(F.col("id").alias("k"), F.lit("").alias("body"))
    got = {r.k: (r.status_code, r.body, r[PROBLEM]) for r in fetched_responses(asked, fetch, batch=3).collect()}
    assert got == {k: (None, None, "ValueError: odd one") if k % 4 == 1 else (200, str(k), None) for k in range(20)}


def test_too_few_replies_are_failures(spark):
    asked = spark.range(4).select(F.col("id").alias("k"), F.lit("").alias("body"))
    assert {r[PROBLEM] for r in fetched_responses(asked, lambda requests: []).collect()} == {"ValueError: not enough values to unpack (expected 1, got 0)"}
    assert fetched_responses(asked.limit(0), lambda requests: []).count() == 0


def test_fetching_happens_once_for_errors_and_rows(spark, trips, tmp_path):
    log = str(tmp_path)

    def fetch(requests):
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").write("\n".join(r["city"] for r in requests))
        return [(200, '{"code": 200, "items": [{"city": "x", "degrees": 1}]}') for _ in requests]

    run = run_pipeline(spark, _spec("chained_loop"), tables={"trips": trips}, fetchers={"weather": fetch})
    assert run.result().count() == 6 and run.errors["weather"].count() == 1 and run.result().count() == 6
    asked = sorted(city for f in tmp_path.iterdir() for city in f.read_text().split("\n"))
    assert asked == ["Lima", "Nowhere", "Oslo", "Rome"]


def _captured(spark):
    good = '{"code": 200, "items": [{"city": "Oslo", "degrees": 4}]}'
    return spark.createDataFrame([("Oslo", 200, good), ("Rome", 200, '{"code": 500, "message": "busy"}')], "city string, status_code int, body string")


def test_batch_request_without_a_response(spark):
    run = run_pipeline(spark, _spec("batch"), inputs={"city": "Bern"}, responses={"weather": _captured(spark)})
    assert run.result().count() == 0
    assert [(r.city, r.outcome, r.err_msg) for r in run.errors["weather"].collect()] == [("Bern", "transport", "no response")]
    run = run_pipeline(spark, _spec("batch"), inputs={"city": "Oslo"}, responses={"weather": _captured(spark)})
    assert run.result().count() == 1 and run.errors["weather"].count() == 0
    with pytest.raises(TransportFailure):
        run_pipeline(spark, _spec("batch", "pause_for_manual"), inputs={"city": "Bern"}, responses={"weather": _captured(spark)})


def test_ids_of_a_batch_request_without_a_response(spark):
    for given in (["Oslo", "Bern", "", None, "Bern"], spark.createDataFrame([("Oslo",), ("Bern",), (None,)], "city string")):
        is_list = isinstance(given, list)
        step = {"variables": {"parameters": {"city": "{{ inputs.city }}" if is_list else "{{ wanted.city }}"}}}
        run = run_pipeline(spark, _spec("batch", **step), inputs={"city": given} if is_list else {}, tables={} if is_list else {"wanted": given}, responses={"weather": _captured(spark)})
        assert [r.city for r in run.result().collect()] == ["Oslo"]
        assert [(r.city, r.err_msg) for r in run.errors["weather"].collect()] == [("Bern", "no response")]
    empty = run_pipeline(spark, _spec("batch"), inputs={"city": [""]}, responses={"weather": _captured(spark)})
    assert empty.result().count() == 1  # no id is set, so nothing is left out
    assert [r.err_code for r in empty.errors["weather"].collect()] == ["500"]


def test_responses_are_parsed_once_when_errors_are_looked_for_first(spark):
    run = run_pipeline(spark, _spec("batch", "pause_for_manual"), inputs={"city": ["Rome", "Oslo"]}, responses={"weather": _captured(spark)})
    assert run.status == "paused"
    plan = run.result()._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "parquet" in plan
