import json
import logging
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from millrace import (
    BusinessFailure,
    ConditionError,
    MissingTable,
    PipelineError,
    RunContext,
    SpecError,
    check_spec,
    loop_requests,
    parse_spec,
    run_pipeline,
)
from millrace.functions.paths import nested_column, nested_value, output_alias, column_and_position
from millrace.plans.pipeline import holds, input_table, present, resolve_scalar, union_by_name


def dataset(name, rows):
    cells = "".join(
        "<Row>" + "".join(f'<Col id="{k}">{v}</Col>' for k, v in row.items()) + "</Row>" for row in rows
    )
    return f'<Dataset id="{name}"><Rows>{cells}</Rows></Dataset>'


def envelope(*datasets, code=0, message="SUCCESS"):
    return (
        f'<Root><Parameters><Parameter id="ErrorCode">{code}</Parameter>'
        f'<Parameter id="ErrorMsg">{message}</Parameter></Parameters>{"".join(datasets)}</Root>'
    )


def sql(query):
    return {"operator": "sql_transform", "params": {"query": query}}


# -- whole pipelines -----------------------------------------------------------------

# Which boats of a harbour are at sea, and what they landed.
BOATS = [("b7", "sea"), ("b2", "dock"), ("b9", "sea"), ("b4", "sea")]
CATCHES = {"b7": [("cod", 310), ("cod", 310), ("eel", 12)], "b2": [("cod", 900)], "b9": [("eel", 40)], "b4": []}


def test_boats_to_catches(spark):
    def fetch(name, wanted, path, **more):
        return {"step_id": name, "driver": "xml", "endpoint": name, "variables": {wanted: {"source": path}}, **more}

    def keep(field, operator, value):
        return {"operator": "filter", "params": {"conditions": [{"field": field, "operator": operator, "value": value}]}}

    spec = {
        "workflow_id": "landings",
        "steps": [
            fetch("boats", "harbour", "global_input.harbour", transformations=[keep("place", "!=", "dock")], output_dataset="out"),
            fetch(
                "catches", "boat", "loop_row.boat", mode="chained_loop", inputs=["out"], output_dataset="landed",
                transformations=[{"operator": "deduplicate", "params": {"subset": ["boat", "fish"]}}, keep("kilos", ">", 20)],
                response={"columns": ["boat", "fish", "kilos"]},
            ),
        ],
    }
    boats = envelope(dataset("fleet", [{"boat": b, "place": p} for b, p in BOATS]))
    catches = [(b, 200, envelope(dataset("fish", [{"boat": b, "fish": f, "kilos": k} for f, k in got]))) for b, got in CATCHES.items()]
    responses = {
        "boats": spark.createDataFrame([("north", 200, boats), ("south", 200, envelope())], "harbour string, status_code int, body string"),
        "catches": spark.createDataFrame(catches, "boat string, status_code int, body string"),
    }
    run = run_pipeline(spark, spec, inputs={"harbour": "north"}, responses=responses, audit=True)
    assert values(run.table("out"), "boat") == ["b4", "b7", "b9"]
    assert set(run.table("boats_raw").columns) == {"boat", "place"}
    assert sorted((r.boat, r.fish, r.kilos) for r in run.result().collect()) == [("b7", "cod", "310"), ("b9", "eel", "40")]
    assert run.observed() == {"boats": 3, "catches": 2}
    assert {(r.step_id, r.rows_processed) for r in run.audit().collect()} == {("boats", 3), ("catches", 2)}
    assert run.status == "success" and run.errors["catches"].count() == 0


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_one_response_grouped(spark):
    body = envelope(dataset("w", [{"line": a, "kg": b} for a, b in [("east", "7"), ("west", "1"), ("east", "-3"), ("", "4")]]))
    rules = [sql("SELECT line, int(kg) AS kg FROM {{ active_table }}"), {"operator": "group_by", "params": {"by": "line", "agg": {"kg": ["SUM", "MIN"]}}}]
    spec = {"workflow_id": "w", "steps": [step(driver="xml", endpoint="e", transformations=rules)]}
    responses = {"e": spark.createDataFrame([(200, body)], "status_code int, body string")}
    got = {r.line: (r.kg_sum, r.kg_min) for r in run_pipeline(spark, spec, responses=responses).result().collect()}
    assert got == {"east": (4, -3), "west": (1, 1), "": (4, 4)}


def wells_spec():
    """Wells of a district, what is known of each, kept over runs and counted by aquifer."""
    asked = {"headers": {"X-Key": "{{ session.key }}"}, "datasets": {"area": [{"district": "{{ inputs.district }}"}], "more": "{{ input_data.extra }}"}}
    extra = {"name": "extra", "type": "table", "required": False, "columns": [{"name": "well"}], "default": [{"well": "w0"}]}
    known = {"place": ["well", "aquifer"], "depth": ["well", "metres"], "owner": ["well", "person"]}
    history = {"target_history_table": "wells", "dedup_keys": "well", "order_by": "seen DESC"}
    titles = [{"field": "well_COUNT", "title": "Wells"}, {"field": "aquifer", "title": "Água"}]
    return {
        "workflow_id": "wells",
        "inputs": [{"name": "district", "default": "Évora"}, extra],
        "steps": [
            {
                "step_id": "find", "driver": "xml", "endpoint": "find", "variables": asked, "output_dataset": "found",
                "transformations": [{"operator": "handle_nulls", "params": {"subset": ["well"]}}],
                "output_config": {"columns": [{"field": "well", "title": "Poço"}]},
            },
            {
                "step_id": "describe", "driver": "xml", "mode": "chained_loop", "endpoint": "describe", "inputs": ["found"],
                "variables": {"well": {"source": "loop_row.well"}},
                "response": {"join": {"on": ["well"], "datasets": known}}, "output_dataset": "described",
                "transformations": [
                    {"operator": "add_date_column", "params": {"target_column": "seen"}},
                    {"operator": "accumulate_data", "params": history},
                ],
            },
            {
                "step_id": "count", "inputs": ["described"], "output_dataset": "counted", "output_config": {"columns": titles},
                "transformations": [{"operator": "group_by", "params": {"by": "aquifer", "agg": {"well": "COUNT"}}}],
            },
        ],
    }


def wells_responses(spark, wells):
    described = [
        (w, 200, envelope(
            dataset("place", [{"well": w, "aquifer": aquifer}]),
            dataset("depth", [{"well": w, "metres": metres}]),
            dataset("owner", [{"well": w, "person": "p"}]),
        ))
        for w, (aquifer, metres) in wells.items()
    ]
    found = envelope(dataset("list", [{"well": w} for w in wells] + [{"note": "none"}]))
    return {
        "find": spark.createDataFrame([("Beja", 200, envelope()), ("Évora", 200, found)], "district string, status_code int, body string"),
        "describe": spark.createDataFrame(described, "well string, status_code int, body string"),
    }


def test_wells_accumulate_over_runs(spark, tmp_path):
    def run(wells):
        return run_pipeline(spark, wells_spec(), responses=wells_responses(spark, wells), history_root=str(tmp_path))

    first = run({"w3": ("chalk", 41), "w8": ("chalk", 17)})
    assert [tuple(r) for r in first.presented("counted").collect()] == [(2, "chalk")]
    assert first.presented("found").columns == ["Poço"]
    second = run({"w8": ("sand", 18), "w5": ("sand", 66)})
    assert {r.well: (r.aquifer, r.metres) for r in second.table("described").collect()} == {
        "w3": ("chalk", "41"), "w8": ("sand", "18"), "w5": ("sand", "66"),
    }
    report = second.presented("counted")
    assert report.columns == ["Wells", "Água"]
    assert sorted(map(tuple, report.collect())) == [(1, "chalk"), (2, "sand")]
    assert second.table("extra").count() == 1


# -- errors and routing --------------------------------------------------------------


def error_spec(on_error=None):
    step = {"step_id": "s", "driver": "xml", "endpoint": "e", "response": {"columns": ["v"]}, "output_dataset": "ds_o"}
    if on_error:
        step["error_handling"] = {"code_field": "ErrorCode", "msg_field": "ErrorMsg", "on_error": on_error}
    after = {"step_id": "after", "inputs": ["ds_o"], "output_dataset": "ds_after"}
    return {"workflow_id": "w", "steps": [step, after]}


def error_responses(spark):
    good, bad = envelope(dataset("d", [{"v": 1}])), envelope(code=-404, message="gone")
    return {"e": spark.createDataFrame([(200, good), (200, bad)], "status_code int, body string")}


def test_business_error_pauses(spark):
    run = run_pipeline(spark, error_spec(), responses=error_responses(spark))
    assert (run.status, run.paused_at, run.route) == ("paused", "s", ["s"])
    error = run.errors["s"].first()
    assert (error.err_code, error.err_msg) == ("-404", "gone")
    assert run.audit().first().status == "paused"


def test_failing_rows_are_set_aside(spark):
    run = run_pipeline(spark, error_spec("skip_row"), responses=error_responses(spark))
    assert run.status == "success" and run.result().count() == 1 and run.errors["s"].count() == 1


def test_business_error_fails(spark):
    with pytest.raises(BusinessFailure):
        run_pipeline(spark, error_spec("fail"), responses=error_responses(spark))


def test_default_code_field_differs_once_handling_is_given(spark):
    spec = error_spec()
    spec["steps"][0]["error_handling"] = {"on_error": "fail"}
    assert run_pipeline(spark, spec, responses=error_responses(spark)).result().count() == 1


def routed(condition):
    def step(name, **routing):
        return {"step_id": name, "inputs": ["t"], "output_dataset": f"out_{name}", "routing": routing or None}

    return {
        "workflow_id": "w",
        "steps": [step("a", next_step="c", condition=condition), step("b", next_step="END"), step("c")],
    }


@pytest.mark.parametrize(
    "condition, route",
    [
        (None, ["a", "c"]),
        ("1 = 1", ["a", "c"]),
        ("SELECT count(*) > 100 FROM {{ tables('t') }}", ["a", "b"]),
        ("CAST(NULL AS BOOLEAN)", ["a", "b"]),
    ],
)
def test_routing(spark, condition, route):
    assert run_pipeline(spark, routed(condition), tables={"t": spark.range(3)}).route == route


def test_bad_condition(spark):
    with pytest.raises(ConditionError):
        run_pipeline(spark, routed("no_such_function(1)"), tables={"t": spark.range(3)})


def test_no_condition_holds(ctx):
    assert holds(ctx, None) and holds(ctx, "") and not holds(ctx, "1 > 2")


# -- preflight -----------------------------------------------------------------------


def step(**changes):
    return {"step_id": "s", "output_dataset": "ds", **changes}


@pytest.mark.parametrize(
    "steps, finding",
    [
        ([], "at least one step"),
        ([step(), step()], "Duplicate step_id"),
        ([step(driver="carrier_pigeon", endpoint="x")], "not registered"),
        ([step(mode="chained_loop")], "needs inputs"),
        ([step(mode="sideways")], "unknown mode"),
        ([step(transformations=[{"operator": "gone"}])], "operator 'gone'"),
        ([step(routing={"next_step": "nowhere"})], "does not exist"),
        ([step(), step(step_id="t", routing={"next_step": "s"})], "backward"),
    ],
)
def test_preflight(steps, finding):
    assert any(finding in p for p in check_spec(parse_spec({"workflow_id": "w", "steps": steps})))


def test_unknown_keys_are_refused():
    with pytest.raises(SpecError, match="loop_source"):
        parse_spec({"workflow_id": "w", "steps": [step(loop_source="x")]})
    with pytest.raises(SpecError, match="output_dataset"):
        parse_spec({"workflow_id": "w", "steps": [{"step_id": "s"}]})


def test_unproduced_input_warns(caplog):
    with caplog.at_level(logging.WARNING):
        assert check_spec(parse_spec({"workflow_id": "w", "steps": [step(inputs=["elsewhere"])]})) == []
    assert "elsewhere" in caplog.text


def test_required_input(spark):
    spec = {"workflow_id": "w", "inputs": [{"name": "x"}], "steps": [step(transformations=[sql("SELECT {{ inputs.x }} AS x")])]}
    with pytest.raises(SpecError, match="required"):
        run_pipeline(spark, spec)
    assert run_pipeline(spark, spec, inputs={"x": 3}).result().first().x == 3


def test_missing_table_raises(spark):
    with pytest.raises(MissingTable):
        run_pipeline(spark, {"workflow_id": "w", "steps": [step(inputs=["ds_gone"])]})
    with pytest.raises(MissingTable):
        run_pipeline(spark, {"workflow_id": "w", "steps": [step(driver="xml", endpoint="e")]})


# -- context -------------------------------------------------------------------------


def test_runs_do_not_share_tables(spark):
    one, two = RunContext(spark, run_id="run-1"), RunContext(spark, run_id="run-2")
    one.register("t", spark.range(1))
    two.register("t", spark.range(2))
    assert one.namespace == "ns_run_1"
    assert (one.sql("SELECT * FROM {{ tables('t') }}").count(), two.sql("SELECT * FROM {{ schema }}.t").count()) == (1, 2)
    one.close()
    with pytest.raises(MissingTable):
        one.table("t")


def test_sum_through_sql(spark, ctx):
    ctx.register("t", spark.createDataFrame([(100,), (200,)], "amount int"))
    assert ctx.sql("SELECT sum(amount) AS total FROM {{ tables('t') }}").first().total == 300
    with pytest.raises(MissingTable):
        ctx.sql("SELECT * FROM {{ tables('gone') }}")


def test_values_are_bound_not_spliced(spark):
    ctx = RunContext(spark, inputs={"name": "x' OR '1'='1", "n": 2, "deep": {"list": [{"a": "q"}]}}, session={"token": "s"})
    ctx.register("t", spark.createDataFrame([("a",), ("x' OR '1'='1",)], "v string"))
    assert ctx.sql("SELECT * FROM {{ tables('t') }} WHERE v = '{{ inputs.name }}'").count() == 1
    row = ctx.sql(
        "SELECT {{ inputs.n }} + 1 AS n, 'it''s {{inputs.n}}/{{ session.token }}' AS s, '{{ inputs.deep.list.0.a }}' AS a"
    ).first()
    assert tuple(row) == (3, "it's 2/s", "q")
    for bad in ("SELECT {{ inputs.gone }}", "SELECT {{ mystery }}", "SELECT {{ inputs.deep }}", "{% if 1 %}SELECT 1{% endif %}"):
        with pytest.raises(PipelineError):
            ctx.sql(bad)


def test_steps_stay_lazy_and_push_filters(spark, sf_dir):
    spec = {
        "workflow_id": "w",
        "steps": [
            {"step_id": "read", "driver": "parquet", "endpoint": f"{sf_dir}/lineitem.parquet", "output_dataset": "lines"},
            {"step_id": "copy", "inputs": ["lines"], "output_dataset": "copied"},
            {
                "step_id": "cut",
                "inputs": ["copied"],
                "transformations": [sql("SELECT l_orderkey FROM {{ active_table }} WHERE l_quantity > 49")],
                "output_dataset": "cut",
            },
        ],
    }
    plan = run_pipeline(spark, spec).result()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_table_source(spark):
    spark.range(4).createOrReplaceTempView("stored_numbers")
    spec = {"workflow_id": "w", "steps": [step(driver="table", endpoint="stored_numbers")]}
    assert run_pipeline(spark, spec).result().count() == 4


def test_json_source_with_loop(spark):
    spec = {
        "workflow_id": "w",
        "steps": [
            {
                "step_id": "s", "driver": "json", "mode": "chained_loop", "endpoint": "e", "inputs": ["t"],
                "variables": {"q": {"source": "loop_row.id"}},
                "response": {"columns": {"v": "int"}}, "error_handling": {"code_field": "code", "on_error": "continue"},
                "output_dataset": "ds",
            }
        ],
    }
    responses = spark.createDataFrame(
        [("0", 200, '{"data":[{"v":1},{"v":2}]}'), ("1", 201, '{"code":500}'), ("2", 500, ""), ("9", 200, "[]")],
        "q string, status_code int, body string",
    )
    run = run_pipeline(spark, spec, tables={"t": spark.range(3)}, responses={"e": responses})
    assert sorted(r.v for r in run.result().collect()) == [1, 2]
    assert run.errors["s"].count() == 2


@pytest.mark.parametrize("driver, columns", [("json", {"v": "int"}), ("xml", ["v"])])
def test_materialized_step(spark, driver, columns):
    body = '{"v":1}' if driver == "json" else envelope(dataset("d", [{"v": 1}]))
    spec = {
        "workflow_id": "w",
        "steps": [step(driver=driver, endpoint="e", response={"columns": columns}, materialize=True)],
    }
    responses = spark.createDataFrame([(200, body), (200, body)], "status_code int, body string")
    out = run_pipeline(spark, spec, responses={"e": responses}).result()
    assert [str(r.v) for r in out.collect()] == ["1", "1"]
    assert "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()


def test_request_lists_pick_responses(spark):
    responses = spark.createDataFrame(
        [(str(i), "x" if i < 5 else "y", 200, f'{{"v":{i}}}') for i in range(10)],
        "product_id string, kind string, status_code int, body string",
    )
    spec = {
        "workflow_id": "w",
        "inputs": [{"name": "kinds", "type": "table", "default": [{"kind": "x"}, {"kind": "z"}]}],
        "steps": [
            step(
                driver="json",
                endpoint="e",
                variables={
                    "ds_ids": {"type": "dataset", "columns": [{"field": "wanted.output.product_id"}]},
                    "ds_kinds": {"type": "dataset", "columns": [{"field": "global_input.kinds.kind", "alias": "kind"}]},
                },
                response={"columns": {"v": "int"}},
            )
        ],
    }
    wanted = spark.createDataFrame([("1",), ("7",), ("3",)], "product_id string")
    run = run_pipeline(spark, spec, tables={"wanted": wanted}, responses={"e": responses})
    assert sorted(r.v for r in run.result().collect()) == [1, 3]


REQUEST_VARIABLES = {
    "headers": {"Authorization": "{{ session.token }}"},
    "user": {"source": "session.user"},
    "mode": {"type": "parameter", "source": "inputs.mode", "default": "full"},
    "ds": {
        "type": "dataset",
        "columns": [
            {"field": "loop_row.id", "alias": "product_id"},
            {"field": "loop_row.tags", "alias": "tag"},
            {"field": "loop_row.more.x"},
        ],
    },
    "datasets": {"ds_fixed": [{"a": "1"}, {"a": "{{ inputs.gone }}"}, {"a": "{{ loop_row.id }}"}], "ds_lone": [{"b": "{{ loop_row.id }}"}]},
}


def requests_of(spark, driver):
    rows = spark.sql(
        "SELECT 1 AS id, array('p', 'q') AS tags, named_struct('x', array(7, 8, 9)) AS more"
        " UNION ALL SELECT 2, array(), NULL"
    )
    spec = {
        "workflow_id": "w",
        "steps": [step(driver=driver, mode="chained_loop", endpoint="e", inputs=["t"], variables=REQUEST_VARIABLES)],
    }
    out = loop_requests(spark, spec, "s", session={"user": "u", "token": "secret"}, tables={"t": rows})
    bodies = {r.id: r.body for r in out.collect()}
    assert "secret" not in str(bodies)
    return bodies


def test_json_requests(spark):
    bodies = requests_of(spark, "json")
    assert json.loads(bodies[1]) == {
        "user": "u",
        "mode": "full",
        "ds": [
            {"product_id": 1, "tag": "p", "x": 7},
            {"product_id": 1, "tag": "q", "x": 8},
            {"product_id": 1, "tag": None, "x": 9},
        ],
        "ds_fixed": [{"a": "1"}, {"a": None}, {"a": "1"}],
        "ds_lone": [{"b": 1}],
    }
    assert json.loads(bodies[2])["ds"] == [{"product_id": 2, "tag": None, "x": None}]


def test_xml_requests(spark):
    root = ElementTree.fromstring(requests_of(spark, "xml")[1])
    assert {p.get("id"): p.text for p in root.iter("Parameter")} == {"user": "u", "mode": "full"}
    sets = {d.get("id"): [[c.text for c in row] for row in d.iter("Row")] for d in root.iter("Dataset")}
    assert sets["ds"] == [["1", "p", "7"], ["1", "q", "8"], ["1", None, "9"]]
    assert sets["ds_lone"] == [["1"]]


def test_batch_request(spark):
    spec = {"workflow_id": "w", "steps": [step(driver="json", endpoint="e", variables={"n": {"source": "inputs.n"}})]}
    assert [r.body for r in loop_requests(spark, spec, "s", inputs={"n": 3}).collect()] == ['{"n":3}']
    with pytest.raises(SpecError):
        loop_requests(spark, spec, "gone")


def test_loop_without_a_shared_column(spark):
    spec = {"workflow_id": "w", "steps": [step(driver="json", mode="chained_loop", endpoint="e", inputs=["t"], variables={"q": {"source": "loop_row.id"}})]}
    responses = {"e": spark.createDataFrame([("0", 200, "{}")], "other string, status_code int, body string")}
    with pytest.raises(PipelineError, match="no column among"):
        run_pipeline(spark, spec, tables={"t": spark.range(3)}, responses=responses)


# -- inputs, paths, presentation -----------------------------------------------------


def test_input_table_defaults_and_types(spark):
    columns = [{"name": "id"}, {"name": "n", "type": "integer", "default": 7}, {"name": "b", "type": "boolean"}]
    rows = input_table(spark, [{"id": 1}, {"id": "x", "n": "3", "b": True}], columns).collect()
    assert [tuple(r) for r in rows] == [("1", 7, None), ("x", 3, True)]
    assert input_table(spark, [], columns).count() == 0
    assert input_table(spark, [{"a": 1}, {"b": 2}]).columns == ["a", "b"]


def test_present(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert present(df, None) is df
    assert present(df, {"columns": [{"field": "b", "title": "B"}, {"field": "a", "visible": False}]}).columns == ["B"]


def test_union_fills_missing_columns(spark):
    out = union_by_name([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")])
    assert sorted(map(tuple, out.collect())) == [(1, 2, None), (4, None, 3)]


@pytest.mark.parametrize(
    "path, value",
    [
        ("", {"a": [{"b": 1}, {"b": 2}, {"c": 3}], "d": {"e": "f"}}),
        ("d.e", "f"),
        ("a.1.b", 2),
        ("a.b", [1, 2]),
        ("a.b[1]", 2),
        ("a.b[9]", None),
        ("a[0]", {"b": 1}),
        ("a.7.b", None),
        ("x.y", None),
        ("d.e[0]", "f"),
    ],
)
def test_nested_value(path, value):
    assert nested_value({"a": [{"b": 1}, {"b": 2}, {"c": 3}], "d": {"e": "f"}}, path) == value


def test_nested_column(spark):
    df = spark.sql("SELECT named_struct('b', array(named_struct('c', 1), named_struct('c', 2))) AS a, map('k', 'v') AS m")
    picks = {"a.b.1.c": 2, "a.b.c[0]": 1, "a.b.c": [1, 2], "a.b[5]": None, "a.z": None, "z": None, "m.k": "v", "m.q": None}
    row = df.select(*[nested_column(df, p).alias(f"c{i}") for i, p in enumerate(picks)]).first()
    assert list(row) == list(picks.values())


def test_path_parts():
    assert column_and_position("a.b[3]") == ("a.b", 3) and column_and_position("a[1].b") == ("a[1].b", None)
    assert output_alias("ds.output.col[2]") == "col"


def test_resolve_scalar(spark):
    ctx = RunContext(spark, inputs={"ids": [{"id": "p"}, {"id": "q"}]}, session={"user": "u"})
    ctx.register("t", spark.createDataFrame([(2, "b"), (1, "a")], "n int, v string"))
    picks = {
        "inputs.ids.id": "p",
        "global_input.ids.id[1]": "q",
        "session.user": "u",
        "t.v": "a",
        "t.output.v[1]": "b",
        "t.v[5]": "dflt",
        "t.gone": "dflt",
        "nowhere.v": "dflt",
    }
    row = spark.range(1).select(
        *[resolve_scalar(ctx, p, "dflt", ["n"]).alias(f"c{i}") for i, p in enumerate(picks)]
    ).first()
    assert list(row) == list(picks.values())
    with pytest.raises(PipelineError, match="order_by"):
        resolve_scalar(ctx, "t.v")
