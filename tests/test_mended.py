"""Cases that earlier went wrong without any golden data showing it."""

import pytest
from pyspark.sql import functions as F

from millrace import run_pipeline
from millrace.context import RunContext
from millrace.errors import PipelineError, SpecError, TransportFailure
from millrace.functions.json_paths import json_path
from millrace.functions.paths import nested_value, steps
from millrace.operators.filters import optional_search
from millrace.operators.latest import _items
from millrace.plans import ordered
from millrace.plans.history import History
from millrace.plans.pipeline import _with_defaults, truth
from millrace.plans.spec import Input
from millrace.sources import outcomes, xml_envelope
from millrace.sources.json_records import member


@pytest.mark.parametrize("n", [3, 250])
def test_ids_of_another_type_at_any_length(spark, n):
    assert optional_search(spark.range(400), ids=("id", [str(k) for k in range(n)])).count() == n


def test_no_id_restricts_nothing_in_either_form(spark):
    table = spark.createDataFrame([(None,), ("",)], "x string")
    assert optional_search(spark.range(5), ids=("id", [None, ""])).count() == 5
    assert optional_search(spark.range(5), ids=("id", table)).count() == 5


def test_order_text_with_calls_and_quotes():
    assert _items("coalesce(ts, nullif(x, y)) DESC, concat(a, ',)'), `b,c`") == ["coalesce(ts, nullif(x, y)) DESC", " concat(a, ',)')", " `b,c`"]


def test_truth_of_words():
    assert truth("false") is False and truth("TRUE ") is True and truth(0) is False
    with pytest.raises(PipelineError):
        truth("maybe")


def test_paths_as_steps():
    assert steps("a[1].b.2") == ["a", 1, "b", "2"]
    assert nested_value({"a": [{}, {"b": [5, 6, 7]}]}, "a[1].b.2") == 7


def test_first_match_of_a_json_path(spark):
    df = spark.createDataFrame([('{"l":[{"x":1},{"k":"a"},{"k":"b"}]}',), ('{"l":[]}',), ("no",)], "j string")
    assert [r[0] for r in df.select(json_path("j", "$.l[*].k")).collect()] == ["a", None, None]


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([('{"a.b": 1, "it\'s": 2}',)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(*(F.try_variant_get("v", member(n), "long") for n in ("a.b", "it's"))).first()[:] == (1, 2)


def test_rows_without_an_order_value_come_first(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 1, 2), ("k", 2, 3), ("k", 3, 4)], "k string, t int, v int").repartition(3)
    out = ordered.with_measures(df, ["k"], ["t"], {"first": ordered.first_value("v"), "before": ordered.lag("v")})
    assert {r.v: (r["first"], r.before) for r in out.collect()} == {1: (1, None), 2: (1, 1), 3: (1, 2), 4: (1, 3)}


def test_values_beside_escaped_quotes_and_comments(spark):
    ctx = RunContext(spark, inputs={"x": "v"})
    row = ctx.sql("""SELECT 'it\\'s' AS a, '{{ inputs.x }}!' AS b, "<{{ inputs.x }}>" AS c -- don't {{ inputs.x }}""").first()
    assert row[:] == ("it's", "v!", "<v>")
    with pytest.raises(PipelineError):
        ctx.sql("SELECT 1 AS `{{ inputs.x }}`")


def test_inputs_take_their_declared_type():
    declared = [Input(name="n", type="integer", default="5"), Input(name="b", type="boolean", default="no"), Input(name="j", type="json", default='{"a": [1]}')]
    assert _with_defaults(declared, {}) == {"n": 5, "b": False, "j": {"a": [1]}}
    with pytest.raises(SpecError):
        _with_defaults(declared, {"n": "five"})


def test_repeated_and_misplaced_blocks(spark):
    rows = [
        ("<Root><Parameters><Parameter id='a'>1</Parameter></Parameters><Parameters><Parameter id='b'>2</Parameter></Parameters>"
         "<Dataset id='d'><Rows><Row><Col id='x'>1</Col></Row></Rows><Rows/><Rows><Row><Col id='x'>2</Col></Row></Rows></Dataset></Root>",),
        ("<Root><Deep><Dataset id='d'><Rows><Row><Col id='x'>3</Col></Row></Rows></Dataset></Deep></Root>",),
        ("<Root><Parameters/></Root>",),
    ]
    parsed = xml_envelope.parse_xml_envelope(spark.createDataFrame(rows, "body string"))
    assert [r[0] for r in parsed.select("envelope.readable").collect()] == [True, True, True]
    assert sorted(r.x for r in xml_envelope.envelope_rows(parsed, "d", ["x"]).collect()) == ["1", "2", "3"]
    assert xml_envelope.envelope_parameters(parsed).first()["parameters"] == {"a": "1", "b": "2"}
    assert [r.x for r in xml_envelope.envelope_rows(parsed.limit(1), "d", ["x"]).orderBy("row_no").collect()] == ["1", "2"]


def loop_spec(strategy):
    fetch = {
        "step_id": "fetch", "inputs": ["asked"], "driver": "json", "endpoint": "parts", "mode": "chained_loop",
        "variables": {"id": {"source": "loop_row.id"}}, "output_dataset": "out",
        "error_handling": {"on_error": strategy},
    }
    return {"workflow_id": "w", "steps": [fetch]}


def test_requests_without_a_response_are_errors(spark):
    asked = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    answers = spark.createDataFrame([(1, 200, '[{"a.b": 7, "t": "x"}]'), (9, 500, None)], "id long, status_code int, body string")
    run = run_pipeline(spark, loop_spec("skip_row"), tables={"asked": asked}, responses={"parts": answers})
    assert [r.asDict() for r in run.result().collect()] == [{"a.b": 7, "t": "x"}]
    errors = run.errors["fetch"].select("id", "outcome", "err_msg").collect()
    assert sorted(errors, key=str) == sorted([(2, "transport", outcomes.NO_RESPONSE), (None, "transport", outcomes.NO_RESPONSE)], key=str)
    with pytest.raises(TransportFailure):
        run_pipeline(spark, loop_spec("fail"), tables={"asked": asked}, responses={"parts": answers})
    # a failure that nobody asked for is none of this step's business
    one = asked.where("id = 1")
    assert run_pipeline(spark, loop_spec("fail"), tables={"asked": one}, responses={"parts": answers}).result().count() == 1


def test_a_pruned_batch_is_not_applied_again(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), ["k"], "t DESC")
    for i in range(3):
        history.merge(spark.createDataFrame([(1, i)], "k int, t int"), batch_id=f"b{i}")
    history.prune(1)
    before = history.state().version
    assert history.merge(spark.createDataFrame([(1, 99)], "k int, t int"), batch_id="b0") == before
    assert history.read().first()["t"] == 2
