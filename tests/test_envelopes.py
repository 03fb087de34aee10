import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from millrace.errors import BusinessFailure, PipelineError, TransportFailure
from millrace.sources import json_records as js
from millrace.sources import outcomes
from millrace.sources import xml_envelope as xe
from millrace.sources.spreadsheet import read_workbooks, scan_spreadsheets

TIDES = """<?xml version="1.0"?>
<Root>
  <Parameters><Parameter id="station">Leith</Parameter><Parameter id="ErrorCode">0</Parameter></Parameters>
  <Dataset id="tides"><ColumnInfo><Column id="at"/><Column id="metres"/></ColumnInfo><Rows>
    <Row><Col id="at">04:10</Col><Col id="metres">5.3</Col></Row>
    <Row><Col id="metres">0.9</Col><Col id="at">10:22</Col></Row>
    <Row><Col id="at">16:35</Col></Row>
  </Rows></Dataset>
</Root>"""


def bodies(spark, *texts):
    return spark.createDataFrame([(i, 200, t) for i, t in enumerate(texts)], "n int, status_code int, body string")


def parsed(spark, *texts, **options):
    return xe.parse_xml_envelope(bodies(spark, *texts), **options)


def test_parameters_and_rows(spark):
    df = parsed(spark, TIDES)
    assert xe.envelope_parameters(df).first().parameters == {"station": "Leith", "ErrorCode": "0"}
    rows = xe.envelope_rows(df, "tides", ["metres", "at"]).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [(0, "5.3", "04:10"), (1, "0.9", "10:22"), (2, None, "16:35")]
    cells = xe.envelope_rows(df).orderBy("row_no").collect()
    assert [r.cells for r in cells[1:]] == [{"at": "10:22", "metres": "0.9"}, {"at": "16:35"}]
    assert xe.discover_columns(df) == ["at", "metres"]


def test_namespaced_elements(spark):
    body = '<q:Root xmlns:q="urn:q"><q:Dataset id="w"><q:Rows><q:Row><q:Col id="kg">7</q:Col></q:Row></q:Rows></q:Dataset></q:Root>'
    assert xe.envelope_rows(parsed(spark, body), "w", ["kg"]).first().kg == "7"


def test_unreadable_bodies(spark):
    df = parsed(spark, "", "junk <", None, "<Root><Dataset", "<Root/>")
    assert [r.readable for r in df.orderBy("n").select("envelope.readable").collect()] == [False] * 4 + [True]
    assert xe.envelope_rows(df, None, ["x"]).count() == 0
    assert {tuple(r.parameters) for r in xe.envelope_parameters(df).collect()} == {()}


def test_edge_cases_of_rows(spark):
    body = (
        "<Root><Dataset id='d'><ColumnInfo><Column id='a'/><Column id='b'/></ColumnInfo><Rows>"
        "<Row/><Row><Col id='a'>1</Col><Col id='a'>2</Col><Col id='z'>9</Col></Row><Row><Col id='b'/></Row>"
        "</Rows></Dataset></Root>"
    )
    rows = xe.envelope_rows(parsed(spark, body), "d", ["a", "b", "z"]).orderBy("row_no").collect()
    assert [tuple(r)[1:] for r in rows] == [(None, None, None), ("2", None, None), (None, "", None)]
    undeclared = "<Root><Dataset><Rows><Row><Col id='q'> x </Col></Row></Rows></Dataset></Root>"
    df = parsed(spark, undeclared)
    assert xe.envelope_rows(df, "ds_out", ["q"]).first().q == " x "
    assert xe.envelope_rows(df, "other", ["q"]).count() == 0


def test_first_dataset_with_a_repeated_id(spark):
    def ds(name, value):
        return f"<Dataset id='{name}'><Rows><Row><Col id='v'>{value}</Col></Row></Rows></Dataset>"

    df = parsed(spark, f"<Root>{ds('a', 1)}{ds('b', 2)}{ds('a', 3)}</Root>")
    assert xe.envelope_rows(df, None, ["v"]).first().v == "3"


def test_wrapped_envelope(spark):
    body = "<Root><Body><Message>" + TIDES[TIDES.index("<Parameters>") : TIDES.index("</Root>")] + "</Message></Body></Root>"
    df = parsed(spark, body, wrapper=["Body", "Message"])
    assert xe.envelope_rows(df, "tides", ["metres"]).count() == 3
    assert df.select(xe.parameter("station").alias("m")).first().m == "Leith"


def test_build_is_readable_by_any_xml_reader(spark):
    rows = spark.createDataFrame(
        [("w", 2, "rope", "A & <B>", None), ("w", 1, "sail", "deck", 3)],
        "k string, n int, part string, place string, pieces int",
    )
    built = xe.build_xml_envelope(
        rows.withColumnRenamed("part", "article"), ["k"], "stores", ["article", "place", "pieces"], ["n"], {"ship": "Vega", "key": F.col("k")},
        namespace="http://example.org/dataset",
    )
    row = built.first()
    root = ElementTree.fromstring(row.body)
    ns = "{http://example.org/dataset}"
    assert root.tag == f"{ns}Root" and row.part == 0
    assert {p.get("id"): p.text for p in root.iter(f"{ns}Parameter")} == {"ship": "Vega", "key": "w"}
    assert [c.get("id") for c in root.iter(f"{ns}Column")] == ["article", "place", "pieces"]
    assert {(c.get("type"), c.get("size")) for c in root.iter(f"{ns}Column")} == {("STRING", "256")}
    assert [[c.text for c in r] for r in root.iter(f"{ns}Row")] == [["sail", "deck", "3"], ["rope", "A & <B>", None]]
    back = xe.envelope_rows(xe.parse_xml_envelope(built), "stores", ["place", "pieces"]).orderBy("row_no")
    assert [tuple(r)[1:] for r in back.collect()] == [("deck", "3"), ("A & <B>", "")]


def test_a_request_is_one_document_in_order_unless_told_otherwise(spark):
    rows = spark.range(0, 12000, 1, 4).selectExpr("'k' AS k", "id")
    whole = xe.envelope_rows(xe.parse_xml_envelope(xe.build_xml_envelope(rows, ["k"], "d", ["id"], ["id"])), "d", ["id"]).orderBy("row_no")
    assert [int(r.id) for r in whole.collect()] == list(range(12000))
    parts = xe.build_xml_envelope(rows, ["k"], "d", ["id"], ["id"], rows_per_envelope=5000)
    back = xe.envelope_rows(xe.parse_xml_envelope(parts), "d", ["id"], keep=["part"]).orderBy("part", "row_no")
    assert [(r.part, int(r.id)) for r in back.collect()] == [(n // 5000, n) for n in range(12000)]


def test_a_large_request_is_cut_into_parts(spark):
    rows = spark.range(0, 3000, 1, 4).selectExpr("CASE WHEN id < 1000 THEN 'hot' ELSE concat('k', id % 300) END AS k", "id")
    built = xe.build_xml_envelope(rows, ["k"], "d", ["id"], ["id"], rows_per_envelope=100).cache()
    per_key = {r.k: r["count"] for r in built.groupBy("k").count().collect()}
    assert per_key.pop("hot") > 5 and set(per_key.values()) == {1}
    back = xe.envelope_rows(xe.parse_xml_envelope(built), "d", ["id"], keep=["k"])
    assert sorted((r.k, int(r.id)) for r in back.collect()) == sorted((r.k, r.id) for r in rows.collect())
    built.unpersist()


DETAIL = (
    "<Root>"
    "<Dataset id='m'><Rows>{m}</Rows></Dataset><Dataset id='i'><Rows>{i}</Rows></Dataset></Root>"
)


def test_datasets_join_stays_within_a_response(spark):
    def rows(*pairs):
        return "".join(f"<Row><Col id='k'>{k}</Col><Col id='{c}'>{v}</Col></Row>" for k, c, v in pairs)

    first = DETAIL.format(m=rows(("1", "a", "x"), ("2", "a", "y")), i=rows(("1", "b", "p"), ("1", "b", "q")))
    other = DETAIL.format(m=rows(("1", "a", "z")), i="")
    no_key = "<Root><Dataset id='m'><Rows><Row><Col id='a'>n</Col></Row></Rows></Dataset><Dataset id='i'><Rows><Row><Col id='b'>n</Col></Row></Rows></Dataset></Root>"
    df = parsed(spark, first, other, first, no_key).coalesce(1)
    out = xe.datasets_join(df, {"m": ["k", "a"], "i": ["k", "b"]}, on=["k"], request=[])
    once = [("1", "x", "p"), ("1", "x", "q"), ("2", "y", None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(once * 2 + [("1", "z", None), (None, "n", None)], key=str)


# -- JSON ----------------------------------------------------------------------------


def test_json_record_shapes(spark):
    texts = [
        '[{"a":1},{"a":2}]',
        '{"data":[{"a":3}],"items":[{"a":9}]}',
        '{"data":{"x":1},"items":[{"a":4}]}',
        '{"a":5}',
        '"text"',
        "7",
        "{broken",
        None,
        '{"data":[]}',
        "null",
    ]
    rows = js.json_records(js.parse_json(bodies(spark, *texts)), {"a": "int"}, keep=["n"])
    assert sorted((r.n, r.a) for r in rows.collect()) == [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5)]


def test_json_request(spark):
    df = spark.createDataFrame([(1, "x", None)], "n int, s string, e string")
    out = js.build_json_request(
        df, {"p": F.col("n"), "d": F.lit(0)}, {"d": F.array(F.struct("s", "e"))}, keep=["n"]
    ).first()
    assert out.request == '{"p":1,"d":[{"s":"x","e":null}]}'


# -- outcomes ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "code, outcome, err_code",
    [
        ('<Parameter id="ErrorCode">0</Parameter>', "ok", None),
        ('<Parameter id="ErrorCode"> 0 </Parameter>', "ok", None),
        ("", "ok", None),
        ('<Parameter id="ErrorCode">-404</Parameter>', "business", "-404"),
        ('<Parameter id="ErrorCode">0.0</Parameter>', "business", "-1"),
        ('<Parameter id="ErrorCode"/>', "business", "-1"),
    ],
)
def test_xml_codes(spark, code, outcome, err_code):
    row = outcomes.tag_xml(parsed(spark, f"<Root><Parameters>{code}</Parameters></Root>")).first()
    assert (row.outcome, row.err_code) == (outcome, err_code)


@pytest.mark.parametrize(
    "body, options, outcome",
    [
        ('{"code":200}', {}, "ok"),
        ('{"code":200.0}', {}, "ok"),
        ('{"code":"200"}', {}, "business"),
        ('{"code":null}', {}, "business"),
        ('{"code":[200]}', {}, "business"),
        ("{}", {}, "ok"),
        ('[{"code":1}]', {}, "ok"),
        ('{"code":1}', {"check": False}, "ok"),
        ('{"ret":"OK"}', {"code_field": "ret", "success_value": "OK"}, "ok"),
        ('{"ret":true}', {"code_field": "ret", "success_value": True}, "ok"),
        ('{"ret":false}', {"code_field": "ret", "success_value": True}, "business"),
        ("oops", {}, "transport"),
    ],
)
def test_json_codes(spark, body, options, outcome):
    assert outcomes.tag_json(js.parse_json(bodies(spark, body)), **options).first().outcome == outcome


def test_delivery(spark):
    df = spark.createDataFrame([(200,), (201,), (500,), (None,)], "status_code int").withColumn("body", F.lit("{}"))
    tagged = outcomes.tag_json(js.parse_json(df))
    assert {r.status_code: r.outcome for r in tagged.collect()} == {
        200: "ok", 201: "ok", 500: "transport", None: "transport",
    }
    xml = outcomes.tag_xml(xe.parse_xml_envelope(df.withColumn("body", F.lit("<Root/>"))))
    assert {r.status_code for r in xml.filter("outcome = 'ok'").collect()} == {200}


def test_split_strategies(spark):
    good, bad = '{"code":200}', '{"code":500,"message":"down"}'
    tagged = outcomes.tag_json(js.parse_json(bodies(spark, good, bad)))
    for strategy in ("skip_row", "continue"):
        split = outcomes.split_errors(tagged, strategy)
        assert (split.ok.count(), split.errors.count(), split.paused) == (1, 1, False)
    assert outcomes.split_errors(tagged, "pause_for_manual").paused
    with pytest.raises(BusinessFailure, match="down"):
        outcomes.split_errors(tagged, "fail")
    with pytest.raises(TransportFailure):
        outcomes.split_errors(outcomes.tag_json(js.parse_json(bodies(spark, bad, "oops"))), "fail")
    with pytest.raises(PipelineError):
        outcomes.split_errors(tagged, "shrug")


# -- spreadsheets --------------------------------------------------------------------


def workbook(rows: str, shared: str | None = None, styles: str | None = None, about: str = "") -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{rel}">{about}<sheets><sheet name="b" sheetId="2" r:id="rId7"/>'
            '<sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
        if styles:
            book.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
    return buffer.getvalue()


def test_date_cells(spark):
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="[h]:mm"/>'
        '<numFmt numFmtId="166" formatCode="0.0 &quot;days&quot;"/><numFmt numFmtId="167" formatCode="[Red]hh:mm"/></numFmts>'
        "<cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165, 166, 167, 22)) + "</cellXfs>"
    )
    head = "<row>" + "".join(f'<c t="inlineStr"><is><t>c{k}</t></is></c>' for k in range(7)) + "</row>"
    line = lambda *values: "<row>" + "".join(f'<c s="{k}"><v>{v}</v></c>' for k, v in enumerate(values)) + "</row>"
    rows = head + line(45000, 45000, 45000.25, 1.5, 3, 0.75, 59) + line(1, 61, 0, 2, 2, 45000.999999, "text")
    books = [("a", workbook(rows, None, styles)), ("b", workbook(rows, None, styles, '<workbookPr date1904="1"/>')), ("c", workbook(rows))]
    got = {(r.path, r.row_no): list(r)[2:] for r in scan_spreadsheets(spark.createDataFrame(books, "path string, content binary"), [f"c{k}" for k in range(7)]).collect()}
    assert got["a", 0] == ["45000", "2023-03-15 00:00:00", "2023-03-15 06:00:00", "1.5", "3", "18:00:00", "1900-02-28 00:00:00"]
    assert got["a", 1] == ["1", "1900-03-01 00:00:00", "00:00:00", "2", "2", "2023-03-16 00:00:00", "text"]
    assert got["b", 0][1] == "2027-03-16 00:00:00"
    assert got["c", 0] == ["45000", "45000", "45000.25", "1.5", "3", "0.75", "59"]


def test_workbook_files(spark, tmp_path):
    shared = "<si><t>Mã SP</t></si><si><r><t>Rich </t></r><r><t>text </t></r></si><si><t>Active?</t></si>"
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="inlineStr"><is><t>Qty</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c><c r="D2"><v>12.5</v></c></row>'
        '<row r="3"/>'
        '<row r="4"><c r="D4"><v>3</v></c><c r="A4" t="e"><v>#N/A</v></c></row>'
    )
    (tmp_path / "one.xlsx").write_bytes(workbook(rows, shared))
    (tmp_path / "two.xlsx").write_bytes(workbook(""))
    books = read_workbooks(spark, str(tmp_path))
    out = scan_spreadsheets(books, ["ma_sp", "unnamed_1", "active", "qty"]).orderBy("row_no").collect()
    assert [tuple(r)[2:] for r in out] == [("Rich text", None, "true", "12.5"), (None, None, None, "3")]
    assert set(scan_spreadsheets(books).first().cells) == {"ma_sp", "unnamed_1", "active", "qty"}


DEEP = [
    '<Root><Parameters><Parameter id="ErrorCode">0</Parameter></Parameters><Body><Dataset id="a"><Rows><Row><Col id="x">1</Col></Row></Rows></Dataset></Body></Root>',
    """<n:Root xmlns:n="u" xmlns:o="v"><n:A><n:B><n:Dataset id="first" o:t="q>r"><n:ColumnInfo><n:Column id="x"/></n:ColumnInfo>
    <n:W><n:Rows><n:Row><n:Col id="x"><![CDATA[<Dataset id="no">&amp;]]></n:Col><n:Col id="y">undeclared</n:Col></n:Row></n:Rows></n:W></n:Dataset>
    <!-- <Dataset id="commented"/> --></n:B><n:Dataset id="second"/><n:Parameter id="p">v</n:Parameter></n:A>
    <n:Dataset id="third"><n:Rows><n:Row><n:Col id="x"> 3 </n:Col></n:Row><n:Row/></n:Rows></n:Dataset></n:Root>""",
    '<Root><Dataset id="a"><Dataset id="b"/></Dataset></Root>',
    '<Root><A><Dataset id="a"></A></Root>',
    '<Root><A><B><C><D><Dataset><Rows><Row><Col id="x">9</Col></Row></Rows></Dataset></D></C></B></A><Parameters><Parameter id="q"/></Parameters></Root>',
    '<Root><!-- <Dataset id="commented"> --><Dataset id="a"><Rows><Row><Col id="x">7</Col></Row></Rows></Dataset></Root>',
]


def test_elements_at_any_depth(spark):
    parsed = xe.envelope_parameters(xe.parse_xml_envelope(spark.createDataFrame(list(enumerate(DEEP)), "k int, body string")))
    found = {r.k: r for r in parsed.select("k", "envelope.readable", "parameters", F.expr("envelope.Dataset._id").alias("ids")).collect()}
    assert [found[k].readable for k in range(6)] == [True, True, False, False, True, True]
    assert (found[0].ids, found[0].parameters) == (["a"], {"ErrorCode": "0"})
    assert (found[1].ids, found[1].parameters) == (["first", "second", "third"], {"p": "v"})
    assert (found[4].ids, found[4].parameters) == ([None], {"q": ""})
    rows = lambda dataset: sorted((r.k, r.x) for r in xe.envelope_rows(parsed, dataset, ["x"], keep=["k"]).collect() if r.x is not None)
    assert rows(None) == [(0, "1"), (1, '<Dataset id="no">&amp;'), (4, "9"), (5, "7")]
    assert rows("third") == [(1, " 3 ")]
    assert rows("commented") == rows("no") == []


def test_known_wrapper_needs_no_second_parse(spark):
    body = '<Root><A><Parameters><Parameter id="p">1</Parameter></Parameters><Dataset id="d"><Rows><Row><Col id="x">5</Col></Row></Rows></Dataset></A></Root>'
    for wrapper in (["A"], [], ["B"]):
        parsed = xe.parse_xml_envelope(spark.createDataFrame([(body,)], "body string"), wrapper=wrapper)
        assert [r.x for r in xe.envelope_rows(parsed, "d", ["x"]).collect()] == ["5"]
