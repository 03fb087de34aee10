"""JSONPath against a table of paths and what they match."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.json_paths import json_matches, json_path

DOC = {
    "shelf": {
        "book": [
            {"title": "Tides", "price": 8, "tags": ["sea", "moon"], "by": {"name": "Ann"}},
            {"title": "Stones", "price": 12.5, "tags": [], "isbn": "x-1"},
            {"title": "Winds", "price": 22, "tags": ["air"], "isbn": None},
            {"title": "It's \"odd\" [1]", "price": "free", "sold": True},
        ],
        "lamp": {"price": 19, "on": False},
    },
    "a.b": 1,
    "deep": [[1, [2, {"price": 3}]], []],
    "none": None,
}
TITLES = [b["title"] for b in DOC["shelf"]["book"]]
MATCHES = {
    "$.shelf.lamp.price": [19],
    "$['shelf']['lamp']['on']": [False],
    "$['a.b']": [1],
    "$.shelf.book[0].title": ["Tides"],
    "$.shelf.book[-1].price": ["free"],
    "$.shelf.book[9].title": [],
    "$.shelf.book[*].title": TITLES,
    "$.shelf.book[0,2].title": ["Tides", "Winds"],
    "$.shelf.lamp['price','on']": [19, False],
    "$.shelf.book[1:3].title": ["Stones", "Winds"],
    "$.shelf.book[-2:].title": TITLES[-2:],
    "$.shelf.book[:-2].title": TITLES[:-2],
    "$.shelf.book[::2].title": TITLES[::2],
    "$.shelf.book[?(@.price > 10)].title": ["Stones", "Winds"],
    "$.shelf.book[?(@.price >= 8 & @.price < 20)].title": ["Tides", "Stones"],
    "$.shelf.book[?(@.isbn)].title": ["Stones", "Winds"],
    "$.shelf.book[?(@.isbn == null)].title": ["Winds"],
    "$.shelf.book[?(@.sold == true)].price": ["free"],
    "$.shelf.book[?(@.title == 'Winds')].price": [22],
    "$.shelf.book[?(@.title != 'Winds')].title": [t for t in TITLES if t != "Winds"],
    "$.shelf.book[?(@.title =~ '^[ST]')].title": ["Tides", "Stones"],
    "$.shelf.book[?(@.tags[0] == 'sea')].by.name": ["Ann"],
    "$.shelf.book[?@.by.name == \"Ann\"].title": ["Tides"],
    "$..price": [3, 8, 12.5, 22, "free", 19],
    "$.shelf..price": [8, 12.5, 22, "free", 19],
    "$..book[0].title": ["Tides"],
    "$..tags[0]": ["sea", "air"],
    "$.deep..price": [3],
    "$.deep[*][1][0]": [2],
    "$.shelf.lamp.*": [False, 19],
    "$.deep..*": [[1, [2, {"price": 3}]], [], 1, [2, {"price": 3}], 2, {"price": 3}, 3],
    "$.none": [None],
    "$.gone..price": [],
    "$": [DOC],
}
BAD = ["shelf", "$.", "$shelf", "$.shelf[", "$.shelf[?(@.x >)]", "$[1:2:-1]", "$.a b", "$[?(x)]", "", "$...a"]


@pytest.fixture(scope="module")
def doc(spark):
    return spark.createDataFrame([(json.dumps(DOC),)], "j string").cache()


def _value(text):
    return None if text is None else text


def test_all_matches(doc):
    row = doc.select(*[json_matches("j", path).alias(f"m{k}") for k, path in enumerate(MATCHES)]).first()
    for k, (path, want) in enumerate(MATCHES.items()):
        got = row[k]
        assert len(got) == len(want), path
        for text, value in zip(got, want, strict=True):
            if value is None or isinstance(value, str):
                assert text == value, path
            else:
                assert json.loads(text) == value, path


def test_first_match(doc):
    row = doc.select(*[json_path("j", path).alias(f"m{k}") for k, path in enumerate(MATCHES)]).first()
    for k, (path, want) in enumerate(MATCHES.items()):
        value = want[0] if want else None
        assert row[k] == value if value is None or isinstance(value, str) else json.loads(row[k]) == value, path


def test_bad_paths_and_bad_json_are_null(spark, doc):
    assert set(doc.select(*[json_path("j", path).alias(f"m{k}") for k, path in enumerate(BAD)]).first()) == {None}
    texts = spark.createDataFrame([(None,), ("",), ("{",), ("[1, 2]",), ('"s"',), ('{"k": null}',)], "j string")
    assert [r[0] for r in texts.select(json_path("j", "$..k")).collect()] == [None] * 6
    assert [r[0] for r in texts.select(json_path("j", "$[*]")).collect()] == [None, None, None, "1", None, None]


def test_descent_of_a_deep_document(spark):
    deep = '{"a":' * 60 + '{"k":7}' + "}" * 60
    odd = json.dumps({"s": '[[[{"k": 1}', "t\\": [{"k": 2}]})
    got = spark.createDataFrame([(deep,), (odd,)], "j string").select(json_matches("j", "$..k"), F.lit(1)).collect()
    assert [r[0] for r in got] == [["7"], ["2"]]


def test_text_parsed_beforehand_gives_the_same(spark):
    texts = ['{"a":[{"b":1},{"b":[2,{"b":null}]}],"c":{"b":"x"}}', "[]", "7", "no json", None]
    rows = spark.createDataFrame([(t,) for t in texts], "doc string").withColumn("parsed", F.try_parse_json("doc"))
    for path in ["$..b", "$.a[-1:].b", "$.a[-1].b", "$..*", "$.a[?(@.b == 1)].b", "$['c']['b']", "$"]:
        found = rows.select(json_matches("doc", path).alias("own"), json_matches("doc", path, "parsed").alias("given")).collect()
        assert [r["own"] for r in found] == [r["given"] for r in found]
    first = rows.select(json_matches("doc", "$..b", "parsed").alias("m")).first()["m"]
    assert first == ["1", '[2,{"b":null}]', None, "x"]
