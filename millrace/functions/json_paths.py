"""JSONPath over JSON text, as expressions over variants.

Understood are names (``.a``, ``['a']``), positions (``[0]``, ``[-1]``), everything
(``[*]``, ``.*``), unions (``[0,2]``, ``['a','b']``), slices (``[1:5:2]``), filters on the
elements of a list (``[?(@.a.b > 3 & @.c == 'x')]``, ``[?(@.a)]``, ``=~`` for a pattern) and
descent (``..a``, ``..*``, ``..[0]``). Anything else is no path and matches nothing.

Matches come in the order of the document. The members of an object are visited by name,
since a variant keeps no other order.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

Nodes = Callable[[Column], Column]  # one variant to the array of its matches

_NONE = "array<variant>"
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_STEP = re.compile(
    rf"""(?P<deep>\.\.)?(?:
        \.?(?P<name>[^\s.\[\]*?@()'",:]+) | \.?(?P<every>\*) |
        \[\s*(?:(?P<all>\*) | (?P<places>-?\d+(?:\s*,\s*-?\d+)*) | (?P<slice>-?\d*\s*:\s*-?\d*(?:\s*:\s*\d*)?)
          | (?P<names>(?:{_QUOTED})(?:\s*,\s*(?:{_QUOTED}))*) | \?\s*(?P<filter>(?:[^'"\]\[]|\[\d+\]|{_QUOTED})+))\s*\])""",
    re.X,
)
_CONDITION = re.compile(
    rf"""\s*@(?P<path>(?:\.[^\s.\[\]=!<>&()'"]+|\[\d+\]|\[(?:{_QUOTED})\])*)
         \s*(?:(?P<op>==|!=|<=|>=|=~|=|<|>)\s*(?P<value>{_QUOTED}|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))?\s*""",
    re.X,
)


def _member(name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


def _bound(value: Column, to: Callable[[Column], Column]) -> Column:
    """``to(value)`` with ``value`` worked out once, however often ``to`` and lambdas in it use it."""
    return F.get(F.transform(F.array(value), to), F.lit(0))


def _list(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", _NONE), F.array().cast(_NONE))


def _children(v: Column) -> Column:
    members = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.try_variant_get(v, "$", _NONE), members, F.array().cast(_NONE))


def _present(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def _slice(text: str) -> Nodes:
    first, last, step = ([p.strip() for p in text.split(":")] + [""])[:3]
    stride = int(step or 1)
    if stride < 1:
        raise ValueError("a slice goes forward")

    def at(place: str, size: Column, absent: Column) -> Column:
        if not place:
            return absent
        return F.lit(int(place)) if int(place) >= 0 else F.greatest(size + int(place), F.lit(0))

    def nodes(v: Column) -> Column:
        return _bound(_list(v), cut)

    def cut(items: Column) -> Column:
        ends = F.struct(at(first, F.size(items), F.lit(0)).alias("low"), at(last, F.size(items), F.size(items)).alias("high"))
        return _bound(ends, lambda e: F.filter(items, lambda x, i: (i >= e["low"]) & (i < e["high"]) & ((i - e["low"]) % stride == 0)))

    return nodes


def _place(place: int) -> Callable[[Column], Column]:
    if place >= 0:
        return lambda v: F.try_variant_get(v, f"$[{place}]", "variant")
    return lambda v: _bound(_list(v), lambda items: F.get(items, F.size(items) + place))


def _condition(text: str) -> Callable[[Column], Column]:
    """A test of one element, from one comparison."""
    found = _CONDITION.fullmatch(text)
    if found is None:
        raise ValueError(f"no condition: {text}")
    path = "$" + found["path"]
    op, value = found["op"], found["value"]

    def holds(v: Column) -> Column:
        at = F.try_variant_get(v, path, "variant")
        kind = F.schema_of_variant(at)
        if op is None:
            return at.isNotNull()
        if value == "null":
            same = kind == "VOID"
            return same if op in ("==", "=") else at.isNotNull() & ~same if op == "!=" else F.lit(False)
        if value in ("true", "false"):
            left, right, fits = F.try_variant_get(at, "$", "boolean"), F.lit(value == "true"), kind == "BOOLEAN"
        elif value[0] in "'\"":
            left, right, fits = F.try_variant_get(at, "$", "string"), F.lit(_unquoted(value)), kind == "STRING"
        else:
            left, right, fits = F.try_variant_get(at, "$", "double"), F.lit(float(value)), kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if op == "!=":
            return at.isNotNull() & ~F.coalesce(fits & (left == right), F.lit(False))
        compared = {
            "==": left == right, "=": left == right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right,
            "=~": F.regexp_like(left.cast("string"), right.cast("string")),
        }
        return F.coalesce(fits & compared[op], F.lit(False))

    return holds


def _conditions(text: str) -> Nodes:
    text = text.strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    parts, at = [], 0
    for quoted_or_and in re.finditer(rf"{_QUOTED}|&&?", text):
        if quoted_or_and[0][0] == "&":
            parts.append(text[at : quoted_or_and.start()])
            at = quoted_or_and.end()
    tests = [_condition(part) for part in [*parts, text[at:]]]
    return lambda v: F.filter(_list(v), lambda x: reduce(lambda a, b: a & b, [test(x) for test in tests]))


def _nodes(found: re.Match) -> Nodes:
    if found["name"]:
        path = _member(found["name"])
        return lambda v: _present(F.try_variant_get(v, path, "variant"))
    if found["names"]:
        paths = [_member(_unquoted(q)) for q in re.findall(_QUOTED, found["names"])]
        return lambda v: _present(*[F.try_variant_get(v, p, "variant") for p in paths])
    if found["every"] or found["all"]:
        return _children
    if found["places"]:
        places = [_place(int(p)) for p in found["places"].split(",")]
        return lambda v: _present(*[place(v) for place in places])
    return _slice(found["slice"]) if found["slice"] else _conditions(found["filter"])


def parse_path(path: str) -> list[tuple[bool, Nodes]]:
    """(whether it descends, its matches) for every step; raises ``ValueError`` on a bad path."""
    if not path.startswith("$"):
        raise ValueError("a path starts at $")
    at, steps = 1, []
    while at < len(path):
        found = _STEP.match(path, at)
        dotted = found is not None and (found["name"] is None or found["deep"] or path[at] == ".")
        if not dotted:
            raise ValueError(f"no step at {path[at:]}")
        steps.append((bool(found["deep"]), _nodes(found)))
        at = found.end()
    return steps


def _depth(text: Column) -> Column:
    """How deep lists and objects are nested in JSON text."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    signs = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, sign: Column) -> Column:
        now = s["now"] + F.when(sign.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(signs, start, step, lambda s: s["most"])


def _descendants(v: Column, depth: Column) -> Column:
    """``v`` and all that is inside it, each before what it holds."""
    kind = "array<struct<place: array<int>, v: variant>>"

    def below(node: Column) -> Column:
        return F.transform(_children(node["v"]), lambda x, i: F.struct(F.concat(node["place"], F.array(i)).alias("place"), x.alias("v")))

    def deeper(s: Column, _: Column) -> Column:
        front = F.flatten(F.transform(s["front"], below)).cast(kind)
        return _bound(front, lambda f: F.struct(f.alias("front"), F.concat(s["all"], f).alias("all")))

    def in_order(nodes: Column) -> Column:
        places = F.sort_array(F.transform(nodes, lambda x, i: F.struct(x["place"].alias("place"), i.alias("no"))))
        return F.transform(places, lambda p: F.get(nodes, p["no"])["v"])

    root = F.array(F.struct(F.array().cast("array<int>").alias("place"), v.alias("v"))).cast(kind)
    found = F.aggregate(F.sequence(F.lit(0), depth), F.struct(root.alias("front"), root.alias("all")), deeper, lambda s: s["all"])
    return _bound(found, in_order)


def json_nodes(text: Column, path: str, parsed: Column | None = None) -> Column:
    """All matches of ``path`` in JSON text as variants, in order; NULL for a bad path or text that is not JSON.

    ``parsed`` is a column that holds the text's ``try_parse_json`` already, for several paths over one text.
    """
    try:
        steps = parse_path(path)
    except ValueError as error:
        log.warning("no JSON path: %s (%s)", path, error)
        return F.lit(None).cast(_NONE)

    def matches(root: Column) -> Column:
        found = F.array(root)
        for deep, nodes in steps:
            if deep:
                found = _each(found, lambda v: _bound(_depth(text), lambda depth: _descendants(v, depth)))
            found = _each(found, nodes)
        return F.when(root.isNotNull(), found)

    return _bound(F.try_parse_json(text) if parsed is None else parsed, matches)


def _each(found: Column, nodes: Nodes) -> Column:
    return F.flatten(F.transform(found, lambda v: nodes(v)))


def json_matches(column: Column | str, path: str, parsed: Column | str | None = None) -> Column:
    """All matches of a JSONPath as text; JSON null is NULL. ``parsed``: see ``json_nodes``."""
    column, parsed = (F.col(c) if isinstance(c, str) else c for c in (column, parsed))
    return F.transform(json_nodes(column, path, parsed), lambda x: F.try_variant_get(x, "$", "string"))


def json_path(column: Column | str, path: str, parsed: Column | str | None = None) -> Column:
    """First match of a JSONPath in JSON text; no match, JSON null or a bad path give NULL."""
    column = F.col(column) if isinstance(column, str) else column
    if re.fullmatch(r"\$(\.\w+|\[\d+\])*", path):
        return F.get_json_object(column, path)
    return F.get(json_matches(column, path, parsed), F.lit(0))
