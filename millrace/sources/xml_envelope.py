"""XML envelopes: ``Root`` with parameters and datasets of rows, one document per row.

Shape::

    Root / Parameters / Parameter[@id]
    Root / Dataset[@id] / ColumnInfo / Column[@id,@type,@size]
    Root / Dataset[@id] / Rows / Row / Col[@id]

``Parameters``, ``ColumnInfo`` and ``Rows`` may be repeated; their contents are one list.
Any of these elements may stand deeper, below elements of other names: ``Parameter`` and
``Dataset`` anywhere in the document, ``ColumnInfo`` and ``Rows`` anywhere in a dataset.

Every value is text. An empty element is ``""``; an absent ``Col`` is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format.
DEFAULT_DATASET = "ds_out"
COLUMN_TYPE = "STRING"
COLUMN_SIZE = "256"

_ITEM = "struct<_id: string, _VALUE: string>"
_PARAMETERS = f"array<struct<Parameter: array<{_ITEM}>>>"
_DATASETS = (
    "array<struct<_id: string,"
    " ColumnInfo: array<struct<Column: array<struct<_id: string>>>>,"
    f" Rows: array<struct<Row: array<struct<Col: array<{_ITEM}>>>>>>>"
)
_BAD = "_corrupt"
ENVELOPE = "envelope"


def parse_xml_envelope(df: DataFrame, body: str = "body", wrapper: Sequence[str] = ()) -> DataFrame:
    """Add column ``envelope``: ``struct<readable, Parameters, Dataset>``.

    Documents are parsed by the shape above. Where that finds fewer parameters, datasets
    and rows than the text has tags for, they stand deeper: they are lifted out of what is
    around them, in the order of the document, and parsed again. ``wrapper`` names elements
    known to be around them, outermost first, which saves the second parse.

    A malformed, empty or NULL body is not ``readable``, nor is one with a dataset inside
    another.
    """
    content = f"Parameters: {_PARAMETERS}, Dataset: {_DATASETS}"
    wrapped = content
    for element in reversed(wrapper):
        wrapped = f"{element}: struct<{wrapped}>"
    # Taking the parsed struct out of a one-element array makes it a row of its own, so
    # later filters and columns read it instead of parsing the body again.
    once = df.select("*", F.explode(F.array(_parsed(F.col(body), wrapped))).alias("__xml"))
    inside = F.col("__xml")
    for element in wrapper:
        inside = inside.getField(element)
    parts = [inside.getField("Parameters"), inside.getField("Dataset")]
    direct = F.struct(parts[0].alias("Parameters"), parts[1].alias("Dataset"), F.col("__xml").getField(_BAD).alias(_BAD))
    sound = F.col("__xml").isNotNull() & F.col("__xml").getField(_BAD).isNull()
    missed = sound & (F.regexp_count(F.col(body), F.lit(_TAGS)) > _found(*parts))
    chosen = F.when(missed, _parsed(_lifted(F.col(body)), content)).when(sound, direct)
    once = once.select("*", F.explode(F.array(chosen)).alias("__chosen"))
    readable = F.col("__chosen").isNotNull() & F.col("__chosen").getField(_BAD).isNull()
    envelope = F.struct(
        readable.alias("readable"),
        _joined(F.col("__chosen").getField("Parameters"), "Parameters", "Parameter"),
        F.transform(
            F.col("__chosen").getField("Dataset"),
            lambda d: F.struct(
                d.getField("_id").alias("_id"),
                _joined(d.getField("ColumnInfo"), "ColumnInfo", "Column"),
                _joined(d.getField("Rows"), "Rows", "Row"),
            ),
        ).alias("Dataset"),
    )
    return once.select("*", F.explode(F.array(envelope)).alias(ENVELOPE)).drop("__xml", "__chosen")


def _parsed(text: Column, content: str) -> Column:
    return F.from_xml(
        text,
        f"struct<{content}, {_BAD}: string>",
        {
            "ignoreNamespace": "true",
            "ignoreSurroundingSpaces": "false",
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": _BAD,
        },
    )


_TAGS = r"<(?:[\w.-]+:)?(?:Dataset|Parameter|Row)[\s/>]"


def _found(parameters: Column, datasets: Column) -> Column:
    """How many parameters, datasets and rows have been parsed."""

    def total(lists: Column, size: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.coalesce(lists, F.array()), F.lit(0), lambda n, x: n + size(x))

    def length(items: Column) -> Column:
        return F.coalesce(F.size(items), F.lit(0))

    rows = total(datasets, lambda d: total(d.getField("Rows"), lambda r: length(r.getField("Row"))))
    return length(datasets) + rows + total(parameters, lambda p: length(p.getField("Parameter")))


def _element(name: str) -> Column:
    """A pattern for a whole element that does not hold another of its name."""
    prefix, attributes = r"(?:[\w.-]+:)?", r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
    return F.lit(rf"(?s)<{prefix}{name}{attributes}(?:/>|>.*?</{prefix}{name}\s*>)")


def _lifted(text: Column) -> Column:
    """The document with its parameters and datasets directly below the root; NULL if one is inside another."""
    # Comments go; what stands in CDATA becomes plain text, so tags in it are none.
    text = F.regexp_replace(text, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->|<\?.*?\?>", "$1")
    parts = F.split(text, r"<!\[CDATA\[")

    def plain(part: Column, at: Column) -> Column:
        inner = F.substring_index(part, "]]>", 1)
        escaped = F.replace(F.replace(F.replace(inner, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(at == 0, part).otherwise(F.concat(escaped, F.substr(part, F.length(inner) + 4)))

    text = F.array_join(F.transform(parts, plain), "")
    # prefixes were declared further up
    text = F.regexp_replace(text, r"<(/?)[\w.-]+:([\w.-]+)", "<$1$2")

    def all_of(name: str, within: Column) -> Column:
        return F.regexp_extract_all(within, _element(name), F.lit(0))

    def dataset(d: Column) -> Column:
        opening = F.regexp_extract(d, r"""^<Dataset(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*""", 0)
        inside = F.concat(all_of("ColumnInfo", d), all_of("Rows", d))
        return F.concat(opening, F.lit(">"), F.array_join(inside, ""), F.lit("</Dataset>"))

    parameters, datasets = all_of("Parameter", text), all_of("Dataset", text)
    whole = F.size(parameters) + F.size(datasets) == F.regexp_count(text, F.lit(r"<(?:Dataset|Parameter)[\s/>]"))
    listed = [F.array_join(parameters, ""), F.lit("</Parameters>"), F.array_join(F.transform(datasets, dataset), "")]
    return F.when(whole, F.concat(F.lit("<Root><Parameters>"), *listed, F.lit("</Root>")))


def _joined(blocks: Column, name: str, item: str) -> Column:
    """Repeated blocks as one, with the items of all in order."""
    lists = F.filter(F.transform(blocks, lambda b: b.getField(item)), lambda x: x.isNotNull())
    return F.struct(F.flatten(lists).alias(item)).alias(name)


def _text(item: Column) -> Column:
    return F.coalesce(item.getField("_VALUE"), F.lit(""))


def _last_text(items: Column, name: Column | str) -> Column:
    """Text of the last element with this id; NULL when there is none."""
    wanted = F.lit(name) if isinstance(name, str) else name
    texts = F.transform(F.filter(items, lambda x: x.getField("_id") == wanted), _text)
    return F.try_element_at(texts, F.lit(-1))


def _as_map(items: Column) -> Column:
    """id -> text; a later entry replaces an earlier one, entries without an id are left out."""
    named = F.filter(items, lambda x: x.getField("_id").isNotNull())
    ids = F.array_distinct(F.transform(named, lambda x: x.getField("_id")))
    return F.map_from_arrays(ids, F.transform(ids, lambda i: _last_text(named, i)))


def envelope_parameters(df: DataFrame) -> DataFrame:
    """Add ``parameters map<string,string>``; empty when the envelope has none."""
    items = F.coalesce(F.col(ENVELOPE).Parameters.Parameter, F.array().cast(f"array<{_ITEM}>"))
    return df.withColumn("parameters", _as_map(items))


def parameter(name: str) -> Column:
    """One parameter of ``envelope``; NULL when absent or without an id."""
    return _last_text(F.col(ENVELOPE).Parameters.Parameter, name) if name else F.lit(None).cast("string")


def _dataset_id(dataset: Column) -> Column:
    return F.coalesce(dataset.getField("_id"), F.lit(DEFAULT_DATASET))


def _dataset(name: Column) -> Column:
    """The last dataset of that id: a repeated id replaces the earlier one."""
    return F.try_element_at(F.filter(F.col(ENVELOPE).Dataset, lambda d: _dataset_id(d) == name), F.lit(-1))


def first_dataset_id() -> Column:
    first = F.get(F.col(ENVELOPE).Dataset, F.lit(0))
    return F.when(first.isNotNull(), _dataset_id(first))


def _cells(dataset: Column, row: Column) -> Column:
    """The cells of a row that its dataset declares; all when it declares no column."""
    declared = F.transform(dataset.getField("ColumnInfo").getField("Column"), lambda c: c.getField("_id"))
    cols = row.getField("Col")
    return F.when(F.coalesce(F.size(declared), F.lit(0)) <= 0, cols).otherwise(
        F.filter(cols, lambda c: F.array_contains(declared, c.getField("_id")))
    )


def envelope_rows(
    df: DataFrame,
    dataset: str | None = None,
    columns: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of one dataset per envelope: ``keep``, ``row_no`` and the cells.

    ``dataset`` None takes the first dataset of each envelope. With ``columns`` each named
    cell is a string column; without, the cells are ``cells map<string,string>``.
    """
    chosen = _dataset(F.lit(dataset) if dataset is not None else first_dataset_id())
    with_set = df.select(*keep, chosen.alias("__ds"))
    rows = with_set.select(*keep, "__ds", F.posexplode(F.col("__ds").Rows.Row).alias("row_no", "__row"))
    cells = rows.select(*keep, "row_no", _cells(F.col("__ds"), F.col("__row")).alias("__cells"))
    return cells.select(*keep, "row_no", *_outputs("__cells", columns))


def _outputs(cells: str, columns: Sequence[str] | None) -> list[Column]:
    if columns is None:
        empty = F.array().cast(f"array<{_ITEM}>")
        return [_as_map(F.coalesce(F.col(cells), empty)).alias("cells")]
    return [_last_text(F.col(cells), name).alias(name) for name in columns]


def discover_columns(df: DataFrame, dataset: str | None = None) -> list[str]:
    """Cell names in use, in order of name. One pass; only distinct names reach the driver."""
    rows = envelope_rows(df, dataset)
    names = rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct()
    return sorted(r["name"] for r in names.collect())


def datasets_join(
    df: DataFrame,
    datasets: Mapping[str, Sequence[str]],
    on: Sequence[str],
    request: Sequence[str],
    body: str = "body",
) -> DataFrame:
    """Columns of several datasets of one response side by side.

    The first dataset leads; the others are left-joined to it on ``on`` within the same
    response. Each document is parsed once and its rows meet in one shuffle. A group is a
    key within a document; copies of a document share one, so it also tells apart the
    input partition, which bounds a group however often a document is repeated.
    """
    request, on, ids = list(request), list(on), list(datasets)
    document = ["__part", "__digest"]
    wanted = [F.struct(F.lit(i).alias("id"), _dataset(F.lit(i)).alias("set")) for i in ids]
    sets = df.select(
        *request,
        F.spark_partition_id().alias("__part"),
        F.sha2(F.col(body), 256).alias("__digest"),
        F.explode(F.array(*wanted)).alias("__e"),
    )
    rows = sets.select(*request, *document, "__e", F.posexplode("__e.set.Rows.Row").alias("__no", "__row"))
    cells = rows.select(
        *request, *document, "__e.id", "__no", _cells(F.col("__e.set"), F.col("__row")).alias("__cells")
    )

    def values(n: int, name: str) -> Column:
        rest = [c for c in datasets[name] if c not in on]
        return F.when(F.col("id") == name, F.struct("__no", *_outputs("__cells", rest))).alias(f"__of_{n}")

    keyed = cells.select(
        *request, *document, *_outputs("__cells", on), *[values(n, name) for n, name in enumerate(ids)]
    )
    # Copies of a document repeat the leading rows, not the rows joined to them.
    collect = [F.collect_list] + [F.collect_set] * (len(ids) - 1)
    grouped = keyed.groupBy(*request, *document, *on).agg(
        *[fn(f"__of_{n}").alias(f"__of_{n}") for n, fn in enumerate(collect)]
    )
    keys_set = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in on], F.lit(True))
    joined = grouped.withColumn("__of_0", F.explode("__of_0"))
    for n in range(1, len(ids)):
        joined = joined.withColumn(f"__of_{n}", F.explode_outer(F.when(keys_set, F.col(f"__of_{n}"))))
    outputs = [
        F.col(f"__of_{n}").getField(c).alias(c) for n, name in enumerate(ids) for c in datasets[name] if c not in on
    ]
    return joined.select(*request, *on, *outputs)


# -- building -----------------------------------------------------------------------


def _id_value(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("_id"), F.coalesce(value.cast("string"), F.lit("")).alias("_VALUE"))


def build_xml_envelope(
    df: DataFrame,
    keys: Sequence[str],
    dataset: str,
    columns: Sequence[str],
    order: Sequence[str],
    parameters: Mapping[str, str | Column] | None = None,
    namespace: str | None = None,
    rows_per_envelope: int | None = None,
) -> DataFrame:
    """One envelope per request: ``keys``, ``part`` and ``body``.

    Rows are listed by ``order``. A request has one envelope, part 0. Only if
    ``rows_per_envelope`` is given is it cut into parts of so many rows each, in order.
    ``parameters`` are constants or expressions over ``keys``.
    """
    keys = list(keys)
    if rows_per_envelope is None:
        placed = df.withColumn("part", F.lit(0))
    else:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        placed = df.withColumn("part", F.floor(place / rows_per_envelope).cast("int"))

    listed = placed.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("__row")))).alias("__rows")
    )

    def rows(build) -> Column:
        return F.transform("__rows", lambda r: build([r["__row"][c] for c in columns]))

    body = envelope_document(parameters, F.array(dataset_struct(dataset, columns, rows)), namespace)
    return listed.select(*keys, "part", body.alias("body"))


def build_parameters_envelope(df: DataFrame, keys: Sequence[str], parameters: Mapping[str, str | Column]) -> DataFrame:
    """An envelope per row that carries parameters only."""
    return df.select(*keys, envelope_document(parameters, None).alias("body"))


def dataset_struct(
    name: str, columns: Sequence[str], rows: Callable[[Callable[[list[Column]], Column]], Column]
) -> Column:
    """A dataset element. ``rows(build)`` returns the array of ``build(values)`` results."""
    info = [
        F.struct(F.lit(c).alias("_id"), F.lit(COLUMN_TYPE).alias("_type"), F.lit(COLUMN_SIZE).alias("_size"))
        for c in columns
    ]

    def build(values: list[Column]) -> Column:
        return F.struct(F.array(*[_id_value(c, v) for c, v in zip(columns, values)]).alias("Col"))

    return F.struct(
        F.lit(name).alias("_id"),
        F.struct(F.array(*info).alias("Column")).alias("ColumnInfo"),
        F.struct(rows(build).alias("Row")).alias("Rows"),
    )


def envelope_document(
    parameters: Mapping[str, str | Column] | None, datasets: Column | None, namespace: str | None = None
) -> Column:
    """The XML text of an envelope."""
    fields = [F.lit(namespace).alias("_xmlns")] if namespace else []
    items = [
        _id_value(name, value if isinstance(value, Column) else F.lit(value))
        for name, value in (parameters or {}).items()
    ]
    listed = F.array(*items) if items else F.array().cast(f"array<{_ITEM}>")
    fields.append(F.struct(listed.alias("Parameter")).alias("Parameters"))
    if datasets is not None:
        fields.append(datasets.alias("Dataset"))
    return F.to_xml(F.struct(*fields), {"rowTag": "Root"})
