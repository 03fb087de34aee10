"""Text cleaning as column expressions, and header cleaning on the schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accented letters folded to each plain letter.
ACCENTS = {
    "a": "áàảãạăắằẳẵặâấầẩẫậ",
    "e": "éèẻẽẹêếềểễệ",
    "i": "íìỉĩị",
    "o": "óòỏõọôốồổỗộơớờởỡợ",
    "u": "úùủũụưứừửữự",
    "y": "ýỳỷỹỵ",
    "d": "đ",
}
BLANK_HEADER = "col_unnamed"

_FOLD_FROM = "".join(ACCENTS.values())
_FOLD_TO = "".join(plain * len(accented) for plain, accented in ACCENTS.items())
_FOLD = str.maketrans(_FOLD_FROM, _FOLD_TO)


def clean_header(title: str) -> str:
    text = title.strip().lower().translate(_FOLD)
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", text)) or BLANK_HEADER


def clean_headers(titles: list[str]) -> list[str]:
    """Cleaned titles, made distinct with ``_2``, ``_3`` and so on."""
    used: set[str] = set()
    names = []
    for title in titles:
        base = name = clean_header(str(title))
        suffix = 2
        while name in used:
            name = f"{base}_{suffix}"
            suffix += 1
        used.add(name)
        names.append(name)
    return names


def standardize_headers(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`clean_header`; touches metadata only."""
    return df.toDF(*clean_headers(df.columns))


# Every character that counts as whitespace in Python: control, Latin-1 and general spaces.
WHITESPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)


def strip(column: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not spaces alone."""
    return F.btrim(column, F.lit(WHITESPACE))


def normalize_text(column: Column) -> Column:
    """The header rule applied to values.

    One character table folds accents and turns all whitespace into spaces, which keeps
    the two patterns that follow plain and the long texts quick to scan.
    """
    odd_spaces = WHITESPACE.replace(" ", "")
    folded = F.translate(F.lower(strip(column)), _FOLD_FROM + odd_spaces, _FOLD_TO + " " * len(odd_spaces))
    words = F.regexp_replace(folded, r"[^\p{L}\p{N}_ ]", "")
    snake = F.regexp_replace(words, " +", "_")
    return F.regexp_replace(snake, "^$", BLANK_HEADER)


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip every string column."""
    return df.select(
        *[
            strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
