"""Small column helpers: casts from a type map, text flags, keys and fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage type of each retail column that is narrowed on read.
RETAIL_TYPES = {
    "store_nbr": "smallint",
    "cluster": "smallint",
    "perishable": "smallint",
    "class": "int",
    "transactions": "int",
    "oil_price": "float",
    "onpromotion": "smallint",
    "item_nbr": "bigint",
    "unit_sales": "float",
}


def downcast(df: DataFrame, types: Mapping[str, str] = RETAIL_TYPES) -> DataFrame:
    """Cast every mapped column that is present; under ANSI mode an overflow raises."""
    present = {c: F.col(c).cast(types[c]) for c in df.columns if c in types}
    return df.withColumns(present) if present else df


def text_flag(text: Column, true_text: str = "True") -> Column:
    """Text to boolean; null stays null."""
    return text == F.lit(true_text)


def composite_key(*parts: Column, sep: str = "_") -> Column:
    """``a_b``; null when any part is null, unlike ``concat_ws``."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(part.cast("string"))
    return F.concat(*pieces)


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def feature_vector(names: Sequence[str]) -> Column:
    """Named columns as one ``ARRAY<DOUBLE>`` in the given order."""
    return F.array(*[F.col(n).cast("double") for n in names])


def month_to_index(month: Column) -> Column:
    return month - 1


def index_to_month(index: Column) -> Column:
    return index + 1


def log_target(value: Column, zero: str = "null") -> Column:
    """Natural log; a zero gives null (then forward filled) or minus infinity."""
    x = value.cast("double")
    if zero == "null":
        return F.when(x > 0, F.ln(x))
    if zero == "neg_inf":
        return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.ln(x))
    raise ValueError("zero must be 'null' or 'neg_inf'")
