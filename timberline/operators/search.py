"""Search in, filter and sort report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(df: DataFrame) -> Column:
    """All columns of a row as one text."""
    return F.concat_ws("\x01", *[
        F.to_json(F.struct(c)) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        for c, t in df.dtypes])


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, case ignored."""
    return df.where(F.contains(F.lower(row_text(df)), F.lit(text.lower())))


def pick(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows equal to the given value in each named column."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def sort_by(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())
