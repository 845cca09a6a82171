"""Reports as JSON, CSV and plain text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(report: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """One folder of JSON lines per output, written by the executors."""
    for name, df in report.items():
        df.write.mode(mode).json(f"{path}/{name}")


def as_json(df: DataFrame, name: str = "row") -> DataFrame:
    """Rows as JSON text, NULL fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = ("array", "struct", "map")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_csv(report: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """One folder of CSV with header per output."""
    for name, df in report.items():
        _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(f"{path}/{name}")


def text_summary(summary: DataFrame, title: str) -> DataFrame:
    """The summary as plain text, one ``line`` row per report line."""
    parts = [F.lit(title)] + [
        F.concat(F.lit(f"{c}: "), F.coalesce((F.to_json(c) if t.startswith(("array", "struct", "map"))
                                              else F.col(c).cast("string")), F.lit("-")))
        for c, t in summary.dtypes]
    return summary.select(F.posexplode(F.array(*parts)).alias("line_no", "line"))
