"""Entries of a parse result: parsed rows, client exclusion, bookkeeping totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IN_LIST_LIMIT = 200


def parse_address_list(text: str) -> list[str]:
    """``"10.0.0.1, 10.0.0.2"`` -> list of addresses."""
    return [part.strip() for part in text.split(",") if part.strip()]


def client_of(df: DataFrame) -> Column:
    """Address an entry is excluded by: ip, else source_ip, else client; NULL if it has none."""
    names = [c for c in ("ip", "source_ip", "client") if c in df.columns]
    if not names:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def exclude_clients(df: DataFrame, addresses: Sequence[str] | DataFrame) -> DataFrame:
    """Drop entries of the given clients; entries without an address stay.

    A short list is a plain IN filter, which Catalyst moves next to the scan. A
    long list or a table (its first column) is an anti join.
    """
    client = client_of(df)
    if not isinstance(addresses, DataFrame):
        listed = sorted(set(addresses))
        if not listed:
            return df
        if len(listed) <= _IN_LIST_LIMIT:
            return df.where(client.isNull() | ~client.isin(*listed))
        addresses = df.sparkSession.createDataFrame([(a,) for a in listed], "address string")
    table = addresses.select(F.col(addresses.columns[0]).alias("_address")).distinct()
    return df.withColumn("_client", client).join(
        table, F.col("_client") == F.col("_address"), "left_anti").drop("_client")


def entries(parsed: DataFrame, exclude: Sequence[str] | DataFrame = ()) -> DataFrame:
    """Parsed rows without the excluded clients."""
    rows = parsed.where("parsed").drop("parsed", "blank")
    return exclude_clients(rows, exclude)


def bookkeeping(parsed: DataFrame, by: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """total_lines, parsed, parse_errors and the range of the timestamp texts, in one pass.

    Unparsed lines that are not blank are errors. Exclusion lowers ``parsed``
    and the time range only.
    """
    client = client_of(parsed)
    counted = F.col("parsed")
    if exclude:
        counted = counted & (client.isNull() | ~client.isin(*sorted(set(exclude))))
    header = F.col("is_header") if "is_header" in parsed.columns else F.lit(False)
    stamp = F.when(counted, F.nullif(F.col("timestamp"), F.lit("")))
    return parsed.groupBy(*by).agg(
        F.count("*").alias("total_lines"),
        F.count_if(counted).alias("parsed"),
        F.count_if(~F.col("parsed") & ~F.col("blank") & ~header).alias("parse_errors"),
        F.min(stamp).alias("time_start"),
        F.max(stamp).alias("time_end"),
    )
