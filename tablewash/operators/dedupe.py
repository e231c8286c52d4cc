"""Exact deduplication, first row wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewash.operators import headers
from tablewash.operators.headers import ROW_ID
from tablewash.operators.ordering import ORDER, row_id, with_order_number


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Keep one of each identical row (the first); NULL equals NULL.

    A hash aggregate: copies collapse before the shuffle, so a row that makes
    up a third of the table travels once per task.  Rows are grouped by their
    values themselves; the order is one BIGINT, which a hash aggregate can hold.
    """
    columns = headers.business_columns(df)
    if ROW_ID not in df.columns:
        return df.dropDuplicates(columns)
    quoted = [F.col(f"`{c}`") for c in columns]
    if isinstance(df.schema[ROW_ID].dataType, T.IntegralType):
        return df.groupBy(*quoted).agg(F.min(ROW_ID).alias(ROW_ID))
    numbered = with_order_number(df)
    firsts = numbered.groupBy(*quoted).agg(F.min(ORDER).alias(ORDER))
    return firsts.join(numbered.select(ORDER, ROW_ID), ORDER).drop(ORDER)


def first_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ``_rid`` of the first row of each combination of values; NULL equals NULL.

    Only the columns and the order travel, combined before the shuffle.
    """
    numbered = with_order_number(df.select(ROW_ID, *[F.col(f"`{c}`") for c in columns]))
    firsts = numbered.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(ORDER).alias(ORDER)).select(ORDER)
    return numbered.select(ORDER, ROW_ID).join(firsts, ORDER, "left_semi").select(ROW_ID)


def dedupe_column(df: DataFrame, column: str) -> DataFrame:
    """Keep the first row of each value of ``column``; one NULL row survives.

    The rank filter becomes a group limit of one row per value before the
    shuffle, so a hot value sends one row per task.
    """
    first = Window.partitionBy(F.col(f"`{column}`")).orderBy(row_id(df, "dedupe by column"))
    return (
        df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    )
