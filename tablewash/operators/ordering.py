"""Row identity: the hidden ``_rid`` column that "first row wins" is defined on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewash.operators.checkpoints import staged
from tablewash.operators.headers import ROW_ID

ORDER, ROW_INDEX = "_order", "row_index"
# Bits of an order number that hold the row within its block.
ROW_BITS = 33


def with_row_id(df: DataFrame, order_by: str | Sequence[str] | None) -> DataFrame:
    """Add ``_rid`` from a unique natural key; one column is kept unwrapped.

    A frame from ``read_table`` already carries the file position as ``_rid``.
    """
    if order_by is None:
        return df
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"order_by columns {missing} are not in the table: {df.columns}")
    cols = [F.col(f"`{k}`") for k in keys]
    return df.withColumn(ROW_ID, cols[0] if len(cols) == 1 else F.struct(*cols))


def row_id(df: DataFrame, why: str) -> Column:
    """The order column, refused when the frame has none."""
    if ROW_ID not in df.columns:
        raise ValueError(f"{why} needs a row order: pass order_by=[...] or read with a row id")
    return F.col(ROW_ID)


def without_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


def head(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows in row order: a bounded top-n per task, no global sort."""
    if ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    return df.limit(n)


def _has_file_position(df: DataFrame) -> bool:
    """Whether ``_rid`` is a place in a file: the fields of a block, then the row."""
    kind = df.schema[ROW_ID].dataType
    return isinstance(kind, T.StructType) and kind.names[0] == "file" and kind.names[-1] == "row"


def _block(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"{ROW_ID}.{name}").alias(name) for name in df.schema[ROW_ID].dataType.names[:-1]])


def with_order_number(df: DataFrame) -> DataFrame:
    """Add ``_order``, one BIGINT that sorts like ``_rid``, so that a hash aggregate can take its minimum.

    A place in a file becomes (number of the block, row).  The blocks are numbered in one short list, a row
    for each part of a file that was read.  Any other key but a whole number gets its place in the sorted table.
    """
    row_id(df, "an order number")
    if isinstance(df.schema[ROW_ID].dataType, T.IntegralType):
        return df.withColumn(ORDER, F.col(ROW_ID).cast("bigint"))
    if not _has_file_position(df):
        return df.join(row_numbers(df).withColumnRenamed(ROW_INDEX, ORDER), ROW_ID)
    blocks = df.select(_block(df).alias("_at")).distinct()
    numbered = blocks.select("_at", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("_number"))
    order = F.shiftleft("_number", ROW_BITS) + F.col(f"{ROW_ID}.row")
    return df.withColumn("_at", _block(df)).join(numbered, "_at").withColumn(ORDER, order).drop("_at", "_number")


def _before(counts: DataFrame) -> DataFrame:
    """Rows in the blocks before each block: a running sum over the short list of blocks."""
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def row_numbers(df: DataFrame) -> DataFrame:
    """(``_rid``, ``row_index``): the dense one-based place of each row in row order.

    Rows are counted per block, the counts are summed up over the blocks, and a row adds its rank within its
    block.  The blocks of a scanned file are those it was read in.  For a key they are ranges of the key: the
    keys alone are sorted by range and written, one file for each range.  No window spans the table.
    """
    row_id(df, "a row index")
    if _has_file_position(df):
        places = df.select(ROW_ID, _block(df).alias("_at"), F.col(f"{ROW_ID}.row").alias("_row"))
        counts = places.groupBy("_at").agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"), F.max("_row").alias("_last"))
        whole = F.col("_last") - F.col("_first") + 1 == F.col("_rows")
        counts = counts.withColumn("_first", F.when(whole, F.col("_first")).otherwise(
            F.raise_error(F.lit("a row index needs the table as it was scanned, without rows taken out")).cast("bigint")))
    else:
        places = staged(df.select(ROW_ID).repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID), "rows")
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
        places = places.select(ROW_ID, part.alias("_at"), F.col("_metadata.row_index").alias("_row"))
        counts = places.groupBy("_at").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    joined = places.join(_before(counts).select("_at", "_before", "_first"), "_at")
    return joined.select(ROW_ID, (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(ROW_INDEX))
