"""Readers and writers by format."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.text import plain_number
from tablewash.operators.export import iso_text
from tablewash.operators.headers import ROW_ID
from tablewash.operators.ordering import without_row_id
from tablewash.operators.values import nan_to_null
from tablewash.sources.csv import read_csv


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with ``_rid`` = (file, row number in the file)."""
    df = spark.read.parquet(path)
    rid = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return nan_to_null(df.select("*", rid.alias(ROW_ID)))


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by ``fmt`` or file extension; the result carries the file order as ``_rid``."""
    fmt = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt in ("xlsx", "xls"):
        raise ValueError("spreadsheets are not read directly: save the sheet as CSV or parquet")
    raise ValueError(f"unsupported file format {fmt!r}: use csv or parquet")


def cleaned_path(path: str) -> str:
    """``dir/sales.csv`` -> ``dir/sales_cleaned.csv``."""
    base, ext = os.path.splitext(path.rstrip("/"))
    return f"{base}_cleaned{ext}"


def csv_ready(df: DataFrame) -> DataFrame:
    """Columns as a CSV file shows them: plain numbers, True/False, dates without 00:00:00.

    A timestamp column is written as dates when every time in it is midnight,
    which takes one aggregate over the timestamp columns.
    """
    df = without_row_id(df)
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    dates_only = set()
    if stamps:
        midnight = df.agg(*[
            F.coalesce(
                F.bool_and(F.date_trunc("day", F.col(f"`{c}`")) == F.col(f"`{c}`")), F.lit(True)
            ).alias(c)
            for c in stamps
        ]).first()
        dates_only = {c for c in stamps if midnight[c]}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in dates_only:
            c = c.cast("date")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = iso_text(c, " ")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = plain_number(c, f.dataType, keep_fraction_zero=True)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV folder with a header, NULL as an empty field; parts are written in parallel."""
    (
        csv_ready(df)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    without_row_id(df).write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    fmt = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    writers = {"csv": write_csv, "parquet": write_parquet}
    if fmt not in writers:
        raise ValueError(f"unsupported file format {fmt!r}: use csv or parquet")
    writers[fmt](df, path, mode)
