"""Rows as JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.operators import headers


def iso_text(c: Column, separator: str = "T") -> Column:
    """ISO text of a timestamp; the fraction is shown only when there is one."""
    seconds = F.date_format(c, f"yyyy-MM-dd'{separator}'HH:mm:ss")
    return F.when(
        F.date_format(c, "SSSSSS") != "000000",
        F.concat(seconds, F.lit("."), F.date_format(c, "SSSSSS")),
    ).otherwise(seconds)


def json_safe(c: Column, kind: T.DataType) -> Column:
    """Timestamps to ISO text, NaN and infinities out of the way of JSON."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        endless = F.lit(float("inf"))
        return F.when(~F.isnan(c) & (F.abs(c) != endless), c)
    return c


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row in a ``record`` column, NULL fields included."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [
        json_safe(F.col(f"`{c}`"), kinds[c]).alias(c) for c in headers.business_columns(df)
    ]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(record.alias("record"))
