"""Table profile: row count, NULLs, types and Arabic content per column, in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import patterns as P
from tablewash.operators import headers


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows, missing, has_arabic, suggest_ignore."""
    names = headers.business_columns(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    suggested = set(headers.suggest_ignores(names))

    def missing(c: str):
        col = F.col(f"`{c}`")
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            return F.count_if(col.isNull() | F.isnan(col))
        return F.count_if(col.isNull())

    def arabic(c: str):
        if not isinstance(kinds[c], T.StringType):
            return F.lit(False)
        return F.coalesce(F.bool_or(F.col(f"`{c}`").rlike(P.ARABIC_PATTERN)), F.lit(False))

    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[missing(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[arabic(c).alias(f"a{i}") for i, c in enumerate(names)],
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("position"),
                        F.lit(c).alias("column"),
                        F.lit(kinds[c].simpleString()).alias("type"),
                        F.col("n").alias("rows"),
                        F.col(f"m{i}").alias("missing"),
                        F.col(f"a{i}").alias("has_arabic"),
                        F.lit(c in suggested).alias("suggest_ignore"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )
