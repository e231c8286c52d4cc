"""Before/after comparison of a raw and a cleaned table, aligned by row id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import patterns as P
from tablewash.functions.text import comparable, plain_number
from tablewash.operators import headers
from tablewash.operators.headers import ROW_ID
from tablewash.operators.ordering import row_id, row_numbers

CHANGES_TYPE = "array<struct<col:string,before:string,after:string>>"


def shown(c: Column, kind: T.DataType) -> Column:
    """Text of a cell as a report shows it."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), plain_number(c, kind, keep_fraction_zero=True))
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def differs(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """Whether two cells differ; NULL, NaN and empty text are one value.

    Two numbers, or two times, are compared as such; anything else as stripped text.
    """
    numeric = isinstance(a_kind, T.NumericType) and isinstance(b_kind, T.NumericType)
    times = (T.TimestampNTZType, T.TimestampType, T.DateType)
    if numeric:
        def value(c: Column, kind: T.DataType) -> Column:
            floating = isinstance(kind, (T.DoubleType, T.FloatType))
            return F.when(~F.isnan(c), c) if floating else c
        return ~value(a, a_kind).eqNullSafe(value(b, b_kind))
    if isinstance(a_kind, times) and type(a_kind) is type(b_kind):
        return ~a.eqNullSafe(b)
    return ~comparable(shown(a, a_kind)).eqNullSafe(comparable(shown(b, b_kind)))


@dataclass(frozen=True)
class Diff:
    """Lazy parts of a comparison; each is a DataFrame.

    ``rows`` has one row per row id of either table: ``_rid``, ``in_raw``,
    ``in_clean`` and ``changes``, an array of ``(col, before, after)``.
    """

    raw: DataFrame
    clean: DataFrame
    rows: DataFrame

    def stats(self) -> DataFrame:
        return self.rows.agg(
            F.count_if("in_raw").alias("total_original"),
            F.count_if("in_clean").alias("total_cleaned"),
            F.count_if(F.col("in_raw") & ~F.col("in_clean")).alias("removed_count"),
            F.count_if(F.size("changes") > 0).alias("changed_count"),
        )

    def cells(self) -> DataFrame:
        """Long form: one row per changed cell."""
        return self.rows.select(ROW_ID, F.inline("changes"))

    def changed(self, k: int = P.DEFAULT_CHANGED_ROWS) -> DataFrame:
        """First ``k`` changed rows in row order."""
        return (
            self.rows.where(F.size("changes") > 0).select(ROW_ID, "changes").orderBy(ROW_ID).limit(k)
        )

    def removed(self, k: int | None = P.REMOVED_PREVIEW_ROWS) -> DataFrame:
        """First ``k`` removed raw rows in row order (all of them for ``None``)."""
        gone = self.raw.join(self.clean.select(ROW_ID), ROW_ID, "left_anti")
        gone = gone.select(ROW_ID, *[F.col(f"`{c}`") for c in headers.business_columns(self.raw)])
        return gone if k is None else gone.orderBy(ROW_ID).limit(k)

    def truncated(self, k: int = P.DEFAULT_CHANGED_ROWS) -> DataFrame:
        """One row: whether ``changed(k)`` leaves changed rows out."""
        return self.stats().select((F.col("changed_count") > k).alias("truncated"))


def changed_cells(before: list[tuple[Column, T.StructField]], after: list[tuple[Column, T.StructField]]) -> Column:
    """Changed cells of a row, compared by position up to the shorter width and named after the cleaned side."""
    cells = [
        F.when(
            differs(a, a_field.dataType, b, b_field.dataType),
            F.struct(
                F.lit(b_field.name).alias("col"),
                shown(a, a_field.dataType).alias("before"),
                shown(b, b_field.dataType).alias("after"),
            ),
        )
        for (a, a_field), (b, b_field) in zip(before, after)
    ]
    return (F.array_compact(F.array(*cells)) if cells else F.array()).cast(CHANGES_TYPE)


def compute_diff(raw: DataFrame, clean: DataFrame) -> Diff:
    """Compare by row id and, within a row, by column position up to the shorter width.

    Columns are named after the cleaned table.  One join on the unique row id
    yields removed, kept and changed rows together.
    """
    row_id(raw, "a diff"), row_id(clean, "a diff")
    before = [f for f in raw.schema.fields if f.name != ROW_ID]
    after = [f for f in clean.schema.fields if f.name != ROW_ID]
    pairs = list(zip(before, after))
    left = raw.select(
        ROW_ID, F.lit(True).alias("in_raw"),
        *[F.col(f"`{a.name}`").alias(f"a{i}") for i, (a, _) in enumerate(pairs)],
    )
    right = clean.select(
        ROW_ID, F.lit(True).alias("in_clean"),
        *[F.col(f"`{b.name}`").alias(f"b{i}") for i, (_, b) in enumerate(pairs)],
    )
    both = F.col("in_raw").isNotNull() & F.col("in_clean").isNotNull()
    changes = changed_cells(
        [(F.col(f"a{i}"), a) for i, (a, _) in enumerate(pairs)], [(F.col(f"b{i}"), b) for i, (_, b) in enumerate(pairs)]
    )
    rows = left.join(right, ROW_ID, "full_outer").select(
        ROW_ID,
        F.coalesce("in_raw", F.lit(False)).alias("in_raw"),
        F.coalesce("in_clean", F.lit(False)).alias("in_clean"),
        F.when(both, changes).otherwise(F.array()).cast(CHANGES_TYPE).alias("changes"),
    )
    return Diff(raw, clean, rows)


def number_rows(preview: DataFrame, raw: DataFrame) -> DataFrame:
    """Add the dense one-based ``row_index`` in ``raw`` to a preview."""
    return preview.join(row_numbers(raw), ROW_ID, "left")
