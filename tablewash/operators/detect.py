"""Content detectors: which columns hold dates or amounts.

With ``sample="all"`` every value of every column is judged, by one aggregate
over all columns in one scan.  With ``sample="head15"`` a column is judged by its
first fifteen non-NULL values in row order.  Most columns fill that sample from
the first few rows of the table, which are found with a scan of the order column
alone and then read through a pushed-down bound on it; only sparse columns need
a scan of their own.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import patterns as P
from tablewash.functions.dates import parse_date_mixed
from tablewash.functions.text import as_text
from tablewash.operators import headers
from tablewash.operators.headers import ROW_ID

HEAD_BLOCK = 256
SAMPLES = ("head15", "all")
SHARE_TENTHS = round(10 * P.SAMPLE_SHARE)


def _first_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, value) of the first ``n`` non-NULL values: one TakeOrdered per column."""
    col = F.col(f"`{column}`")
    rows = df.where(col.isNotNull())
    if ROW_ID in df.columns:
        rows = rows.select(ROW_ID, f"`{column}`").orderBy(ROW_ID)
    rows = rows.limit(n)
    value = as_text(col, df.schema[column].dataType)
    return rows.select(F.lit(column).alias("column"), value.alias("value"))


def _head_values(df: DataFrame, columns: Sequence[str], n: int) -> tuple[DataFrame, set[str]] | None:
    """Samples taken from the first rows, and the columns whose sample is full there."""
    bound = df.select(ROW_ID).orderBy(ROW_ID).limit(HEAD_BLOCK).agg(F.max(ROW_ID)).first()[0]
    if bound is None:
        return None
    types = {f.name: f.dataType for f in df.schema.fields}
    bound_col = (
        F.struct(*[F.lit(v).alias(k) for k, v in bound.asDict().items()])
        if isinstance(types[ROW_ID], T.StructType)
        else F.lit(bound)
    )
    block = df.where(F.col(ROW_ID) <= bound_col).select(
        ROW_ID, *[as_text(F.col(f"`{c}`"), types[c]).alias(c) for c in columns]
    )
    samples = block.agg(
        *[
            F.slice(
                F.array_sort(
                    F.collect_list(
                        F.when(
                            F.col(f"`{c}`").isNotNull(),
                            F.struct(F.col(ROW_ID).alias("r"), F.col(f"`{c}`").alias("v")),
                        )
                    )
                ),
                1,
                n,
            ).alias(c)
            for c in columns
        ]
    )
    full = samples.select(
        *[(F.size(F.col(f"`{c}`")) >= n).alias(c) for c in columns]
    ).first().asDict()
    long = samples.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.transform(F.col(f"`{c}`"), lambda s: s["v"]).alias("values"),
                    )
                    for c in columns
                ]
            )
        ).alias("s")
    ).select("s.column", F.explode("s.values").alias("value"))
    return long, {c for c, done in full.items() if done}


def column_samples(
    df: DataFrame, columns: Sequence[str], n: int = P.SAMPLE_SIZE
) -> DataFrame | None:
    """(column, value): the first ``n`` non-NULL values of each column, as text."""
    if not columns:
        return None
    parts, done = [], set()
    if ROW_ID in df.columns:
        found = _head_values(df, columns, n)
        if found is None:
            return None
        long, done = found
        if done:
            parts.append(long.where(F.col("column").isin(*done)))
    parts += [_first_values(df, c, n) for c in columns if c not in done]
    return reduce(DataFrame.unionAll, parts)


def looks_like_date(value: Column) -> Column:
    return value.rlike(P.DATE_LIKE_PATTERN)


def looks_like_money(value: Column) -> Column:
    return value.rlike(P.MONEY_MARK_PATTERN) & F.lower(value).rlike(P.MONEY_LIKE_PATTERN)


def _hits(value: Column) -> dict[str, Column]:
    """How many values there are and how many each detector accepts."""
    return {
        "sampled": F.count(value),
        "date_hits": F.count_if(looks_like_date(value)),
        "money_hits": F.count_if(looks_like_money(value)),
    }


def _whole_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hits over all values: one row of conditional aggregates, turned into a row per column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found = {c: _hits(as_text(F.col(f"`{c}`"), types[c])) for c in columns}
    wide = df.agg(*[hit.alias(f"{name}{i}") for i, c in enumerate(columns) for name, hit in found[c].items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in found[c]])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows))).where("sampled > 0")


def detect_columns(
    df: DataFrame, columns: Sequence[str] | None = None, sample: str = "head15"
) -> DataFrame | None:
    """Per column with a value: values judged, hits of the two detectors, and their verdicts.

    ``sample`` is ``"all"`` for whole columns or ``"head15"`` for their first values.
    """
    columns = headers.business_columns(df) if columns is None else list(columns)
    if sample not in SAMPLES:
        raise ValueError(f"unknown sample {sample!r}: use one of {SAMPLES}")
    if sample == "all":
        counts = _whole_columns(df, columns) if columns else None
    else:
        samples = column_samples(df, columns)
        counts = None if samples is None else samples.groupBy("column").agg(
            *[hit.alias(name) for name, hit in _hits(F.col("value")).items()]
        )
    if counts is None:
        return None
    # A share of three tenths, in whole numbers.
    return counts.select("*", *[
        (10 * F.col(f"{kind}_hits") >= SHARE_TENTHS * F.col("sampled")).alias(f"{kind}_like") for kind in ("date", "money")
    ])


def find_date_columns(
    df: DataFrame, exclude: Collection[str] = (), reference_year: int = 2026, sample: str = "head15"
) -> list[str]:
    """Columns the date step converts: date-like samples and at least one readable value."""
    names = [c for c in headers.business_columns(df) if c not in exclude]
    verdicts = detect_columns(df, names, sample)
    if verdicts is None:
        return []
    likely = {r["column"] for r in verdicts.where("date_like").select("column").collect()}
    texts = [c for c in names if c in likely and isinstance(df.schema[c].dataType, T.StringType)]
    readable = {c for c in likely if c not in texts}
    if texts:
        # One early-ending probe per candidate: the first readable value decides.
        probes = [
            df.where(parse_date_mixed(F.col(f"`{c}`"), reference_year).isNotNull())
            .limit(1)
            .select(F.lit(c).alias("column"))
            for c in texts
        ]
        readable |= {r["column"] for r in reduce(DataFrame.unionAll, probes).collect()}
    return [c for c in names if c in readable and not _is_plain_number(df, c)]


def _is_plain_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def find_money_columns(
    df: DataFrame, exclude: Collection[str] = (), sample: str = "head15"
) -> list[str]:
    """String columns, not vetoed by name, whose samples look like amounts."""
    names = [
        c for c in headers.string_columns(df) if c not in exclude and headers.is_money_name(c)
    ]
    verdicts = detect_columns(df, names, sample)
    if verdicts is None:
        return []
    found = {r["column"] for r in verdicts.where("money_like").select("column").collect()}
    return [c for c in names if c in found]
