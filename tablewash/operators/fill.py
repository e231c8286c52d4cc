"""Numeric fill with mean, exact median or zero."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.operators import headers

PERCENTILE_ACCURACY = 10_000


@dataclass
class _Rank:
    """Search for the value of 0-based ``rank``; it lies strictly between low and high."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: object = None
    high: object = None
    value: object = None

    def interior(self) -> Column:
        c = F.col(f"`{self.column}`")
        cond = c.isNotNull()
        if self.low is not None:
            cond &= c > F.lit(self.low)
        if self.high is not None:
            cond &= c < F.lit(self.high)
        return cond

    def value_column(self) -> Column:
        return F.when(self.interior(), F.col(f"`{self.column}`"))

    def narrow(self, a, b, less: int, at_a: int, between: int, at_b: int) -> None:
        at = self.rank - self.below
        if at < less:
            self.high, self.inside = a, less
        elif at < less + at_a:
            self.value = a
        elif at < less + at_a + between:
            self.low, self.high, self.inside = a, b, between
            self.below += less + at_a
        elif at < less + at_a + between + at_b:
            self.value = b
        else:
            self.low = b
            self.below += less + at_a + between + at_b
            self.inside -= less + at_a + between + at_b


def _pinch(df: DataFrame, ranks: Sequence[_Rank], accuracy: int) -> None:
    """Shrink every open range about 2500-fold with one sketch pass and one count pass."""
    def around(r: _Rank) -> Column:
        p = (r.rank - r.below + 0.5) / r.inside
        ends = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
        return F.approx_percentile(r.value_column(), ends, accuracy)

    brackets = df.agg(*[around(r).alias(str(i)) for i, r in enumerate(ranks)]).first()
    aggs = []
    for i, r in enumerate(ranks):
        a, b = brackets[i]
        v = r.value_column()
        aggs += [
            F.count_if(v < F.lit(a)),
            F.count_if(v == F.lit(a)),
            F.count_if((v > F.lit(a)) & (v < F.lit(b))),
            F.count_if((v == F.lit(b)) & F.lit(a != b)),
        ]
    counts = df.agg(*[c.alias(str(i)) for i, c in enumerate(aggs)]).first()
    for i, r in enumerate(ranks):
        r.narrow(*brackets[i], *counts[4 * i : 4 * i + 4])


def exact_medians(
    df: DataFrame,
    counts: dict[str, int],
    direct_rows: int = 0,
    accuracy: int = PERCENTILE_ACCURACY,
) -> dict[str, float]:
    """Exact medians of the columns in ``counts`` (column -> number of non-NULLs).

    No task ever holds or sorts a column: a quantile sketch brackets the middle
    ranks of all columns in one scan, counts in a second one say on which side of
    the bracket's ends each rank lies, and this repeats inside the bracket.  Every
    round settles a rank or takes a value at least off its range, and a sketch of
    few rows is exact, so two or three rounds do for any size.  ``direct_rows``
    is kept for callers that pass it and has no effect.
    """
    del direct_rows
    columns = [c for c, n in counts.items() if n]
    ranks = {
        (c, k): _Rank(c, k, counts[c])
        for c in columns
        for k in {(counts[c] - 1) // 2, counts[c] // 2}
    }
    while still_open := [r for r in ranks.values() if r.value is None]:
        _pinch(df, still_open, accuracy)
    return {
        c: (float(ranks[c, (counts[c] - 1) // 2].value) + float(ranks[c, counts[c] // 2].value)) / 2
        for c in columns
    }


def fill_numeric(
    df: DataFrame, method: str, exclude: Collection[str] = (), counted: Column | None = None
) -> DataFrame:
    """Fill NULLs of numeric columns that have any.

    ``counted`` says which rows take part in the mean or median (all, if not given).

    ``zero`` is a plain projection and keeps the type.  ``mean`` and ``median``
    first run one small aggregate and turn the filled columns to DOUBLE.  NaN
    counts as NULL.
    """
    columns = [c for c in headers.numeric_columns(df) if c not in exclude]
    if not columns:
        return df
    if method == "zero":
        return df.fillna(0, subset=[f"`{c}`" for c in columns])
    value = {
        c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) if kind in ("double", "float") else F.col(f"`{c}`")
        for c, kind in df.dtypes if c in columns
    }
    narrow = (df if counted is None else df.where(counted)).select(*[v.alias(c) for c, v in value.items()])
    stats = narrow.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)],
        *[
            F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") if method == "mean"
            else F.lit(None).cast("double").alias(f"m{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    gaps = {c: stats[f"c{i}"] for i, c in enumerate(columns) if stats[f"c{i}"] < stats["n"]}
    if method == "mean":
        values = {c: stats[f"m{i}"] for i, c in enumerate(columns) if c in gaps}
    elif method == "median":
        values = exact_medians(narrow, gaps)
    else:
        raise ValueError(f"unknown fill method {method!r}")
    filled = {
        c: F.coalesce(value[c].cast("double"), F.lit(v))
        for c, v in values.items() if v is not None
    }
    return df.withColumns(filled) if filled else df
