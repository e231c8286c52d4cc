"""Quality rules: base counts of each text and robust multivariate outliers, in SQL functions only.

The method estimates a minimum covariance determinant for each language and source:
from a start at the medians, concentration steps take the ``COVERAGE`` of rows with the
smallest Mahalanobis distances and estimate mean and covariance anew, each step lowering
the determinant.  A row's transformed statistics are rejected by their distance under
the last estimate, scaled so that the median distance is that of the chi-square law.

Groups of fewer than ``MIN_GROUP`` rows use the estimate of their language, and that of
all rows if the language is as small; below that nothing is rejected.  A floor under each
variance keeps statistics that are constant within a group (no repeated lines, say) from
rejecting a text for a single deviation.

Defined cases: a NULL or blank text has no words and fails the base rules; a NULL
language or source is a group of its own.  Rows that repeat are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, written

SPACE = "[ \\\\x09-\\\\x0D]"
WINDOW = 8
# The transformed statistics and the smallest spread that counts as one standard deviation.
STATISTICS = {
    "log(1D + n_words)": 0.5,
    "log((word_chars + 1D) / (n_words + 1D))": 0.10,
    "sqrt(n_symbols / (n_words + 1D))": 0.12,
    "sqrt(n_dup_lines / (n_lines + 1D))": 0.20,
    "sqrt(n_repeat_words / (n_words + 1D))": 0.20,
}
P = len(STATISTICS)
COVERAGE = 0.75
MIN_GROUP = 100
STEPS = 5
BROADCAST_GROUPS = 50_000
# Chi-square with 5 degrees of freedom: the median, and a distance beyond which 1.4 in 10,000 lie.
MEDIAN = 4.3515
CUTOFF = 25.0


def text_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_words", F.expr(f"filter(split(_text, '{SPACE}+'), w -> w <> '')"))
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.expr(f"CAST(length(regexp_replace(_text, '{SPACE}+', '')) AS bigint)"),
        "n_symbols": F.expr("CAST(length(_text) - length(translate(_text, '#*$%&|<>', '')) AS bigint)"),
        "_lines": F.expr("filter(split(_text, '\\\\n'), x -> x RLIKE '[^ \\\\x09-\\\\x0D]')"),
        "_hashes": F.expr("transform(_words, w -> xxhash64(w))"),
    })
    parts = ", ".join(f"_hashes[i + {j}]" for j in range(WINDOW))
    df = df.withColumn("_windows", F.expr(
        f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({parts})) END"))
    # Only a text with a repeated window pays for the sort.  A window's positions follow each other in
    # ``_sorted``; those with an equal neighbour are put in order, and each covers the words up to the
    # next one or the end of its own window.
    df = df.withColumn("_repeats", F.expr("_windows IS NOT NULL AND size(array_distinct(_windows)) < size(_windows)"))
    df = df.withColumn("_sorted", F.expr(
        "CASE WHEN _repeats THEN sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))) END"))
    df = df.withColumn("_at", F.expr("""CASE WHEN _repeats THEN sort_array(transform(filter(_sorted, (s, j) ->
        (j > 0 AND s.h = _sorted[j - 1].h) OR (j + 1 < size(_sorted) AND s.h = _sorted[j + 1].h)), s -> s.i)) END"""))
    covered = f"""CASE WHEN _repeats THEN aggregate(transform(_at, (p, j) ->
        CAST(if(j + 1 < size(_at), least({WINDOW}, _at[j + 1] - p), {WINDOW}) AS bigint)), 0L, (a, b) -> a + b) ELSE 0L END"""
    df = df.withColumns({
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS bigint)"),
        "n_repeat_words": F.expr(covered),
    })
    return df.drop("_text", "_words", "_lines", "_hashes", "_windows", "_repeats", "_sorted", "_at")


def _distance() -> list[Column]:
    """Squared Mahalanobis distance by a Cholesky factor ``l_i_j`` and a centre ``m_i`` on the same row."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        y.append(rest / F.col(f"l_{i}_{i}"))
    return y


def with_distance(rows: DataFrame) -> DataFrame:
    for i, value in enumerate(_distance()):
        rows = rows.withColumn(f"y_{i}", value)
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, P)), F.col("y_0") * F.col("y_0"))
    return rows.withColumn("d2", total).drop(*[f"y_{i}" for i in range(P)])


def with_factor(moments: DataFrame) -> DataFrame:
    """The Cholesky factor of the covariance ``c_i_j`` (lower half), one row per group."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.drop(*[f"c_{i}_{j}" for i in range(P) for j in range(i + 1)])


def first_estimate(rows: DataFrame) -> DataFrame:
    """Medians and normalised median deviations from quartiles, as a diagonal covariance."""
    quartiles = rows.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.percentile_approx(f"x_{i}", [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i in range(P)])
    out = quartiles.where(F.col("n") >= MIN_GROUP)
    for i, floor in enumerate(STATISTICS.values()):
        spread = (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349
        out = out.withColumn(f"m_{i}", F.col(f"q_{i}")[1])
        for j in range(i):
            out = out.withColumn(f"c_{i}_{j}", F.lit(0.0))
        out = out.withColumn(f"c_{i}_{i}", F.greatest(spread * spread, F.lit(floor * floor)))
    return with_factor(out.drop(*[f"q_{i}" for i in range(P)]))


def by_group(rows: DataFrame, values: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with their group's values; up to so many groups the values are sent to the rows, so a hot group is not moved."""
    return rows.join(F.broadcast(values) if n_groups <= BROADCAST_GROUPS else values, "grp")


def concentrate(rows: DataFrame, estimate: DataFrame, n_groups: int) -> DataFrame:
    """One step: mean and covariance of the rows with the smallest distances."""
    placed = with_distance(by_group(rows, estimate, n_groups)).select("grp", "d2", *[f"x_{i}" for i in range(P)])
    bound = placed.groupBy("grp").agg(F.percentile_approx("d2", COVERAGE, 1000).alias("bound"))
    near = by_group(placed, bound, n_groups).where("d2 <= bound")
    moments = near.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.avg(f"x_{i}").alias(f"m_{i}") for i in range(P)],
        *[F.covar_pop(f"x_{i}", f"x_{j}").alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)])
    for i, floor in enumerate(STATISTICS.values()):
        moments = moments.withColumn(f"c_{i}_{i}", F.col(f"c_{i}_{i}") + F.lit(floor * floor))
    return with_factor(moments)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The last estimate of each group ``grp`` of ``rows`` (x_0, ...) with its ``scale``."""
    estimate = written(first_estimate(rows), "estimate")
    n_groups = estimate.count()
    for _ in range(STEPS):
        after = written(concentrate(rows, estimate, n_groups), "estimate")
        forget(estimate)
        estimate = after
    placed = with_distance(by_group(rows, estimate, n_groups))
    scale = placed.groupBy("grp").agg((F.percentile_approx("d2", 0.5, 1000) / MEDIAN).alias("scale"))
    # Floors make small groups look tighter than the law: distances are never blown up, only shrunk.
    return estimate.join(scale.select("grp", F.greatest("scale", F.lit(1.0)).alias("scale")), "grp")


def quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    lang_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """Per row: id, n_words, base counts, base_failed, kept, and the distance that decided."""
    picked = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"),
        F.coalesce(F.concat(F.lit("l:"), F.col(lang_column).cast("string")), F.lit("none")).alias("lang"),
        F.coalesce(F.concat(F.lit("s:"), F.col(source_column).cast("string")), F.lit("none")).alias("source"))
    counts = text_counts(picked).drop("text")
    counts = counts.withColumns({f"x_{i}": F.expr(e).cast("double") for i, e in enumerate(STATISTICS)})
    counts = counts.withColumns({
        "base_failed": F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"),
        "levels": F.array(F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("all")),
    })
    counts = written(counts, "counts")
    rows = counts.where("n_words > 0").select(F.explode("levels").alias("grp"), *[f"x_{i}" for i in range(P)])
    estimates = written(robust_estimates(rows).drop("n"), "estimates")
    # Each group of rows takes its finest level that has an estimate.
    have = estimates.select("grp")
    chosen = counts.select("levels").distinct().select("levels", F.posexplode("levels").alias("depth", "grp"))
    chosen = chosen.join(have, "grp").groupBy("levels").agg(F.min_by("grp", "depth").alias("grp"))
    chosen = chosen.join(estimates, "grp")
    judged = with_distance(counts.join(chosen, "levels", "left"))
    distance = F.coalesce(F.col("d2") / F.col("scale"), F.lit(0.0))
    return judged.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (distance <= CUTOFF)).alias("kept"), F.round(distance, 6).alias("distance"))
