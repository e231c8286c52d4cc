"""The cleaning job: all steps in their fixed order, with log and diff.

merge -> sanitise -> headers -> drop empty -> dates -> money -> e-mails ->
phones -> noise -> Arabic -> fill -> dedupe -> mask
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.config import CleaningConfig
from tablewash.functions import patterns as P
from tablewash.functions.text import header_case
from tablewash.operators import detect, headers, values
from tablewash.operators.dedupe import dedupe_column, dedupe_rows
from tablewash.operators.diff import Diff, compute_diff
from tablewash.operators.export import to_records
from tablewash.operators.fill import fill_numeric
from tablewash.operators.fuzzy_dedupe import dedupe_fuzzy
from tablewash.operators.lookup import lookup_join, match_count, strip_matched
from tablewash.operators.ordering import head, with_row_id, without_row_id


@dataclass(frozen=True)
class CleanResult:
    """Lazy result of a cleaning job; ``df``, ``log()`` and every diff part are DataFrames."""

    raw: DataFrame
    cleaned: DataFrame
    log_parts: tuple[DataFrame, ...]

    @property
    def df(self) -> DataFrame:
        """The cleaned table without the hidden row id."""
        return without_row_id(self.cleaned)

    def log(self) -> DataFrame:
        """(step, action, n) in step order.

        Counts are aggregates over the plan, so a task run twice after the loss
        of an executor is not counted twice.
        """
        spark = self.cleaned.sparkSession
        empty = spark.createDataFrame([], "step int, action string, n bigint")
        parts = reduce(DataFrame.unionByName, self.log_parts, empty)
        return parts.where((F.col("n") > 0) | (F.col("action") == "merged")).orderBy("step")

    def diff(self) -> Diff:
        return compute_diff(self.raw, self.cleaned)

    def head_records(self, n: int = P.HEAD_ROWS) -> DataFrame:
        return to_records(head(self.cleaned, n))

    def preview(self) -> dict[str, DataFrame]:
        """The small reports of a dry run."""
        diff = self.diff()
        return {
            "log": self.log(),
            "stats": diff.stats(),
            "changed_rows": diff.changed(P.PREVIEW_CHANGED_ROWS),
            "removed_rows": diff.removed(P.REMOVED_PREVIEW_ROWS),
            "truncated": diff.truncated(P.PREVIEW_CHANGED_ROWS),
            "head": self.head_records(),
        }


def _known(df: DataFrame, step: int, action: str, n: int) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(step).alias("step"), F.lit(action).alias("action"), F.lit(n).cast("bigint").alias("n")
    )


def _counted(rows: DataFrame, step: int, action: str, column: str) -> DataFrame:
    return rows.select(
        F.lit(step).alias("step"), F.lit(action).alias("action"), F.col(column).alias("n")
    )


def _dropped(before: DataFrame, after: DataFrame, step: int, action: str) -> DataFrame:
    """Rows lost between two frames, as the difference of two counts."""
    counts = before.agg(F.count(F.lit(1)).alias("n")).unionAll(
        after.agg((-F.count(F.lit(1))).alias("n"))
    )
    return _counted(counts.agg(F.sum("n").alias("n")), step, action, "n")


class Filtered:
    """Rows that go are filtered out; counts are aggregates over the plan, run when the log is read."""

    def __init__(self) -> None:
        self.log: list[DataFrame] = []

    def note(self, frame: DataFrame, step: int, action: str, n: int) -> None:
        self.log.append(_known(frame, step, action, n))

    def drop_empty(self, frame: DataFrame) -> DataFrame:
        self.log.append(_counted(frame.agg(F.count_if(is_empty(frame)).alias("n")), 3, "dropped_empty", "n"))
        return values.drop_empty_rows(frame)

    def fill(self, frame: DataFrame, method: str, exclude: set[str]) -> DataFrame:
        return fill_numeric(frame, method, exclude)

    def keep_first(self, frame: DataFrame, column: str | None, fuzzy: bool) -> DataFrame:
        if column is None:
            after = dedupe_rows(frame)
        else:
            after = dedupe_fuzzy(frame, column) if fuzzy else dedupe_column(frame, column)
        self.log.append(_dropped(frame, after, 6, duplicates_action(column, fuzzy)))
        return after


def is_empty(frame: DataFrame) -> Column:
    """Whether all business columns of a row are NULL."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in headers.business_columns(frame)], F.lit(True))


def duplicates_action(column: str | None, fuzzy: bool) -> str:
    return "fuzzy_duplicates" if fuzzy and column is not None else "duplicates"


def excluded(frame: DataFrame, config: CleaningConfig, added: Sequence[str]) -> set[str]:
    """Columns that the steps leave alone: ignored ones, and merged ones that are to stay raw."""
    ignored = list(config.ignore_columns) + ([] if config.clean_merged_columns else list(added))
    return headers.excluded_columns(headers.business_columns(frame), ignored, config.standardize_columns)


def run_steps(frame: DataFrame, config: CleaningConfig, exclude: set[str], rows: Filtered) -> DataFrame:
    """All steps after the merge; ``rows`` says what becomes of rows that go, and keeps the log."""
    frame = values.sanitize(frame, exclude)

    if config.standardize_columns:
        renamed = headers.standardized_names(frame.columns)
        if any(old != new for old, new in renamed.items()):
            frame = frame.toDF(*renamed.values())
            exclude = {renamed[c] for c in exclude}
            rows.note(frame, 2, "renamed", 1)

    if config.drop_empty_rows:
        frame = rows.drop_empty(frame)

    if config.fix_dates:
        dates = detect.find_date_columns(frame, exclude, config.reference_year, config.detect_sample)
        frame = values.fix_dates(frame, dates, config.reference_year)
        rows.note(frame, 4, "dates", len(dates))

    if config.clean_money:
        amounts = detect.find_money_columns(frame, exclude, config.detect_sample)
        frame = values.clean_money(frame, amounts)
        rows.note(frame, 5, "money", len(amounts))

    if config.fix_emails:
        frame = values.fix_emails(frame, exclude)
    if config.fix_phones:
        frame = values.fix_phones(frame, exclude)
    if config.remove_special_chars:
        frame = values.remove_noise(frame, exclude)
    if config.clean_arabic:
        frame = values.clean_arabic(frame, exclude)
    if config.fill_missing.get("numeric"):
        frame = rows.fill(frame, config.fill_missing["numeric"], exclude)

    if config.remove_duplicates:
        column = config.dedupe_column
        if column != "ALL" and config.standardize_columns:
            column = header_case(column)
        if column == "ALL":
            frame = rows.keep_first(frame, None, False)
        elif column in headers.business_columns(frame):
            frame = rows.keep_first(frame, column, config.fuzzy_dedupe)
        else:
            rows.note(frame, 6, "duplicates", 0)

    if config.anonymize_pii:
        masked = values.masked_columns(frame, exclude, config.strict_mask)
        frame = values.mask_pii(frame, exclude, config.strict_mask)
        rows.note(frame, 7, "masked", len(masked))
    return frame


def clean(
    df: DataFrame,
    config: CleaningConfig,
    lookup: DataFrame | None = None,
    order_by: str | Sequence[str] | None = None,
    lookup_order_by: str | Sequence[str] | None = None,
) -> CleanResult:
    """Run the configured steps; see ``CleaningConfig``.

    ``order_by`` is a unique key that defines the row order; tables read by
    ``read_table`` bring their own.  Detectors, mean and median fill and fuzzy
    matching run small jobs while the plan is built; the rest is lazy.  For a
    job that writes its result and reports from it see ``run_job``.
    """
    raw = values.nan_to_null(with_row_id(df, order_by))
    frame, rows, added = raw, Filtered(), []

    if config.merge_active and lookup is not None:
        result = lookup_join(
            frame, with_row_id(lookup, lookup_order_by),
            config.merge_key_main, config.merge_key_sec, config.merge_fuzzy,
        )
        rows.log.append(_counted(match_count(result.df), 0, "merged", "matched"))
        frame, added = strip_matched(result.df), result.added

    frame = run_steps(frame, config, excluded(frame, config, added), rows)
    return CleanResult(raw, frame, tuple(rows.log))
