"""A cleaning job that writes once and reports from what it wrote.

Every input row becomes one written row: its id, its status, its raw and its cleaned
values and the cells that changed.  Rows that go are marked, not filtered out, so the
cleaned table, the log and all parts of the diff are scans of that one table; nothing
is joined or computed again.  The merge join runs once: its rows are staged before the
steps that need a pass of their own (detectors, mean and median, duplicates) read them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.config import CleaningConfig
from tablewash.functions import patterns as P
from tablewash.operators import headers, values
from tablewash.operators.checkpoints import ensure_checkpoint_dir, staged
from tablewash.operators.dedupe import first_ids
from tablewash.operators.diff import CHANGES_TYPE, Diff, changed_cells
from tablewash.operators.export import to_records
from tablewash.operators.fill import fill_numeric
from tablewash.operators.fuzzy_dedupe import kept_ids
from tablewash.operators.headers import JOB_MATCHED, JOB_RAW, JOB_STATUS, ROW_ID
from tablewash.operators.lookup import MATCHED, lookup_join
from tablewash.operators.ordering import head, row_id, row_numbers, with_row_id
from tablewash.plans.clean import Filtered, duplicates_action, excluded, is_empty, run_steps
from tablewash.sources.files import write_table

# Columns of the written table; raw and cleaned values are structs, so no names clash.
ID, STATUS, MERGED, RAW, CLEANED, CHANGES = "row_id", "status", "matched", "raw", "cleaned", "changes"
EMPTY = "dropped_empty"


def alive() -> Column:
    """Whether a row has not been marked."""
    return F.col(JOB_STATUS).isNull()


class Marked(Filtered):
    """Rows that go keep their place and get a status: what was done to them."""

    def __init__(self) -> None:
        self.known: list[tuple[int, str, int]] = []
        self.counted: list[tuple[int, str]] = []

    def note(self, frame: DataFrame, step: int, action: str, n: int) -> None:
        self.known.append((step, action, n))

    def drop_empty(self, frame: DataFrame) -> DataFrame:
        self.counted.append((3, EMPTY))
        return frame.withColumn(JOB_STATUS, F.when(is_empty(frame), F.lit(EMPTY)))

    def fill(self, frame: DataFrame, method: str, exclude: set[str]) -> DataFrame:
        return fill_numeric(frame, method, exclude, alive())

    def keep_first(self, frame: DataFrame, column: str | None, fuzzy: bool) -> DataFrame:
        action = duplicates_action(column, fuzzy)
        self.counted.append((6, action))
        left = frame.where(alive())
        if column is not None and fuzzy:
            ids = kept_ids(left, column)
        else:
            ids = first_ids(left, headers.business_columns(frame) if column is None else [column])
        stays = ids.select(F.col(ROW_ID).alias("_first"), F.lit(True).alias("_stays"))
        joined = frame.join(stays, F.col(ROW_ID) == F.col("_first"), "left")
        status = F.when(alive() & F.col("_stays").isNull(), F.lit(action)).otherwise(F.col(JOB_STATUS))
        return joined.withColumn(JOB_STATUS, status).drop("_first", "_stays")


@dataclass(frozen=True)
class WrittenDiff(Diff):
    """The diff of a written job: every part scans the written table."""

    job: DataFrame

    def removed(self, k: int | None = P.REMOVED_PREVIEW_ROWS) -> DataFrame:
        gone = self.job.where(F.col(STATUS).isNotNull()).select(F.col(ID).alias(ROW_ID), f"{RAW}.*")
        return gone if k is None else gone.orderBy(ROW_ID).limit(k)


@dataclass(frozen=True)
class JobResult:
    """What a job wrote, and the reports read from it."""

    path: str
    written: DataFrame
    known: tuple[tuple[int, str, int], ...]
    counted: tuple[tuple[int, str], ...]
    merged: bool

    @property
    def df(self) -> DataFrame:
        """The cleaned table."""
        return self.written.where(F.col(STATUS).isNull()).select(f"{CLEANED}.*")

    def write(self, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
        """The cleaned table as a CSV or parquet file."""
        write_table(self.df, path, fmt, mode)

    def log(self) -> DataFrame:
        """(step, action, n) in step order, from one aggregate over the written rows."""
        entries = [(0, "merged", F.count_if(MERGED))] if self.merged else []
        entries += [(step, action, F.lit(n).cast("bigint")) for step, action, n in self.known]
        entries += [(step, action, F.count_if(F.col(STATUS) == action)) for step, action in self.counted]
        if not entries:
            return self.written.sparkSession.createDataFrame([], "step int, action string, n bigint")
        wide = self.written.agg(F.count(F.lit(1)), *[n.alias(f"n{i}") for i, (_, _, n) in enumerate(entries)])
        rows = [
            F.struct(F.lit(step).alias("step"), F.lit(action).alias("action"), F.col(f"n{i}").alias("n"))
            for i, (step, action, _) in enumerate(entries)
        ]
        long = wide.select(F.inline(F.array(*rows)))
        return long.where((F.col("n") > 0) | (F.col("action") == "merged")).orderBy("step")

    def diff(self) -> WrittenDiff:
        ids = F.col(ID).alias(ROW_ID)
        raw = self.written.select(f"{RAW}.*", ids)
        clean = self.written.where(F.col(STATUS).isNull()).select(f"{CLEANED}.*", ids)
        rows = self.written.select(ids, F.lit(True).alias("in_raw"), F.col(STATUS).isNull().alias("in_clean"), CHANGES)
        return WrittenDiff(raw, clean, rows, self.written)

    def row_numbers(self) -> DataFrame:
        """(``_rid``, ``row_index``) of all input rows."""
        return row_numbers(self.written.select(F.col(ID).alias(ROW_ID)))

    def head_records(self, n: int = P.HEAD_ROWS) -> DataFrame:
        return to_records(head(self.diff().clean, n))


def new_path(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/job-{uuid.uuid4().hex}"


def run_job(
    df: DataFrame,
    config: CleaningConfig,
    lookup: DataFrame | None = None,
    order_by: str | Sequence[str] | None = None,
    lookup_order_by: str | Sequence[str] | None = None,
    path: str | None = None,
) -> JobResult:
    """Run the configured steps and write the result once, to ``path`` or to the shared work folder.

    The arguments are those of ``clean``, which gives the same table, log and diff without writing.
    """
    raw = values.nan_to_null(with_row_id(df, order_by))
    row_id(raw, "a job")
    reserved = sorted({JOB_RAW, JOB_STATUS, JOB_MATCHED, "_first", "_stays"} & {c.lower() for c in raw.columns})
    if reserved:
        raise ValueError(f"the columns {reserved} have names that a job uses")
    before = [f for f in raw.schema.fields if f.name != ROW_ID]
    frame, added, merged = raw, [], config.merge_active and lookup is not None
    matched = F.lit(None).cast("boolean")
    if merged:
        result = lookup_join(
            raw, with_row_id(lookup, lookup_order_by),
            config.merge_key_main, config.merge_key_sec, config.merge_fuzzy,
        )
        frame, added, matched = staged(result.df, "merged"), result.added, F.col(MATCHED)
    frame = frame.withColumns({
        JOB_RAW: F.struct(*[F.col(f"`{f.name}`") for f in before]),
        JOB_STATUS: F.lit(None).cast("string"),
        JOB_MATCHED: matched,
    }).drop(MATCHED)

    rows = Marked()
    frame = run_steps(frame, config, excluded(frame, config, added), rows)
    after = [frame.schema[c] for c in headers.business_columns(frame)]
    changes = changed_cells(
        [(F.col(JOB_RAW).getField(f.name), f) for f in before], [(F.col(f"`{f.name}`"), f) for f in after]
    )
    out = frame.select(
        F.col(ROW_ID).alias(ID), F.col(JOB_STATUS).alias(STATUS), F.col(JOB_MATCHED).alias(MERGED),
        F.col(JOB_RAW).alias(RAW), F.struct(*[F.col(f"`{f.name}`") for f in after]).alias(CLEANED),
        F.when(alive(), changes).otherwise(F.array().cast(CHANGES_TYPE)).alias(CHANGES),
    )
    path = path or new_path(df.sparkSession)
    out.write.parquet(path)
    written = df.sparkSession.read.schema(out.schema).parquet(path)
    return JobResult(path, written, tuple(rows.known), tuple(rows.counted), merged)
