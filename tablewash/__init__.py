"""Spark-native cleaning, deduplication, enrichment, masking and comparison of tables."""

from tablewash.config import CleaningConfig
from tablewash.operators.detect import detect_columns
from tablewash.operators.diff import Diff, compute_diff
from tablewash.operators.headers import suggest_ignores
from tablewash.operators.lookup import lookup_join
from tablewash.operators.profile import profile
from tablewash.plans.clean import CleanResult, clean
from tablewash.plans.job import JobResult, run_job
from tablewash.sources.files import cleaned_path, read_table, write_table

__all__ = [
    "CleaningConfig", "CleanResult", "Diff", "JobResult", "clean", "cleaned_path", "compute_diff",
    "detect_columns", "lookup_join", "profile", "read_table", "run_job", "suggest_ignores", "write_table",
]
