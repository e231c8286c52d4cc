"""Row-wise cleaning of a streaming DataFrame.

Steps that look at one row at a time need no state and run unchanged on a
stream.  Which columns hold dates and amounts is decided once, on a batch table
of the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewash.config import CleaningConfig
from tablewash.operators import detect, headers, values
from tablewash.operators.fill import fill_numeric


def clean_stream(stream: DataFrame, config: CleaningConfig, like: DataFrame) -> DataFrame:
    """Apply the row-wise steps of ``config``; ``like`` is a batch table to judge columns by."""
    if config.remove_duplicates or config.merge_active or config.fill_missing.get("numeric", "zero") != "zero":
        raise ValueError("a stream takes only the steps that look at one row at a time")
    exclude = headers.excluded_columns(stream.columns, config.ignore_columns, config.standardize_columns)

    def start(df: DataFrame) -> DataFrame:
        df = values.sanitize(df, exclude)
        return headers.standardize_headers(df) if config.standardize_columns else df

    names = headers.standardized_names(stream.columns)
    hidden = {names[c] for c in exclude} if config.standardize_columns else exclude
    sample, frame = start(like), start(stream)
    if config.drop_empty_rows:
        sample, frame = values.drop_empty_rows(sample), values.drop_empty_rows(frame)
    if config.fix_dates:
        dates = detect.find_date_columns(sample, hidden, config.reference_year)
        sample = values.fix_dates(sample, dates, config.reference_year)
        frame = values.fix_dates(frame, dates, config.reference_year)
    if config.clean_money:
        frame = values.clean_money(frame, detect.find_money_columns(sample, hidden))
    if config.fix_emails:
        frame = values.fix_emails(frame, hidden)
    if config.fix_phones:
        frame = values.fix_phones(frame, hidden)
    if config.remove_special_chars:
        frame = values.remove_noise(frame, hidden)
    if config.clean_arabic:
        frame = values.clean_arabic(frame, hidden)
    if config.fill_missing.get("numeric"):
        frame = fill_numeric(frame, "zero", hidden)
    if config.anonymize_pii:
        frame = values.mask_pii(frame, hidden, config.strict_mask)
    return frame
