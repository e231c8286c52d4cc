"""Row-wise cleaning steps, each ``DataFrame -> DataFrame`` for ``df.transform``.

A step touches only its own columns and adds no shuffle; consecutive steps are
merged by the optimizer into one projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import text
from tablewash.functions.dates import parse_date_mixed
from tablewash.operators import headers


def _replace(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to the text of each column; numbers are turned to text first."""
    types = {f.name: f.dataType for f in df.schema.fields}
    changed = {c: fn(text.as_text(F.col(f"`{c}`"), types[c])) for c in columns}
    return df.withColumns(changed) if changed else df


def sanitize(df: DataFrame, exclude: Collection[str] = ()) -> DataFrame:
    """Strip string columns and turn null words to NULL; double NaN becomes NULL."""
    out = _replace(
        df, [c for c in headers.string_columns(df) if c not in exclude], text.sanitize_nulls
    )
    return nan_to_null(out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floating-point values are NULL, never NaN, in the whole library."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    if not floats:
        return df
    return df.withColumns(
        {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose business columns are all NULL."""
    return df.dropna("all", subset=[f"`{c}`" for c in headers.business_columns(df)])


def fix_dates(df: DataFrame, columns: Iterable[str], reference_year: int = 2026) -> DataFrame:
    """Parse the given columns to TIMESTAMP_NTZ; date and time columns are only cast."""
    changed = {}
    for c in columns:
        kind = df.schema[c].dataType
        col = F.col(f"`{c}`")
        if isinstance(kind, T.StringType):
            changed[c] = parse_date_mixed(col, reference_year)
        elif isinstance(kind, T.TimestampType):
            changed[c] = F.convert_timezone(None, F.lit("UTC"), col.cast("timestamp_ntz"))
        else:
            changed[c] = col.cast("timestamp_ntz")
    return df.withColumns(changed) if changed else df


def clean_money(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _replace(df, columns, text.parse_money)


def fix_emails(df: DataFrame, exclude: Collection[str] = ()) -> DataFrame:
    names = [c for c in headers.business_columns(df) if headers.is_email_name(c)]
    return _replace(df, [c for c in names if c not in exclude], text.fix_email)


def fix_phones(df: DataFrame, exclude: Collection[str] = ()) -> DataFrame:
    names = [c for c in headers.business_columns(df) if headers.is_phone_name(c)]
    return _replace(df, [c for c in names if c not in exclude], text.clean_phone)


def remove_noise(df: DataFrame, exclude: Collection[str] = ()) -> DataFrame:
    names = [c for c in headers.string_columns(df) if c not in exclude]
    return _replace(df, names, text.strip_noise)


def clean_arabic(df: DataFrame, exclude: Collection[str] = ()) -> DataFrame:
    """Normalise Arabic text; an identity on columns that hold none."""
    names = [c for c in headers.string_columns(df) if c not in exclude]
    return _replace(df, names, text.normalize_arabic)


def masked_columns(df: DataFrame, exclude: Collection[str] = (), strict: bool = False) -> dict[str, str]:
    """Column -> kind of mask, chosen by name."""
    kinds = {c: headers.mask_kind(c, strict) for c in headers.business_columns(df)}
    return {c: k for c, k in kinds.items() if k and c not in exclude}


def mask_pii(df: DataFrame, exclude: Collection[str] = (), strict: bool = False) -> DataFrame:
    """Mask e-mail, phone and name columns."""
    masks = {
        "email": lambda c: text.mask_email(c, strict),
        "phone": text.mask_phone,
        "name": text.mask_name,
    }
    out = df
    for column, kind in masked_columns(df, exclude, strict).items():
        out = _replace(out, [column], masks[kind])
    return out
