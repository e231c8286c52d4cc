"""Column names: standardised headers and the name-based column selectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewash.functions import patterns as P
from tablewash.functions.text import header_case

ROW_ID = "_rid"
# What a job that marks rows instead of dropping them carries beside the table.
JOB_RAW, JOB_STATUS, JOB_MATCHED = "_job_raw", "_job_status", "_job_matched"
HIDDEN = (ROW_ID, JOB_RAW, JOB_STATUS, JOB_MATCHED)


def business_columns(df: DataFrame) -> list[str]:
    """All columns but the hidden ones."""
    return [c for c in df.columns if c not in HIDDEN]


def unique_names(names: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Suffix ``_1``, ``_2``, ... to names that repeat or are already taken."""
    used = {n.lower() for n in taken}
    result = []
    for name in names:
        candidate, n = name, 0
        while candidate.lower() in used:
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate.lower())
        result.append(candidate)
    return result


def standardized_names(columns: Sequence[str]) -> dict[str, str]:
    """Old name -> snake_case name, collisions suffixed."""
    business = [c for c in columns if c not in HIDDEN]
    renamed = dict(zip(business, unique_names([header_case(c) for c in business])))
    return {c: renamed.get(c, c) for c in columns}


def standardize_headers(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; a metadata-only projection."""
    return df.toDF(*standardized_names(df.columns).values())


def _has(name: str, parts: Sequence[str]) -> bool:
    return any(p in name.lower() for p in parts)


def is_email_name(name: str) -> bool:
    return _has(name, P.EMAIL_NAME_PARTS)


def is_phone_name(name: str) -> bool:
    return _has(name, P.PHONE_NAME_PARTS)


def is_money_name(name: str) -> bool:
    """False for names that must never be read as amounts."""
    return not _has(name, P.MONEY_VETO_NAME_PARTS)


def mask_kind(name: str, strict: bool = False) -> str | None:
    """How a column is masked by its name: ``email``, ``phone``, ``name`` or not at all."""
    if _has(name, P.MASK_EMAIL_NAME_PARTS):
        return "email"
    if _has(name, P.PHONE_NAME_PARTS if strict else P.MASK_PHONE_NAME_PARTS):
        return "phone"
    if _has(name, P.MASK_TEXT_NAME_PARTS) and not _has(name, P.MASK_TEXT_VETO_PARTS):
        return "name"
    return None


def suggest_ignores(columns: Iterable[str]) -> list[str]:
    """Columns a user most likely wants left alone (ids, addresses, free text)."""
    return [c for c in columns if _has(c, P.IGNORE_HINT_NAME_PARTS)]


def string_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if f.name not in HIDDEN and isinstance(f.dataType, T.StringType)
    ]


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if f.name not in HIDDEN and isinstance(f.dataType, T.NumericType)
    ]


def excluded_columns(
    columns: Sequence[str], ignore: Iterable[str], standardize: bool = False
) -> set[str]:
    """Resolve ignore names against raw and, if asked, standardised names."""
    wanted = set(ignore)
    if standardize:
        wanted |= {header_case(c) for c in wanted}
        return {c for c in columns if c in wanted or header_case(c) in wanted}
    return {c for c in columns if c in wanted}
