"""What a user switches on: one immutable object with the cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleaningConfig:
    """Cleaning steps and their parameters; every step is off unless noted.

    ``fill_missing`` takes ``{"numeric": "mean" | "median" | "zero"}``.
    ``dedupe_column`` is ``"ALL"`` for whole rows or a column name.
    The last group holds options with no effect on results unless changed;
    ``detect_sample="all"`` lets all values of a column decide whether it holds
    dates or amounts, not only the first fifteen.
    """

    # The names and defaults of the options below, up to ``fill_missing``.
    standardize_columns: bool = False
    drop_empty_rows: bool = True
    clean_arabic: bool = False

    remove_duplicates: bool = False
    dedupe_column: str = "ALL"
    fuzzy_dedupe: bool = False

    merge_active: bool = False
    merge_key_main: str = ""
    merge_key_sec: str = ""
    merge_fuzzy: bool = False
    clean_merged_columns: bool = True

    clean_money: bool = False
    fix_dates: bool = False
    fix_phones: bool = False
    fix_emails: bool = False
    remove_special_chars: bool = False
    anonymize_pii: bool = False

    ignore_columns: Sequence[str] = ()
    fill_missing: Mapping[str, str] = field(default_factory=dict)

    reference_year: int = 2026
    strict_mask: bool = False
    detect_sample: str = "head15"

    @classmethod
    def from_dict(cls, values: Mapping) -> CleaningConfig:
        """Build from a plain mapping, e.g. parsed JSON; unknown names are refused."""
        return cls(**values)

    def __post_init__(self) -> None:
        method = self.fill_missing.get("numeric")
        if method and method not in ("mean", "median", "zero"):
            raise ValueError(f"unknown fill method {method!r}: use mean, median or zero")
        if self.detect_sample not in ("head15", "all"):
            raise ValueError(f"unknown sample {self.detect_sample!r}: use head15 or all")
