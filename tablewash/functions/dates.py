"""Mixed-format, day-first date parsing.

Every accepted shape is rewritten by one regular expression to the ISO layout
``y-M-d time``, which Spark then casts.  A failing cast returns NULL without
raising, so rows in a foreign shape cost no exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash.functions.text import strip

# --- fixed values: the accepted shapes ----------------------------------------
_SEP = r"[-/. ]"
_END = r"(?:(?:T|[ ,]+)([0-9].*))?$"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?"
    r"|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
)
_WEEKDAY = r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
# The first letters of a month's name, and its number.
_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

YEAR_FIRST = rf"^([0-9]{{4}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_END}"
DAY_FIRST = rf"^([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{4}}){_END}"
DAY_FIRST_SHORT = rf"^([0-2]?[0-9]|3[01]){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_END}"
SHORT_YEAR_FIRST = rf"^(3[2-9]|[4-9][0-9]){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_END}"
COMPACT = rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){_END}"
YEAR_MONTH = r"^([0-9]{4})[-/]([0-9]{1,2})$"
MONTH_YEAR = r"^([0-9]{1,2})[-/]([0-9]{4})$"
YEAR_ONLY = r"^([0-9]{4})$"
NAMED_MONTH_DAY = rf"(?i){_WEEKDAY}{_MONTH}[ -]+([0-9]{{1,2}})(?:,? +|-)([0-9]{{4}}){_END}"
DAY_NAMED_MONTH = rf"(?i){_WEEKDAY}([0-9]{{1,2}})[ -]+{_MONTH}[ ,-]+([0-9]{{4}}){_END}"
DAY_NAMED_MONTH_SHORT = rf"(?i){_WEEKDAY}([0-9]{{1,2}})[ -]+{_MONTH}[ ,-]+([0-9]{{2}})$"
YEAR_NAMED_MONTH = rf"(?i)^([0-9]{{4}})[ -]+{_MONTH}[ -]+([0-9]{{1,2}}){_END}"
NAMED_MONTH_YEAR = rf"(?i)^{_MONTH}[ -]+([0-9]{{4}})$"

HALF_DAY = r"(?i) [0-9:]+ ?[ap]m$"
OFFSET = r"(?i)(:[0-9]{1,2}(?:\.[0-9]+)?) ?(z|utc|[+-][0-9]{2}:?[0-9]{2})$"
# -----------------------------------------------------------------------------


def _full_year(text: Column, year: Column, reference_year: int) -> Column:
    """Put the century before the two-digit ``year`` that ``text`` starts with."""
    first_of_last_century = (reference_year + 50) % 100
    century = reference_year - reference_year % 100 + (100 if reference_year % 100 >= 50 else 0)
    late = year.try_cast("int") >= first_of_last_century
    return F.concat(
        F.when(late, F.lit(str(century // 100 - 1))).otherwise(F.lit(str(century // 100))),
        F.lpad(year, 2, "0"),
        F.substr(text, F.length(year) + 1),
    )


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def iso_layout(s: Column, reference_year: int = 2026) -> Column:
    """Rewrite a stripped date text to ``y-M-d time``; NULL for an unknown shape."""

    def month_name(pattern: str, group: int, layout: str) -> Column:
        name = F.lower(F.substring(F.regexp_extract(s, pattern, group), 1, 3))
        month = F.create_map(*[F.lit(x) for m, n in _MONTHS.items() for x in (m, str(n))])[name]
        return F.replace(F.regexp_replace(s, pattern, layout), F.lit("MM"), month)

    def short(pattern: str, layout: str, year: Column) -> Column:
        return _full_year(F.regexp_replace(s, pattern, layout), year, reference_year)

    return (
        F.when(s.rlike(YEAR_FIRST), F.regexp_replace(s, YEAR_FIRST, "$1-$2-$3 $4"))
        .when(s.rlike(DAY_FIRST), F.regexp_replace(s, DAY_FIRST, "$3-$2-$1 $4"))
        .when(
            s.rlike(DAY_FIRST_SHORT),
            short(DAY_FIRST_SHORT, "$3-$2-$1 $4", F.regexp_extract(s, DAY_FIRST_SHORT, 3)),
        )
        .when(
            s.rlike(SHORT_YEAR_FIRST),
            short(SHORT_YEAR_FIRST, "$1-$3-$2 $4", F.substring(s, 1, 2)),
        )
        .when(s.rlike(COMPACT), F.regexp_replace(s, COMPACT, "$1-$2-$3 $4"))
        .when(s.rlike(YEAR_MONTH), F.regexp_replace(s, YEAR_MONTH, "$1-$2"))
        .when(s.rlike(MONTH_YEAR), F.regexp_replace(s, MONTH_YEAR, "$2-$1"))
        .when(s.rlike(YEAR_ONLY), s)
        .when(s.rlike(NAMED_MONTH_DAY), month_name(NAMED_MONTH_DAY, 1, "$3-MM-$2 $4"))
        .when(s.rlike(DAY_NAMED_MONTH), month_name(DAY_NAMED_MONTH, 2, "$3-MM-$1 $4"))
        .when(
            s.rlike(DAY_NAMED_MONTH_SHORT),
            _full_year(
                month_name(DAY_NAMED_MONTH_SHORT, 2, "$3-MM-$1"),
                F.right(s, F.lit(2)),
                reference_year,
            ),
        )
        .when(s.rlike(YEAR_NAMED_MONTH), month_name(YEAR_NAMED_MONTH, 2, "$1-MM-$3 $4"))
        .when(s.rlike(NAMED_MONTH_YEAR), month_name(NAMED_MONTH_YEAR, 1, "$2-MM"))
    )


def _to_timestamp(iso: Column) -> Column:
    """Cast ISO-layout text: plain, 12-hour clock, hour only, or with an offset."""
    text = F.rtrim(iso)
    plain = F.regexp_replace(text, r"( [0-9]{1,2})$", "$1:00").try_cast("timestamp_ntz")
    half_day = F.try_to_timestamp(
        F.upper(F.regexp_replace(text, r"(?i) ?([ap]m)$", " $1")), F.lit("y-M-d h[:m][:s] a")
    ).cast("timestamp_ntz")
    moved = F.regexp_replace(
        F.regexp_replace(text, OFFSET, "$1$2"), r"([+-][0-9]{2}):?([0-9]{2})$", "$1:$2"
    )
    moved = F.regexp_replace(moved, r"(?i)(z|utc)$", "+00:00")
    shifted = F.convert_timezone(
        None, F.lit("UTC"), moved.try_cast("timestamp").cast("timestamp_ntz")
    )
    return (
        F.when(text.rlike(HALF_DAY), half_day)
        .when(text.rlike(OFFSET), shifted)
        .otherwise(plain)
    )


def parse_date_mixed(c: Column, reference_year: int = 2026) -> Column:
    """Day-first parse of mixed date texts to TIMESTAMP_NTZ, NULL where unreadable.

    When the day-first (or ISO) reading is no valid date, month and day are
    swapped.  Two-digit years at least fifty years past ``reference_year`` fall
    in the century before.  A text that holds only a time is NULL.
    """
    def read(iso: Column) -> Column:
        swapped = F.regexp_replace(iso, r"^([0-9]+)-([0-9]+)-([0-9]+)", "$1-$3-$2")
        return F.coalesce(_to_timestamp(iso), _to_timestamp(swapped))

    return _bind(strip(c), lambda s: _bind(iso_layout(s, reference_year), read))
