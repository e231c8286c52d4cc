"""Scalar cleaning functions, each ``Column -> Column`` and free of UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import patterns as P


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends (Spark's ``trim`` only takes U+0020)."""
    return F.regexp_replace(c, P.STRIP_PATTERN, "")


def plain_number(c: Column, data_type: T.DataType, keep_fraction_zero: bool = False) -> Column:
    """Text of a number without an exponent.

    ``2025550100.0`` becomes ``2025550100`` (or ``2025550100.0`` when
    ``keep_fraction_zero`` is set, the form a diff shows).
    """
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return c.cast("string")
    d = c.cast("double")
    whole = F.round(d, 0) == d
    whole_text = d.cast("decimal(38,0)").cast("string")
    if keep_fraction_zero:
        whole_text = F.concat(whole_text, F.lit(".0"))
    fraction_text = F.rtrim(d.cast("decimal(38,18)").cast("string"), F.lit("0"))
    return (
        F.when(whole & (F.abs(d) < F.lit(1e16)), whole_text)
        .when((F.abs(d) >= F.lit(1e7)) & (F.abs(d) < F.lit(1e16)), fraction_text)
        .otherwise(d.cast("string"))
    )


def as_text(c: Column, data_type: T.DataType | None) -> Column:
    """The text a value function sees for a column of any type."""
    if data_type is None or isinstance(data_type, T.StringType):
        return c
    return plain_number(c, data_type)


def sanitize_nulls(c: Column) -> Column:
    """Strip; the words nan/null/none, a lone quote and blanks become NULL."""
    return F.when(~c.rlike(P.NULL_TOKEN_PATTERN), strip(c))


def _is_blank(s: Column) -> Column:
    return (s == "") | (F.lower(s) == "nan")


def _ascii_digits(s: Column) -> Column:
    return F.translate(s, P.ARABIC_DIGITS + P.PERSIAN_DIGITS, P.ASCII_DIGITS * 2)


def parse_money(c: Column) -> Column:
    """``$3,500`` -> 3500.0, ``4.2k`` -> 4200.0; anything unreadable -> NULL."""
    s = strip(F.lower(c))
    unit = F.right(s, F.lit(1))
    factor = (
        F.when(unit == "k", F.lit(1e3))
        .when(unit == "m", F.lit(1e6))
        .when(unit == "b", F.lit(1e9))
        .otherwise(F.lit(1.0))
    )
    kept = F.regexp_replace(_ascii_digits(s), r"[^0-9.\-]", "")
    return kept.try_cast("double") * factor


def clean_phone(c: Column) -> Column:
    """Digits only, with a leading ``+`` where the text began ``+`` or ``(+``."""
    s = strip(c)
    digits = F.regexp_replace(s, rf"[^{P.DIGIT}]", "")
    plus = F.when(s.startswith("+") | s.startswith("(+"), F.lit("+")).otherwise(F.lit(""))
    return F.when(~_is_blank(s) & (F.length(digits) >= 3), F.concat(plus, digits))


def fix_email(c: Column) -> Column:
    """Lower-case, halve a doubled ``@``; an invalid address becomes NULL."""
    s = F.replace(F.lower(strip(c)), F.lit("@@"), F.lit("@"))
    return F.when(s.rlike(P.EMAIL_PATTERN), s)


def strip_noise(c: Column) -> Column:
    """Delete symbols outside words, spaces and ``. - @ : / ( ) &``; JSON-like text stays."""
    s = strip(c)
    json_like = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    return F.when(json_like, c).otherwise(strip(F.regexp_replace(s, P.NOISE_PATTERN, "")))


def mask_email(c: Column, strict: bool = False) -> Column:
    """``ahmed@example.com`` -> ``a****@example.com``.

    Text without ``@`` stays in clear unless ``strict``, which masks it as text.
    """
    s = strip(c)
    at = F.locate("@", s)
    head = F.when(at > 2, F.concat(F.left(s, F.lit(1)), F.lit("****"))).otherwise(F.lit("*"))
    masked = F.concat(head, F.substr(s, at))
    return (
        F.when(s.isNull() | _is_blank(s), c)
        .when(at > 0, masked)
        .otherwise(mask_name(s) if strict else s)
    )


def mask_phone(c: Column) -> Column:
    """All but the last four characters become ``*``; the length is kept."""
    s = strip(c)
    n = F.length(s)
    masked = F.when(
        n > 4, F.concat(F.repeat(F.lit("*"), n - 4), F.right(s, F.lit(4)))
    ).otherwise(F.repeat(F.lit("*"), n))
    return F.when(s.isNull() | _is_blank(s), c).otherwise(masked)


def mask_name(c: Column) -> Column:
    """First character and ``****``; a single character becomes ``*``."""
    s = strip(c)
    masked = F.when(
        F.length(s) > 1, F.concat(F.left(s, F.lit(1)), F.lit("****"))
    ).otherwise(F.lit("*"))
    return F.when(s.isNull() | _is_blank(s), c).otherwise(masked)


def remove_arabic_marks(c: Column) -> Column:
    return F.regexp_replace(c, P.ARABIC_MARKS_PATTERN, "")


def remove_tatweel(c: Column) -> Column:
    return F.translate(c, P.ARABIC_TATWEEL, "")


def unify_alef(c: Column) -> Column:
    return F.translate(c, P.ARABIC_ALEFS, P.ARABIC_BARE_ALEF * len(P.ARABIC_ALEFS))


def unify_yeh(c: Column) -> Column:
    return F.translate(c, P.ARABIC_ALEF_MAKSURA, P.ARABIC_YEH)


def arabic_digits_to_ascii(c: Column) -> Column:
    return F.translate(c, P.ARABIC_DIGITS, P.ASCII_DIGITS)


def normalize_arabic(c: Column) -> Column:
    """All five Arabic rules; one ``translate`` carries the character maps."""
    source = P.ARABIC_ALEFS + P.ARABIC_ALEF_MAKSURA + P.ARABIC_DIGITS + P.ARABIC_TATWEEL
    target = P.ARABIC_BARE_ALEF * len(P.ARABIC_ALEFS) + P.ARABIC_YEH + P.ASCII_DIGITS
    return strip(F.translate(remove_arabic_marks(c), source, target))


def normalize_key(c: Column) -> Column:
    """Join key: lower case, word characters only; NULL gives the empty text."""
    return F.coalesce(F.regexp_replace(F.lower(c), P.NON_WORD_PATTERN, ""), F.lit(""))


def comparable(c: Column) -> Column:
    """Stripped text with NULL, NaN and the empty text made one (NULL)."""
    s = strip(c.cast("string"))
    return F.nullif(s, F.lit(""))


def header_case(name: str) -> str:
    """``Phone Number`` -> ``phone_number``; runs of separators are kept."""
    return name.strip().lower().translate(str.maketrans(" /-", "___"))
