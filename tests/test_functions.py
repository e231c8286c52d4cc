"""Table-driven tests of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import dates, text


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    text.sanitize_nulls: [
        ("", None), ("nan", None), (" NULL ", None), ("None", None), ('"', None), ("'", None),
        ('"nan', None), ('"nan"', '"nan"'), ("''", "''"), ("N/A", "N/A"), (" x ", "x"),
        ("  y ", "y"), (None, None), ('""', None), ('"""', None), ("nana", "nana"),
        (" ", None),
    ],
    text.parse_money: [
        ("$3,500", 3500.0), ("4.2k", 4200.0), ("1.5M", 1500000.0), ("€ 50", 50.0), ("(500)", 500.0),
        ("1.234,56", 1.23456), ("5 km", 5000000.0), ("Bob", None), ("", None), (".", None),
        ("-", None), ("nan", None), ("-7", -7.0), ("1.2.3", None), ("2b", 2e9), ("k", None),
        ("٣٥", 35.0), (None, None), ("12-", None), ("5d", 5.0), (" 10 ", 10.0),
    ],
    text.clean_phone: [
        ("(202) 555-0100", "2025550100"), ("+1 202", "+1202"), ("(+20) 11", "+2011"), ("12", None),
        ("", None), ("nan", None), ("0100-5", "01005"), (None, None), ("a+123", "123"),
    ],
    text.fix_email: [
        ("name@@gmail.com", "name@gmail.com"), (" U@X.org ", "u@x.org"), ("a@@@b.com", None),
        ("a@b.c", None), ("plain", None), ("a b@c.de", None), ("a@b c.de", None), (None, None),
    ],
    text.strip_noise: [
        ("a*b^c#?", "abc"), ('{"k": 1*}', '{"k": 1*}'), (" [x*] ", " [x*] "), ("x (y) & z@", "x (y) & z@"),
        ("http://a.b/c?d=e", "http://a.b/cd=e".replace("=", "")), (None, None), ("*", ""), ("عَلي", "علي"),
    ],
    text.mask_email: [
        ("ahmed@example.com", "a****@example.com"), ("a@b.co", "*@b.co"), ("@b.co", "*@b.co"),
        ("none", "none"), ("a@b@c", "*@b@c"), ("ab@b@c", "a****@b@c"), (None, None), ("", ""), ("nan", "nan"),
    ],
    text.mask_phone: [
        ("202-555-0100", "********0100"), ("1234", "****"), ("12", "**"), (" 12345 ", "*2345"), (None, None),
    ],
    text.mask_name: [("Ahmed Ali", "A****"), ("A", "*"), ("", ""), (None, None), (" Bo ", "B****")],
    text.normalize_arabic: [
        ("مُحَمَّد", "محمد"), ("أإآ", "ااا"), ("علـــى", "علي"), ("٠١٢٩", "0129"), ("مدرسة", "مدرسة"),
        ("ٱ", "ٱ"), ("۱", "۱"), (" x ", "x"), (None, None),
    ],
    text.normalize_key: [
        ("Coca-Cola Co.", "cocacolaco"), (None, ""), ("", ""), ("a_b c", "a_bc"), ("Ünï-1", "ünï1"),
    ],
    text.strip: [("  a \x1c", "a"), ("a\n", "a")],
    text.remove_arabic_marks: [("مُ", "م")],
    text.remove_tatweel: [("عـلي", "علي")],
    text.unify_alef: [("أ", "ا")],
    text.unify_yeh: [("ى", "ي")],
    text.arabic_digits_to_ascii: [("٣", "3")],
}


@pytest.mark.parametrize("fn", CASES, ids=lambda f: f.__name__)
def test_scalar(spark, fn):
    values, expected = zip(*CASES[fn])
    assert apply(spark, fn, values) == list(expected)


D = dt.datetime
DATES = [
    ("2023-01-05", D(2023, 1, 5)), ("2023/1/5", D(2023, 1, 5)), ("05/01/2023", D(2023, 1, 5)),
    ("5-1-2023", D(2023, 1, 5)), ("01-15-2023", D(2023, 1, 15)), ("1/13/2023", D(2023, 1, 13)),
    ("2023-13-01", D(2023, 1, 13)), ("2024-30-12", D(2024, 12, 30)), ("1/2/23", D(2023, 2, 1)),
    ("31/12/99", D(1999, 12, 31)), ("31/12/75", D(2075, 12, 31)), ("31/12/76", D(1976, 12, 31)),
    ("23-01-05", D(2005, 1, 23)), ("12.05.2023", D(2023, 5, 12)), ("Jan 5, 2023", D(2023, 1, 5)),
    ("5 January 2023", D(2023, 1, 5)), ("20230105", D(2023, 1, 5)), ("2023-01-05 14:30", D(2023, 1, 5, 14, 30)),
    ("2023-05", D(2023, 5, 1)), ('"01-15-2023"', None), ("12345", None), ("abc", None), ("12:30", None),
    ("2023", D(2023, 1, 1)), ("1/2/2023 3:45 PM", D(2023, 2, 1, 15, 45)), ("Jan 5 2023", D(2023, 1, 5)),
    ("5-Jan-2023", D(2023, 1, 5)), ("05 Jan 23", D(2023, 1, 5)), ("January 5, 2023 10:00", D(2023, 1, 5, 10)),
    ("2023.05.12", D(2023, 5, 12)), ("2023-1-5T1:2", D(2023, 1, 5, 1, 2)), ("1/2/2023T10:00", D(2023, 2, 1, 10)),
    ("2023-01-05 14:30:00.123456", D(2023, 1, 5, 14, 30, 0, 123456)), ("5/2023", D(2023, 5, 1)),
    ("13/2023", None), ("Jan 2023", D(2023, 1, 1)), ("2023 Jan 5", D(2023, 1, 5)), ("1-2-3", D(2003, 2, 1)),
    ("99/1/2", D(1999, 2, 1)), ("1.2.23", D(2023, 2, 1)), ("32/1/2023", None), ("2/30/2023", None),
    ("Thu Jan 5 2023", D(2023, 1, 5)), ("20230105 10:00", D(2023, 1, 5, 10)), ("2023/01/05 14", D(2023, 1, 5, 14)),
    ("20231305", D(2023, 5, 13)), ("2023-01-05 14:30:00 +0200", D(2023, 1, 5, 12, 30)),
    ("2023-01-05T14:30:00Z", D(2023, 1, 5, 14, 30)), ("05-01-2023 1:2:3", D(2023, 1, 5, 1, 2, 3)),
    ("12/05/2023, 10:00", D(2023, 5, 12, 10)), ("2023-02-30", None), ("13/13/2023", None),
    ("1/2/2023 12:30 AM", D(2023, 2, 1, 0, 30)), ("2023-01-05 24:00", None), ("1/2/23 14:30", D(2023, 2, 1, 14, 30)),
    (None, None), ("", None), ("Janx 5, 2023", None), ("05 01 2023", D(2023, 1, 5)),
]


def test_dates(spark):
    values, expected = zip(*DATES)
    got = apply(spark, dates.parse_date_mixed, values)
    assert [(v, g) for v, g in zip(values, got)] == list(DATES)


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(2025550100.0, 12345678.5, 1.5, 10000000.0, -3.0)], "a double, b double, c double, d double, e double")
    double = T.DoubleType()
    row = df.select(*[text.plain_number(F.col(c), double).alias(c) for c in df.columns]).first()
    assert tuple(row) == ("2025550100", "12345678.5", "1.5", "10000000", "-3")
    assert df.select(text.plain_number(F.col("d"), double, True)).first()[0] == "10000000.0"


def test_header_case():
    assert text.header_case(" Phone Number ") == "phone_number"
    assert text.header_case("a - b") == "a___b"
    assert text.header_case("A/B-C") == "a_b_c"
