"""Steps, selectors, detectors, fill and exact dedupe."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewash import CleaningConfig, profile, suggest_ignores
from tablewash.operators import detect, headers, values
from tablewash.operators.dedupe import dedupe_column, dedupe_rows
from tablewash.operators.export import to_records
from tablewash.operators.fill import exact_medians, fill_numeric
from tablewash.operators.ordering import head, with_row_id


def rows(df, order="_rid"):
    return [tuple(r) for r in (df.orderBy(order) if order in df.columns else df).collect()]


def test_config_defaults():
    c = CleaningConfig()
    assert c.drop_empty_rows and c.clean_merged_columns and c.dedupe_column == "ALL"
    assert not any([c.standardize_columns, c.fix_dates, c.anonymize_pii, c.fuzzy_dedupe])
    with pytest.raises(ValueError):
        CleaningConfig(fill_missing={"numeric": "mode"})
    assert CleaningConfig.from_dict({"fix_dates": True}).fix_dates


def test_header_collisions_get_a_suffix():  # V3
    assert headers.standardized_names(["A b", "a-b", "A/B", "_rid"]) == {
        "A b": "a_b", "a-b": "a_b_1", "A/B": "a_b_2", "_rid": "_rid"
    }


def test_name_selectors():
    assert headers.is_phone_name("Hotel") and headers.is_phone_name("cell_no")
    assert not headers.is_money_name("paid") and not headers.is_money_name("width")
    assert headers.is_money_name("price")
    assert headers.mask_kind("E-Mail") == "email" and headers.mask_kind("Phone") == "phone"
    assert headers.mask_kind("client") == "name" and headers.mask_kind("client_id") is None
    assert headers.mask_kind("mobile") is None and headers.mask_kind("mobile", True) == "phone"  # V12
    assert suggest_ignores(["id", "Street Address", "name", "comments"]) == ["id", "Street Address", "comments"]


def test_excluded_columns_resolve_on_both_names():  # V4
    assert headers.excluded_columns(["My Id", "b"], ["my_id"], True) == {"My Id"}
    assert headers.excluded_columns(["My Id", "b"], ["My Id"], True) == {"My Id"}
    assert headers.excluded_columns(["My Id", "b"], ["my_id"], False) == set()


def test_sanitize_skips_excluded_and_clears_nan(spark):
    df = spark.createDataFrame([(" nan", " nan", float("nan"))], "a string, b string, c double")
    assert rows(values.sanitize(df, {"b"})) == [(None, " nan", None)]


def test_drop_empty_counts_excluded_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "_rid long, `a.1` string, b double")
    assert rows(values.drop_empty_rows(df)) == [(2, "x", None)]


def test_detectors(spark):
    data = [(i, None if i < 300 else f"{i % 28 + 1}/02/2023", "$1,5" if i % 3 == 0 else "x", "5", "12")
            for i in range(340)]
    df = spark.createDataFrame(data, "k long, d string, m string, one string, two string")
    df = with_row_id(df, "k")
    got = {r["column"]: r for r in detect.detect_columns(df).collect()}
    assert got["d"]["date_like"] and got["d"]["sampled"] == 15  # sparse: found past the head block
    assert got["m"]["money_like"] and got["m"]["money_hits"] == 5
    assert not got["one"]["money_like"] and got["two"]["money_like"]
    assert detect.find_date_columns(df) == ["d"]
    assert detect.find_money_columns(df, {"d"}) == ["m", "two"]
    none = detect.detect_columns(with_row_id(df.where("false"), "k"))
    assert none is None


def test_date_like_column_without_a_readable_value_is_left(spark):
    df = with_row_id(spark.createDataFrame([(1, "99/99/9999")], "k long, d string"), "k")
    assert detect.find_date_columns(df) == []


def test_detectors_without_row_order(spark):
    df = spark.createDataFrame([("11/2/2023",), ("x",)], "d string")
    assert detect.find_date_columns(df) == ["d"]


def test_detector_accepts_struct_row_ids(spark):
    df = spark.createDataFrame([(1, 2, "11/2/2023"), (1, 3, "x")], "a long, b long, d string")
    assert detect.find_date_columns(with_row_id(df, ["a", "b"]), {"a"}) == ["d"]


@pytest.mark.parametrize("direct", [1_000_000, 3, 1])
@pytest.mark.parametrize("kind", ["spread", "copies", "even", "single"])
def test_exact_median(spark, direct, kind):
    import random
    import statistics
    rnd = random.Random(3)
    data = {
        "spread": [rnd.uniform(-5, 5) for _ in range(501)],
        "copies": [1.0] * 200 + [float(i) for i in range(150)] + [7.0] * 150,
        "even": [1.0, 2.0, 4.0, 9.0],
        "single": [3.5],
    }[kind]
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double")
    got = exact_medians(df, {"v": len(data)}, direct_rows=direct, accuracy=10)
    assert got["v"] == pytest.approx(statistics.median(data))


def test_fill(spark):
    df = spark.createDataFrame(
        [(1, 2, None, 5, None, None), (2, None, 3.0, 6, None, True), (3, 6, 5.0, 7, None, None)],
        "_rid long, i long, d double, full long, s string, b boolean",
    )
    assert rows(fill_numeric(df, "zero"))[1] == (2, 0, 3.0, 6, None, True)
    mean = fill_numeric(df, "mean")
    assert rows(mean)[0][2] == 4.0 and rows(mean)[1][1] == 4.0
    assert dict(mean.dtypes)["i"] == "double" and dict(mean.dtypes)["full"] == "bigint"
    median = fill_numeric(df, "median", exclude={"d"})
    assert rows(median)[1][1] == 4.0 and rows(median)[0][2] is None


def test_string_column_that_became_null_is_not_filled(spark):  # V11
    df = spark.createDataFrame([(1, "bad")], "_rid long, email string")
    out = fill_numeric(values.fix_emails(df), "zero")
    assert rows(out) == [(1, None)]


def test_dedupe_keeps_the_first_row(spark):
    df = spark.createDataFrame(
        [(3, "a", 1), (1, "a", 1), (2, None, None), (4, None, None), (5, "a", 2)], "_rid long, s string, n long"
    )
    assert rows(dedupe_rows(df).select("_rid", "s", "n")) == [(1, "a", 1), (2, None, None), (5, "a", 2)]
    assert [r[0] for r in rows(dedupe_column(df, "s"))] == [1, 2]
    assert dedupe_rows(df.drop("_rid")).count() == 3
    with pytest.raises(ValueError, match="row order"):
        dedupe_column(df.drop("_rid"), "s")


def test_dedupe_column_limits_groups_before_the_shuffle(spark):
    df = with_row_id(spark.range(100).selectExpr("id", "id % 3 k"), "id")
    plan = dedupe_column(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_number_phone_columns_gain_no_digit(spark):  # V7
    df = spark.createDataFrame([(2025550100.0, 20255501000)], "phone double, tel long")
    assert rows(values.fix_phones(df)) == [("2025550100", "20255501000")]


def test_mask_step(spark):
    df = spark.createDataFrame(
        [("not mail", "202-555-0100", "0100", "Bo Li", "x1")],
        "email string, phone string, mobile string, name string, client_id string",
    )
    assert rows(values.mask_pii(df)) == [("not mail", "********0100", "0100", "B****", "x1")]
    assert rows(values.mask_pii(df, strict=True)) == [("n****", "********0100", "****", "B****", "x1")]  # V12
    assert rows(values.mask_pii(df, exclude={"name"}))[0][3] == "Bo Li"


def test_dates_step_casts_date_types(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 5), "2023-01-05T10:00:00+02:00")], "a date, b string")
    assert rows(values.fix_dates(df, ["a", "b"])) == [(dt.datetime(2023, 1, 5), dt.datetime(2023, 1, 5, 8))]  # V13


def test_profile_and_records(spark):
    df = spark.createDataFrame(
        [(1, "علي", float("nan"), dt.datetime(2023, 1, 5)), (2, None, 1.5, None)],
        "id long, name string, v double, t timestamp_ntz",
    )
    got = [tuple(r) for r in profile(df).orderBy("position").collect()]
    assert got[1] == (2, "name", "string", 2, 1, True, False)
    assert got[2][4] == 1 and got[0][6] is True
    records = [r[0] for r in to_records(head(with_row_id(df, "id"), 5)).collect()]
    assert records == [
        '{"id":1,"name":"علي","v":null,"t":"2023-01-05T00:00:00"}',
        '{"id":2,"name":null,"v":1.5,"t":null}',
    ]


def test_row_wise_steps_plan_without_python_or_shuffle(spark):
    df = spark.range(5).select(
        F.lit("a@b.co").alias("email"), F.lit("1").alias("phone"), F.lit("n").alias("name")
    )
    out = values.mask_pii(values.clean_arabic(values.remove_noise(values.fix_phones(values.fix_emails(values.sanitize(df))))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
