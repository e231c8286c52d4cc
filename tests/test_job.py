"""The job that writes once, dense row numbers, detectors over whole columns."""

import pytest
from pyspark.sql import functions as F

from tablewash import CleaningConfig, clean, read_table, run_job
from tablewash.operators import detect
from tablewash.operators.dedupe import dedupe_rows, first_ids
from tablewash.operators.diff import number_rows
from tablewash.operators.headers import ROW_ID
from tablewash.operators.ordering import row_numbers, with_order_number, with_row_id


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def table(spark):
    rows = [
        (1, "Anna Smith", "$1,200", "ANNA@mail.com", 5.0, "k1", "2024-01-05"),
        (2, "Anna Smyth", "3k", "bad", None, "K 1", "05/02/2024"),
        (3, None, " nan ", "", None, None, None),
        (4, "Bob Stone", "7", "b@@x.org", 2.0, "k2", "none"),
        (5, "Anna Smith", "$1,200", "anna@mail.com", 5.0, "k1", "2024-01-05"),
        (6, "Bob Stonne", "n/a", "b@x.org", float("nan"), "k9", "2024-03-09"),
        (7, None, None, None, None, None, None),
        (8, "Carl", "$5", "c@x.org", 9.0, "k2", "x"),
    ]
    return spark.createDataFrame(rows, "id int, `Full Name` string, Price string, Email string, n double, ref string, day string").repartition(3)


@pytest.fixture()
def lookup(spark):
    return spark.createDataFrame([(1, "k-1", "first", 1.5), (2, "K1", "second", None), (3, "k3", "third", 3.0)], "lid int, ref string, label string, n double")


CONFIGS = [
    {},
    {"remove_duplicates": True},
    {"remove_duplicates": True, "dedupe_column": "Email", "fix_emails": True},
    {"remove_duplicates": True, "dedupe_column": "Full Name", "fuzzy_dedupe": True, "standardize_columns": True},
    {"fill_missing": {"numeric": "mean"}, "clean_money": True, "fix_dates": True, "anonymize_pii": True, "detect_sample": "all"},
    {"fill_missing": {"numeric": "median"}, "drop_empty_rows": False, "remove_duplicates": True, "dedupe_column": "missing"},
    {"merge_active": True, "merge_key_main": "ref", "merge_key_sec": "ref", "standardize_columns": True, "remove_duplicates": True,
     "dedupe_column": "ref", "fill_missing": {"numeric": "zero"}, "ignore_columns": ("id",)},
]


@pytest.mark.parametrize("options", CONFIGS)
def test_job_gives_what_clean_gives(table, lookup, options):
    table = table.withColumn("id", F.col("id"))
    options = {"ignore_columns": ("id",), **options}
    config = CleaningConfig(**options)
    want = clean(table, config, lookup, order_by="id", lookup_order_by="lid")
    got = run_job(table, config, lookup, order_by="id", lookup_order_by="lid")
    assert got.df.columns == want.df.columns and got.df.dtypes == want.df.dtypes
    assert rows_of(got.df) == rows_of(want.df)
    assert rows_of(got.log()) == rows_of(want.log())
    a, b = got.diff(), want.diff()
    assert rows_of(a.cells()) == rows_of(b.cells()) and rows_of(a.stats()) == rows_of(b.stats())
    assert rows_of(a.removed(None)) == rows_of(b.removed(None))
    assert rows_of(a.changed(2)) == rows_of(b.changed(2)) and rows_of(a.truncated(1)) == rows_of(b.truncated(1))
    assert rows_of(got.head_records(3)) == rows_of(want.head_records(3))


def test_empty_rows_are_dropped_and_not_counted_in_the_mean(table):
    job = run_job(table.drop("id").withColumn("at", F.monotonically_increasing_id()).withColumn("n", F.lit(None).cast("double")).limit(0), CleaningConfig(), order_by="at")
    assert job.df.count() == 0 and job.log().collect() == []
    keyed = with_row_id(table, "id").drop("id")
    job = run_job(keyed, CleaningConfig(fill_missing={"numeric": "mean"}))
    assert [(r.step, r.action, r.n) for r in job.log().collect()] == [(3, "dropped_empty", 2)]
    assert sorted(r.n for r in job.df.collect()) == pytest.approx(sorted([5.0, 5.25, 2.0, 5.0, 5.25, 9.0]))
    assert sorted(r[ROW_ID] for r in job.diff().removed(None).collect()) == [3, 7]


def test_reports_only_scan_the_written_table(table, lookup):
    config = CleaningConfig(merge_active=True, merge_key_main="ref", merge_key_sec="ref", remove_duplicates=True, dedupe_column="Email", ignore_columns=("id",))
    job = run_job(table, config, lookup, order_by="id", lookup_order_by="lid")
    for report in (job.df, job.log(), job.diff().stats(), job.diff().cells(), job.diff().removed(), job.diff().changed()):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") == 1
    assert "raw" not in job.diff().stats()._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    with pytest.raises(ValueError, match="_job_status"):
        run_job(table.withColumn("_job_status", F.lit(1)), config, order_by="id")


def test_job_from_and_to_files(spark, tmp_path, table):
    table.orderBy("id").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    raw = read_table(spark, str(tmp_path / "in"), "csv")
    job = run_job(raw, CleaningConfig(remove_duplicates=True, ignore_columns=("id",)), path=str(tmp_path / "job"))
    job.write(str(tmp_path / "out.csv"))
    back = read_table(spark, str(tmp_path / "out.csv")).drop(ROW_ID)
    assert back.count() == job.df.count() == raw.count()
    numbers = job.row_numbers().join(job.diff().raw, ROW_ID)
    assert sorted((r.row_index, r.id) for r in numbers.collect()) == [(i, i) for i in range(1, 9)]


@pytest.mark.parametrize("key", ["k", ["a", "k"], "s"])
def test_row_numbers_of_any_key(spark, key):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("a")).withColumn("s", F.concat(F.lit("x"), "k"))
    keyed = with_row_id(df.repartition(5), key)
    names = [key] if isinstance(key, str) else key
    want = {tuple(r[c] for c in names): i for i, r in enumerate(sorted(df.collect(), key=lambda r: tuple(r[c] for c in names)), 1)}
    got = keyed.join(row_numbers(keyed), ROW_ID).collect()
    assert len(got) == 500 and all(want[tuple(r[c] for c in names)] == r.row_index for r in got)
    ordered = sorted(with_order_number(keyed).collect(), key=lambda r: r["_order"])
    assert [tuple(r[c] for c in names) for r in ordered] == sorted(want)


def test_row_numbers_of_files(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    df.repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t.parquet"))
    raw = read_table(spark, str(tmp_path / "t.parquet"))
    got = raw.join(row_numbers(raw), ROW_ID).collect()
    assert sorted((r.row_index, r.id) for r in got) == [(i + 1, i) for i in range(1000)]
    some = number_rows(raw.where("id % 300 = 7"), raw)
    assert sorted(r.row_index for r in some.collect()) == [8, 308, 608, 908]
    with pytest.raises(Exception, match="as it was scanned"):
        row_numbers(raw.where("id % 10 <> 5")).collect()


def test_whole_row_dedupe_is_a_hash_aggregate(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" if i % 3 else None, i % 4 == 0) for i in range(40)], "id int, t string, b boolean")
    df.coalesce(1).sortWithinPartitions("id").write.parquet(str(tmp_path / "t.parquet"))
    raw = read_table(spark, str(tmp_path / "t.parquet")).drop("id")
    for frame in (raw, with_row_id(df, ["b", "id"]).drop("id")):
        out = dedupe_rows(frame)
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 4 and out.select(ROW_ID).distinct().count() == 4
        assert first_ids(frame, ["t"]).count() == 2
    assert sorted(r[ROW_ID]["row"] for r in dedupe_rows(raw).collect()) == [0, 1, 3, 4]


def test_detectors_over_whole_columns(spark):
    rows = [(i, None if i % 2 else f"2024-01-{10 + i % 20}", "text" if i < 20 else "$5,000", "only text", None) for i in range(100)]
    df = with_row_id(spark.createDataFrame(rows, "id int, d string, late string, t string, empty string"), "id")
    got = {r["column"]: r for r in detect.detect_columns(df, sample="all").collect()}
    assert sorted(got) == ["d", "id", "late", "t"]
    assert (got["d"].sampled, got["d"].date_hits, got["d"].date_like) == (50, 50, True)
    assert got["late"].money_hits == 80 and got["late"].money_like and not got["t"].money_like
    head = {r["column"]: r for r in detect.detect_columns(df).collect()}
    assert head["late"].sampled == 15 and not head["late"].money_like
    assert detect.find_money_columns(df, sample="all") == ["d", "late"] and detect.find_money_columns(df) == ["d"]
    plan = detect.detect_columns(df, sample="all")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    with pytest.raises(ValueError):
        detect.detect_columns(df, sample="some")
