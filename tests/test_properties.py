"""Properties of masks and of repeated cleaning, the stream module, and the driver contract."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewash import CleaningConfig
from tablewash.functions import text
from tablewash.streaming.rowwise import clean_stream

ALPHABET = "aZ09 @.+-()*#{}[]'\"أـً٣é \t_/$k"


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(11)
    rows = [("".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(14))),) for _ in range(3000)]
    return spark.createDataFrame(rows, "v string").cache()


@pytest.mark.parametrize("fn", [
    text.clean_phone, text.fix_email, text.strip_noise, text.normalize_arabic, text.normalize_key, text.sanitize_nulls,
], ids=lambda f: f.__name__)
def test_idempotent(samples, fn):
    once = samples.select("v", fn(F.col("v")).alias("a"))
    twice = once.select("v", "a", fn(F.col("a")).alias("b"))
    if fn in (text.clean_phone, text.fix_email, text.sanitize_nulls):
        twice = twice.where("a is not null")
    if fn is text.fix_email:  # "a@@b" is halved once per run
        twice = twice.where("NOT contains(a, '@@')")
    assert twice.where(~F.col("a").eqNullSafe(F.col("b"))).take(3) == []


def test_masks_keep_little(samples):
    s = text.strip(F.col("v"))
    shown = samples.where((s != "") & (F.lower(s) != "nan")).select(
        s.alias("s"), text.mask_phone(F.col("v")).alias("p"), text.mask_name(F.col("v")).alias("n"),
        text.mask_email(F.col("v")).alias("e"),
    )
    assert shown.where("length(p) <> length(s)").take(1) == []
    assert shown.where("length(s) > 4 and left(p, length(p) - 4) rlike '[^*]'").take(1) == []
    assert shown.where("length(s) > 1 and substring(n, 2) <> '****'").take(1) == []
    assert shown.where("locate('@', s) > 2 and left(e, 5) <> concat(left(s, 1), '****')").take(1) == []


def test_row_wise_steps_run_on_a_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    extra = {
        "Email": F.expr("'U' || event_id || '@@x.org'"), "Price": F.expr("'$' || event_id || ',500'"),
        "Day": F.date_format("ts", "dd/MM/yyyy"),
    }
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).write.mode("overwrite").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(source).withColumns(extra)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(str(tmp_path / "in")).withColumns(extra)
    config = CleaningConfig(standardize_columns=True, fix_dates=True, clean_money=True, fix_emails=True,
                            ignore_columns=["ts", "props", "event_type"])
    out = clean_stream(stream, config, like=batch)
    assert out.isStreaming
    query = out.writeStream.format("memory").queryName("washed").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("washed")
    assert rows.count() == batch.count()
    first = rows.where("event_id = 7").select("email", "price", "day").first()
    assert first["email"] == "u7@x.org" and first["price"] == 7500.0 and first["day"].year == 2024
    with pytest.raises(ValueError, match="one row"):
        clean_stream(stream, CleaningConfig(remove_duplicates=True), like=batch)


def test_contract_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "email" in df.columns
