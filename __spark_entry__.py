"""

Messy columns are derived from integer keys by the texts in ``DIRTY``, which
read the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash import CleaningConfig, clean, compute_diff, lookup_join, profile, read_table, run_job, write_table
from tablewash.functions import dates, similarity, text
from tablewash.operators import detect, headers, values
from tablewash.operators.checkpoints import ensure_checkpoint_dir
from tablewash.operators.dedupe import dedupe_column, dedupe_rows
from tablewash.operators.diff import number_rows
from tablewash.operators.export import to_records
from tablewash.operators.fill import fill_numeric
from tablewash.operators.fuzzy_dedupe import dedupe_fuzzy
from tablewash.operators.headers import ROW_ID
from tablewash.operators.lookup import MATCHED, match_count
from tablewash.operators.ordering import head, row_numbers, with_row_id, without_row_id

try:
    import corpus_pipeline
    from tablewash.llm import queries as llm
except ModuleNotFoundError as missing:  # these parts may be left out as a whole
    if missing.name not in ("corpus_pipeline", "tablewash.llm"):
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

# Texts of messy columns; ``{k}`` is the integer key of the table.
DIRTY = {
    "raw_null": """CASE {k} % 6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN ' NULL ' WHEN 3 THEN 'none'
        WHEN 4 THEN '"' ELSE ' v' || {k} || ' ' END""",
    "raw_money": """CASE {k} % 5 WHEN 0 THEN '$' || {k} || ',500' WHEN 1 THEN {k} || '.2k' WHEN 2 THEN {k} || 'M'
        WHEN 3 THEN '€ ' || {k} ELSE 'n/a' END""",
    "raw_email": """CASE {k} % 4 WHEN 0 THEN 'User' || {k} || '@mail.com' WHEN 1 THEN 'u' || {k} || '@@mail.com'
        WHEN 2 THEN 'u' || {k} ELSE ' U' || {k} || '@x.org ' END""",
    "raw_phone": """CASE {k} % 4 WHEN 0 THEN '+1 (202) 555-' || lpad(CAST({k} % 10000 AS STRING), 4, '0')
        WHEN 1 THEN '(+20) 1' || {k} WHEN 2 THEN '12'
        ELSE '202.555.' || lpad(CAST({k} % 10000 AS STRING), 4, '0') END""",
    "raw_noise": """CASE {k} % 3 WHEN 0 THEN 'a*b^' || {k} || '#?' WHEN 1 THEN '{"k": ' || {k} || '}'
        ELSE 'x (y) & z@' || {k} END""",
    "raw_ar": """CASE {k} % 3 WHEN 0 THEN 'مُحَمَّـد ' || translate(CAST({k} AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩')
        WHEN 1 THEN 'أإآ علىٰ ' ELSE 'plain ' || {k} END""",
    "n_null": "nullif({k} % 7, 0)",
    "dup_key": "CASE WHEN {k} % 17 = 0 THEN NULL WHEN {k} % 3 = 0 THEN 'g7' ELSE 'g' || ({k} % 50) END",
}
PART_LABEL = "p_name || ' ' || p_brand"
# The label with one letter doubled or dropped, by key.
PART_TYPO = f"""CASE p_partkey % 3
        WHEN 0 THEN {PART_LABEL}
        WHEN 1 THEN substr({PART_LABEL}, 1, CAST(2 + p_partkey % 5 AS INT)) || substr({PART_LABEL}, CAST(2 + p_partkey % 5 AS INT))
        ELSE substr({PART_LABEL}, 1, CAST(2 + p_partkey % 5 AS INT)) || substr({PART_LABEL}, CAST(4 + p_partkey % 5 AS INT)) END"""

# The same with wider gaps, and inside longer texts.
LOOKUP_TYPO = f"""CASE WHEN p_partkey % 50 = 0 THEN 'special reserve ' || {PART_LABEL} || ' extra'
        WHEN p_partkey % 50 = 10 THEN 'special reserve ' || substr({PART_LABEL}, 1, 4) || substr({PART_LABEL}, 7) || ' extra'
        WHEN p_partkey % 25 = 3 THEN substr({PART_LABEL}, 1, 3) || substr({PART_LABEL}, 8)
        WHEN p_partkey % 25 = 4 THEN 'xx' || p_partkey || 'yy' ELSE {PART_TYPO} END"""

# What a label is compared with: itself, its words in another order, a longer text around it, one more word.
PART_OTHER = f"""CASE p_partkey % 4 WHEN 0 THEN {PART_LABEL} WHEN 1 THEN p_brand || ' ' || p_name
        WHEN 2 THEN 'special reserve ' || {PART_LABEL} || ' extra' ELSE p_name || ' deluxe ' || p_brand END"""


def dirty(name: str, key: str) -> str:
    return DIRTY[name].replace("{k}", key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_dirty(df: DataFrame, key: str, *names: str) -> DataFrame:
    return df.select(key, *[F.expr(dirty(n, key)).alias(n) for n in names])


def shared_folder(spark: SparkSession) -> str:
    """A new path in the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def column_query(source: str, key: str, name: str, out: str, fn) -> Query:
    """One scalar function over one messy column of a whole table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = with_dirty(table(spark, sf_dir, source), key, name)
        return df.select(key, fn(F.col(name)).alias(out))
    return run


def headers_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").toDF(" Cust Key ", "Name/Full", "Nation-Key", "Acct - Bal", "SEGMENT")
    return headers.standardize_headers(df)


def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_dirty(table(spark, sf_dir, "orders"), "o_orderkey", "raw_null", "n_null")
    return values.drop_empty_rows(values.sanitize(df.drop("o_orderkey")))


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumns({
        "n_null": F.expr(dirty("n_null", "user_id")), "raw_ar": F.expr(dirty("raw_ar", "event_id")),
    })
    return profile(df)


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    raw = (
        F.when(F.expr("o_orderkey % 4 = 0"), F.date_format(day, "dd/MM/yyyy"))
        .when(F.expr("o_orderkey % 4 = 1"), F.date_format(day, "yyyy-MM-dd"))
        .when(F.expr("o_orderkey % 4 = 2") & (F.dayofmonth(day) > 12), F.date_format(day, "MM-dd-yyyy"))
        .when(F.expr("o_orderkey % 4 = 2"), F.date_format(day, "d-M-yyyy"))
        .otherwise("bad")
    )
    return table(spark, sf_dir, "orders").withColumn("raw_date", raw)


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_orders(spark, sf_dir).select(
        "o_orderkey", dates.parse_date_mixed(F.col("raw_date")).alias("parsed")
    )


def detect_query(sample: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _dated_orders(spark, sf_dir).select(
            "o_orderkey", "o_orderdate", "o_orderpriority", "raw_date",
            F.expr(dirty("raw_money", "o_orderkey")).alias("raw_money"),
            F.expr("CASE WHEN o_orderkey % 100 = 99 THEN '12k' END").alias("sparse"),
            # The first values mislead: amounts only at the head, dates only after it.
            F.expr("CASE WHEN o_orderkey < 40 THEN '$' || o_orderkey || '00' ELSE 'none' END").alias("head_only"),
            F.expr("CASE WHEN o_orderkey < 40 THEN 'later' ELSE '2024-05-' || (10 + o_orderkey % 18) END").alias("tail_only"),
        )
        return detect.detect_columns(with_row_id(df, "o_orderkey"), sample=sample)
    return run


def fill_query(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").select(
            "o_orderkey", F.expr(dirty("n_null", "o_orderkey")).alias("n_null"),
            F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END").alias("m_null"),
        )
        out = fill_numeric(df, method)
        return out.select(
            "o_orderkey", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("n_null", "m_null")]
        )
    return run


def strip_noise_text(source: str, key: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, text.strip_noise(F.col(column)).alias("cleaned"))
    return run


def dedupe_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_rows(table(spark, sf_dir, "documents").select("text", "lang"))


def dedupe_column_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_row_id(table(spark, sf_dir, "documents"), "doc_id")
    return without_row_id(dedupe_column(df, "text"))


def dedupe_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_dirty(table(spark, sf_dir, "orders"), "o_orderkey", "dup_key")
    return without_row_id(dedupe_column(with_row_id(df, "o_orderkey"), "dup_key"))


def dedupe_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr(PART_TYPO).alias("label"))
    return without_row_id(dedupe_fuzzy(with_row_id(df, "p_partkey"), "label"))


def dedupe_fuzzy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_row_id(table(spark, sf_dir, "benchmark"), "item_id")
    return without_row_id(dedupe_fuzzy(df, "text"))


def _lookup_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with a third of all rows on one key, and customers with repeated keys."""
    main = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.expr("""CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '--'
            WHEN o_orderkey % 3 = 0 THEN 'Acme-7 Co.' ELSE 'Acme-' || (o_custkey % 1200) || ' Co.' END""").alias("main_key"),
    )
    lookup = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("'acme ' || (c_custkey % 1000) || ' co'").alias("look_key"),
        F.col("c_mktsegment").alias("o_orderstatus"),
    )
    return with_row_id(main, "o_orderkey"), with_row_id(lookup, "c_custkey")


def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, lookup = _lookup_sides(spark, sf_dir)
    return without_row_id(lookup_join(main, lookup, "main_key", "look_key").df)


def lookup_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, lookup = _lookup_sides(spark, sf_dir)
    counts = match_count(lookup_join(main, lookup, "main_key", "look_key").df)
    return counts.select(F.col("rows").alias("n_rows"), F.col("matched").alias("n_matched"))


def lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    main = part.select("p_partkey", F.expr(LOOKUP_TYPO).alias("label"))
    lookup = part.select(F.col("p_partkey").alias("ord"), F.expr(PART_LABEL).alias("clean_label"),
                         F.expr(PART_LABEL).alias("found"))
    joined = lookup_join(with_row_id(main, "p_partkey"), with_row_id(lookup, "ord"), "label", "clean_label", fuzzy=True)
    return joined.df.select("p_partkey", "label", "ord", "found", MATCHED)


def score_query(name: str, scorer) -> Query:
    """A similarity of a messy label and another form of it, over the whole table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = table(spark, sf_dir, "part").select("p_partkey", F.expr(PART_TYPO).alias("a"), F.expr(PART_OTHER).alias("b"))
        return pairs.select("p_partkey", F.round(scorer(F.col("a"), F.col("b")), 6).alias(name))
    return run


def _before_after(spark: SparkSession, sf_dir: str):
    raw = with_row_id(
        with_dirty(table(spark, sf_dir, "customer"), "c_custkey", "raw_null", "raw_email", "raw_phone", "n_null"), "c_custkey"
    )
    cleaned = values.fix_phones(values.fix_emails(values.sanitize(raw)))
    cleaned = cleaned.where(F.expr("c_custkey % 10 <> 3"))
    cleaned = cleaned.withColumn("n_null", F.coalesce("n_null", F.lit(0)).cast("double"))
    return compute_diff(raw, cleaned)


def diff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _before_after(spark, sf_dir).cells().withColumnRenamed(ROW_ID, "row_key")


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _before_after(spark, sf_dir).stats()


def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_row_id(_before_after(spark, sf_dir).removed(None))


def diff_removed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_row_id(_before_after(spark, sf_dir).removed())


def diff_changed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _before_after(spark, sf_dir).changed(100)
    return changed.select(F.col(ROW_ID).alias("row_key"), F.inline("changes"))


def changed_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = _before_after(spark, sf_dir)
    return number_rows(diff.changed(100), diff.raw).select("row_index", F.inline("changes"))


def removed_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = _before_after(spark, sf_dir)
    return without_row_id(number_rows(diff.removed(), diff.raw))


def diff_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = _before_after(spark, sf_dir)
    return diff.truncated(100).unionAll(diff.truncated(10**9))


def dedupe_rows_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each text and language by source and id, a key of two columns."""
    df = with_row_id(table(spark, sf_dir, "documents"), ["source", "doc_id"]).select("text", "lang", ROW_ID)
    return dedupe_rows(df).select("text", "lang", f"{ROW_ID}.source", f"{ROW_ID}.doc_id")


def preview_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_row_id(table(spark, sf_dir, "orders"), "o_orderkey")
    return without_row_id(head(df, 5))


def records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(dirty("n_null", "o_orderkey")).alias("n_null"), "o_orderstatus", "o_orderdate"
    )
    return to_records(df)


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", F.expr(dirty("n_null", "o_orderkey")).alias("n_null"),
        F.expr(dirty("raw_money", "o_orderkey")).alias("raw_money"),
    )
    folder = shared_folder(spark)
    write_table(df, folder, "csv")
    return without_row_id(read_table(spark, folder, "csv"))


def csv_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""CASE WHEN c_custkey % 7 = 0 THEN c_custkey || ',short'
        WHEN c_custkey % 3 = 0 THEN c_custkey || ',$' || c_custkey || ',500,' || c_name
        WHEN c_custkey % 5 = 0 THEN c_custkey || ',"' || c_custkey || ',000",' || c_name
        WHEN c_custkey % 11 = 0 THEN c_custkey || ',x,y,' || c_name
        ELSE c_custkey || ',' || c_custkey || 'k,' || c_name END""")
    # A plain-text file in parts, each with the header line, as a CSV export has it.
    lines = table(spark, sf_dir, "customer").select(line.alias("id,price,name"))
    folder = shared_folder(spark)
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(folder)
    return without_row_id(read_table(spark, folder, "csv"))


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean_customer(spark, sf_dir).df


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean_customer(spark, sf_dir).log()


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean_customer(spark, sf_dir, run_job).log()


def job_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean_customer(spark, sf_dir, run_job).diff().cells().withColumnRenamed(ROW_ID, "row_key")


def job_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All removed rows of the written job with their place in the input."""
    job = _clean_customer(spark, sf_dir, run_job)
    gone = job.diff().removed(None).join(job.row_numbers(), ROW_ID)
    return gone.select(F.col(ROW_ID).alias("row_key"), "row_index", F.col("Email").alias("email"), F.col("Account Id").alias("account_id"))


def _clean_customer(spark: SparkSession, sf_dir: str, job=clean):
    # Names such as Address or Location keep the amount detector off columns with digits.
    main = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_mktsegment").alias("Client Name"),
        F.expr(dirty("raw_money", "c_custkey")).alias("Total Price"),
        F.expr(dirty("raw_email", "c_custkey")).alias("Email"),
        F.expr(dirty("raw_phone", "c_custkey")).alias("Phone"),
        F.expr(dirty("raw_noise", "c_custkey")).alias("Street Note"),
        F.expr(dirty("raw_ar", "c_custkey")).alias("Address"),
        F.expr(dirty("n_null", "c_custkey")).alias("Points"),
        F.expr("'Nation ' || c_nationkey || '.'").alias("Location"),
        F.expr("'u' || (c_custkey % 1000)").alias("Account Id"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("replace(n_name, '_', ' ')").alias("Title"), F.col("n_regionkey").alias("Points"))
    config = CleaningConfig(
        standardize_columns=True, clean_arabic=True, remove_duplicates=True, dedupe_column="Account Id",
        merge_active=True, merge_key_main="Location", merge_key_sec="Title", clean_money=True, fix_phones=True,
        fix_emails=True, remove_special_chars=True, anonymize_pii=True, ignore_columns=("Cust Key",),
        fill_missing={"numeric": "zero"},
    )
    return job(main, config, nation, order_by="Cust Key", lookup_order_by="n_nationkey")


# Shapes of a date by key, as SQL that both engines read; each gives day {k} of March 2023.
DATE_SHAPES = """CASE o_orderkey % 8 WHEN 0 THEN '2023/3/' || {d} WHEN 1 THEN {d} || '.3.2023' WHEN 2 THEN {d} || '/3/23'
        WHEN 3 THEN '202303' || lpad(CAST({d} AS STRING), 2, '0') WHEN 4 THEN 'Mar ' || {d} || ', 2023'
        WHEN 5 THEN {d} || ' March 2023' WHEN 6 THEN '2023-03-' || lpad(CAST({d} AS STRING), 2, '0') || ' 14:30' ELSE 'soon' END"""
_DAY = "(13 + o_orderkey % 15)"


def parse_date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DATE_SHAPES.replace("{d}", _DAY)).alias("raw_date"))
    return df.select("o_orderkey", dates.parse_date_mixed(F.col("raw_date")).alias("parsed"))


def clean_orders(method: str) -> Query:
    """Dates, a numeric fill over gaps and NaN, whole-row duplicates: 280 kinds of rows, each many times."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").select(
            "o_orderkey", F.expr(dirty("n_null", "(o_orderkey % 280)")).alias("Amount Left"),
            F.expr("CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_orderkey % 280 END").alias("Weight"),
            F.expr("lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') || '/03/2023'").alias("Order Date"),
            F.expr("'S' || (o_orderkey % 5)").alias("State"),
        )
        keyed = with_row_id(df, "o_orderkey").drop("o_orderkey")
        config = CleaningConfig(standardize_columns=True, fix_dates=True, remove_duplicates=True, fill_missing={"numeric": method}, detect_sample="all")
        out = clean(keyed, config).df
        return out.select("order_date", "state", *[F.round(c, 6).alias(c) for c in ("amount_left", "weight")])
    return run


def clean_merge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table from a CSV file, merged by near keys, its columns left as they are."""
    nation = table(spark, sf_dir, "nation").select(F.expr("replace(n_name, '_', ' ')").alias("Title"), F.concat("n_name", F.lit(" *#")).alias("Label"))
    folder = shared_folder(spark)
    write_table(nation, folder, "csv")
    main = table(spark, sf_dir, "customer").select("c_custkey", F.expr("'Natiion-' || c_nationkey").alias("Country"), F.expr("c_mktsegment || ' *#'").alias("Segment"))
    config = CleaningConfig(merge_active=True, merge_key_main="Country", merge_key_sec="Title", merge_fuzzy=True,
                            clean_merged_columns=False, remove_special_chars=True)
    return clean(main, config, read_table(spark, folder, "csv"), order_by="c_custkey").df


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back by format; the place in the file numbers the rows."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr(dirty("n_null", "c_custkey")).cast("double").alias("n_null"))
    folder = shared_folder(spark)
    write_table(df.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey"), folder, "parquet")
    back = read_table(spark, folder, "parquet")
    return without_row_id(back.join(row_numbers(back), ROW_ID))


def entry(spark: SparkSession) -> DataFrame:
    """The whole cleaning job on the smallest tables."""
    return clean_table(spark, "/root/testdata/sf0.001")


ARABIC_PARTS = {
    "arabic_marks": text.remove_arabic_marks, "arabic_tatweel": text.remove_tatweel, "arabic_alef": text.unify_alef,
    "arabic_yeh": text.unify_yeh, "arabic_digits": text.arabic_digits_to_ascii,
}


def queries() -> dict[str, Query]:
    q = column_query
    return {
        "headers_standardised": headers_standardised,
        "null_tokens": q("customer", "c_custkey", "raw_null", "cleaned", text.sanitize_nulls),
        "drop_empty": drop_empty,
        "profile_columns": profile_columns,
        "detect_columns": detect_query("all"),
        "detect_columns_head15": detect_query("head15"),
        "parse_money": q("orders", "o_orderkey", "raw_money", "amount", text.parse_money),
        "parse_dates": parse_dates,
        "clean_phone": q("customer", "c_custkey", "raw_phone", "phone", text.clean_phone),
        "fix_email": q("customer", "c_custkey", "raw_email", "email", text.fix_email),
        "strip_noise": q("customer", "c_custkey", "raw_noise", "cleaned", text.strip_noise),
        "strip_noise_documents": strip_noise_text("documents", "doc_id", "text"),
        "strip_noise_pages": strip_noise_text("pages", "page_id", "html"),
        "normalize_arabic": q("customer", "c_custkey", "raw_ar", "cleaned", text.normalize_arabic),
        "normalize_key": lambda spark, sf: table(spark, sf, "part").select(
            "p_partkey", text.normalize_key(F.expr(PART_LABEL)).alias("join_key")),
        "mask_email": q("customer", "c_custkey", "raw_email", "masked", text.mask_email),
        "mask_phone": q("customer", "c_custkey", "raw_phone", "masked", text.mask_phone),
        "mask_name": lambda spark, sf: table(spark, sf, "customer").select(
            "c_custkey", text.mask_name(F.col("c_name")).alias("masked")),
        "fill_mean": fill_query("mean"),
        "fill_median": fill_query("median"),
        "fill_zero": fill_query("zero"),
        "dedupe_rows": dedupe_rows_query,
        "dedupe_rows_with_id": dedupe_rows_with_id,
        "dedupe_column": dedupe_column_query,
        "dedupe_hot_key": dedupe_hot_key,
        "dedupe_fuzzy_names": dedupe_fuzzy_names,
        "dedupe_fuzzy_texts": dedupe_fuzzy_texts,
        "lookup_exact": lookup_exact,
        "lookup_match_count": lookup_match_count,
        "lookup_fuzzy": lookup_fuzzy,
        "indel_ratio": score_query("ratio", similarity.indel_ratio),
        "partial_ratio": score_query("partial", similarity.partial_ratio),
        "wratio": score_query("score", similarity.wratio),
        "diff_cells": diff_cells,
        "diff_stats": diff_stats,
        "diff_removed": diff_removed,
        "diff_removed_topk": diff_removed_topk,
        "diff_changed_topk": diff_changed_topk,
        "changed_with_index": changed_with_index,
        "removed_with_index": removed_with_index,
        "diff_truncated": diff_truncated,
        "preview_topk": preview_topk,
        "records_json": records_json,
        "csv_scan": csv_scan,
        "csv_repair": csv_repair,
        "parse_date_shapes": parse_date_shapes,
        **{name: q("customer", "c_custkey", "raw_ar", "cleaned", fn) for name, fn in ARABIC_PARTS.items()},
        "clean_fill_mean": clean_orders("mean"),
        "clean_fill_median": clean_orders("median"),
        "clean_merge_raw": clean_merge_raw,
        "parquet_round_trip": parquet_round_trip,
        "clean_table": clean_table,
        "clean_log": clean_log,
        "job_log": job_log,
        "job_diff": job_diff,
        "job_removed": job_removed,
        **({"pipeline": corpus_pipeline.run, **llm.QUERIES} if llm else {}),
    }


# White space of any script, as DuckDB's regular expressions spell it.
_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# SQL of the scalar functions; ``{c}`` stands for the column.
_NULL_SQL = r"""CASE WHEN NOT regexp_matches({c}, '(?i)^\s*["'']?(nan|null|none|""|)\s*$') THEN trim({c}) END"""
_MONEY_SQL = """(try_cast(regexp_replace(lower(trim({c})), '[^0-9.-]', '', 'g') AS DOUBLE)
    * CASE right(lower(trim({c})), 1) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1e0 END)"""
_PHONE_SQL = """CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 3
    THEN CASE WHEN trim({c}) LIKE '+%' OR trim({c}) LIKE '(+%' THEN '+' ELSE '' END
    || regexp_replace({c}, '[^0-9]', '', 'g') END"""
_EMAIL_SQL = r"""CASE WHEN regexp_matches(replace(lower(trim({c})), '@@', '@'), '^[^@\s]+@[^@\s]+\.[^@\s]{2,}$')
    THEN replace(lower(trim({c})), '@@', '@') END"""
_NOISE_SQL = r"""CASE WHEN regexp_matches({c}, '(?s)^[WS]*(\{.*\}|\[.*\])[WS]*$') THEN {c}
    ELSE regexp_replace(regexp_replace({c}, '[^\p{L}\p{N}_WS.\-@:/()&]', '', 'g'), '^[WS]+|[WS]+$', '', 'g') END""".replace("WS", _WS)
_ARABIC_SQL = r"""trim(translate(regexp_replace({c}, '[\x{064B}-\x{065F}\x{0670}\x{0640}]', '', 'g'),
    'أإآى٠١٢٣٤٥٦٧٨٩', 'اااي0123456789'))"""
_KEY_SQL = r"regexp_replace(lower({c}), '[^\p{L}\p{N}_]', '', 'g')"
_MASK_EMAIL_SQL = """CASE WHEN instr(trim({c}), '@') > 2 THEN left(trim({c}), 1) || '****' || substr(trim({c}), instr(trim({c}), '@'))
    WHEN instr(trim({c}), '@') > 0 THEN '*' || substr(trim({c}), instr(trim({c}), '@')) ELSE trim({c}) END"""
_MASK_PHONE_SQL = """CASE WHEN length(trim({c})) > 4 THEN repeat('*', length(trim({c})) - 4) || right(trim({c}), 4)
    ELSE repeat('*', length(trim({c}))) END"""
_MASK_NAME_SQL = "CASE WHEN length(trim({c})) > 1 THEN left(trim({c}), 1) || '****' ELSE '*' END"


def _on(template: str, column: str) -> str:
    return template.replace("{c}", column)


def _column_sql(source: str, key: str, name: str, out: str, template: str) -> str:
    return f"""WITH t AS (SELECT {key}, {dirty(name, key)} AS v FROM {source})
        SELECT {key}, {_on(template, "v")} AS {out} FROM t"""


_DATED_SQL = """SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
        WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN o_orderkey % 4 = 2 AND day(o_orderdate) > 12 THEN strftime(o_orderdate, '%m-%d-%Y')
        WHEN o_orderkey % 4 = 2 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate)
        ELSE 'bad' END AS raw_date FROM orders"""


def _detect_sql(first: int | None = None) -> str:
    columns = ["o_orderkey", "o_orderdate", "o_orderpriority", "raw_date", "raw_money", "sparse", "head_only", "tail_only"]
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", v FROM (SELECT CAST({c} AS VARCHAR) AS v,
            row_number() OVER (ORDER BY o_orderkey) AS rn FROM d WHERE {c} IS NOT NULL) {f"WHERE rn <= {first}" if first else ""}"""
        for c in columns
    )
    return f"""WITH d AS (SELECT o_orderkey, o_orderdate, o_orderpriority, raw_date,
            {dirty("raw_money", "o_orderkey")} AS raw_money,
            CASE WHEN o_orderkey % 100 = 99 THEN '12k' END AS sparse,
            CASE WHEN o_orderkey < 40 THEN '$' || o_orderkey || '00' ELSE 'none' END AS head_only,
            CASE WHEN o_orderkey < 40 THEN 'later' ELSE '2024-05-' || (10 + o_orderkey % 18) END AS tail_only FROM ({_DATED_SQL})),
        s AS ({parts}),
        g AS (SELECT "column", count(*) AS sampled,
            count(*) FILTER (regexp_matches(v, '[0-9]{{2,4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}')) AS date_hits,
            count(*) FILTER (regexp_matches(v, '[$€£]|[0-9]') AND regexp_matches(lower(v), '[0-9$€£][0-9,.kmb]+')) AS money_hits
            FROM s GROUP BY "column")
        SELECT *, date_hits * 10 >= sampled * 3 AS date_like, money_hits * 10 >= sampled * 3 AS money_like FROM g"""


def _profile_sql() -> str:
    kinds = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
             "value": "double", "props": "string", "n_null": "bigint", "raw_ar": "string"}
    parts = " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) AS "rows",
            count(*) FILTER ({c} IS NULL) AS missing,
            {f"bool_or(regexp_matches({c}, '[؀-ۿ]'))" if t == "string" else "false"} AS has_arabic,
            {"true" if "id" in c else "false"} AS suggest_ignore FROM e"""
        for i, (c, t) in enumerate(kinds.items(), 1)
    )
    return f"""WITH e AS (SELECT *, {dirty("n_null", "user_id")} AS n_null, {dirty("raw_ar", "event_id")} AS raw_ar
        FROM events) {parts}"""


def _fill_sql(value: str) -> str:
    return f"""WITH t AS (SELECT o_orderkey, {dirty("n_null", "o_orderkey")} AS n_null,
            CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS m_null FROM orders),
        f AS (SELECT {_on(value, "n_null")} AS n_fill, {_on(value, "m_null")} AS m_fill FROM t)
        SELECT o_orderkey, round(coalesce(CAST(n_null AS DOUBLE), n_fill), 6) AS n_null,
            round(coalesce(CAST(m_null AS DOUBLE), m_fill), 6) AS m_null FROM t, f"""


_LOOKUP_SQL = """WITH m AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderkey % 13 = 0 THEN '--' WHEN o_orderkey % 3 = 0 THEN 'Acme-7 Co.'
            ELSE 'Acme-' || (o_custkey % 1200) || ' Co.' END AS main_key FROM orders),
        l AS (SELECT c_custkey, c_mktsegment, 'acme' || (c_custkey % 1000) || 'co' AS k,
            row_number() OVER (PARTITION BY c_custkey % 1000 ORDER BY c_custkey) AS rn FROM customer),
        j AS (SELECT m.*, l.c_custkey, l.c_mktsegment AS o_orderstatus_lookup, l.k IS NOT NULL AS _matched
            FROM m LEFT JOIN l ON l.rn = 1 AND l.k = regexp_replace(lower(m.main_key), '[^a-z0-9]', '', 'g')) """

_DIFF_SQL = f"""WITH r AS (SELECT c_custkey, {dirty("raw_null", "c_custkey")} AS raw_null, {dirty("raw_email", "c_custkey")} AS raw_email,
            {dirty("raw_phone", "c_custkey")} AS raw_phone, {dirty("n_null", "c_custkey")} AS n_null FROM customer),
        c AS (SELECT c_custkey, {_on(_NULL_SQL, "raw_null")} AS raw_null, {_on(_EMAIL_SQL, "raw_email")} AS raw_email,
            {_on(_PHONE_SQL, "raw_phone")} AS raw_phone, coalesce(n_null, 0) AS n_null FROM r WHERE c_custkey % 10 <> 3),
        p AS (SELECT r.c_custkey AS row_key, unnest([
                {{'col': 'raw_null', 'before': r.raw_null, 'after': c.raw_null}},
                {{'col': 'raw_email', 'before': r.raw_email, 'after': c.raw_email}},
                {{'col': 'raw_phone', 'before': r.raw_phone, 'after': c.raw_phone}},
                {{'col': 'n_null', 'before': CAST(r.n_null AS VARCHAR), 'after': CASE WHEN c.n_null IS NOT DISTINCT FROM r.n_null
                    THEN CAST(r.n_null AS VARCHAR) ELSE c.n_null || '.0' END}}
            ]) AS x FROM r JOIN c USING (c_custkey)),
        d AS (SELECT row_key, x.col AS col, x.before AS "before", x.after AS "after" FROM p
            WHERE nullif(trim(x.before), '') IS DISTINCT FROM nullif(trim(x.after), '')) """

_CSV_REPAIR_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
        CASE WHEN c_custkey % 3 = 0 THEN '$' || c_custkey || ',500' WHEN c_custkey % 5 = 0 THEN c_custkey || ',000'
            ELSE c_custkey || 'k' END AS price FROM customer
        WHERE c_custkey % 7 <> 0 AND NOT (c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 = 0)"""

_NOISE_ONLY_SQL = "regexp_replace({c}, '[*^#?]', '', 'g')"
_CLEAN_SQL = f"""WITH m AS (SELECT c_custkey AS k, c_mktsegment, 'u' || (c_custkey % 1000) AS account,
            {dirty("raw_money", "c_custkey")} AS money, {dirty("raw_email", "c_custkey")} AS email,
            {dirty("raw_phone", "c_custkey")} AS phone, {dirty("raw_noise", "c_custkey")} AS note,
            {dirty("raw_ar", "c_custkey")} AS ar, {dirty("n_null", "c_custkey")} AS points,
            'Nation ' || c_nationkey AS country, c_nationkey FROM customer),
        j AS (SELECT m.*, n.n_nationkey, n.n_regionkey, n.n_nationkey IS NOT NULL AS hit,
            row_number() OVER (PARTITION BY account ORDER BY k) AS rn
            FROM m LEFT JOIN nation n ON 'nation' || m.c_nationkey = replace(lower(n.n_name), '_', '')) """


def _clean_sql() -> str:
    email, phone = _on(_EMAIL_SQL, "email"), _on(_PHONE_SQL, "phone")
    # Removing noise deletes the "+" of a phone number and the Arabic marks.
    phone = f"replace({phone}, '+', '')"
    note = f"CASE WHEN note LIKE '{{%}}' THEN note ELSE {_on(_NOISE_ONLY_SQL, 'note')} END"
    return f"""{_CLEAN_SQL} SELECT k AS cust_key, left(c_mktsegment, 1) || '****' AS client_name,
        coalesce({_on(_MONEY_SQL, "money")}, 0) AS total_price,
        {_on(_MASK_EMAIL_SQL, f"({email})")} AS email, {_on(_MASK_PHONE_SQL, f"({phone})")} AS phone,
        {note} AS street_note, {_on(_ARABIC_SQL, "ar")} AS address,
        coalesce(points, 0) AS points, country || '.' AS location, account AS account_id,
        coalesce(n_nationkey, 0) AS n_nationkey, coalesce(n_regionkey, 0) AS points_lookup
        FROM j WHERE rn = 1"""


def _lcs_sql(p: str) -> str:
    """The length ``n`` of the longest common subsequence of the texts ``x`` and ``y`` in the table ``todo``, for
    texts of at most 120 letters: one bit per letter of ``x``, one step of the recursion per letter of ``y``."""
    return f"""{p}masks AS MATERIALIZED (SELECT x, substr(x, i, 1) AS c, sum(CAST(1 AS HUGEINT) << CAST(i - 1 AS INT)) AS m
            FROM (SELECT x, unnest(generate_series(1, length(x))) AS i FROM (SELECT DISTINCT x FROM {p}todo)) GROUP BY ALL),
        {p}walk AS (SELECT x, y, 0 AS i, (CAST(1 AS HUGEINT) << length(x)) - 1 AS r FROM {p}todo
            UNION ALL SELECT w.x, w.y, w.i + 1, ((w.r + (w.r & coalesce(m, 0))) | (w.r - (w.r & coalesce(m, 0)))) & ((CAST(1 AS HUGEINT) << length(w.x)) - 1)
            FROM {p}walk w LEFT JOIN {p}masks k ON k.x = w.x AND k.c = substr(w.y, w.i + 1, 1) WHERE w.i < length(w.y)),
        {p}lcs AS MATERIALIZED (SELECT x, y, length(x) - bit_count(r) AS n FROM {p}walk WHERE i = length(y))"""


# The score at its cutoff of 90 in whole numbers, then the scan over the values in order.
_FUZZY_NAMES_SQL = f"""WITH RECURSIVE v AS (SELECT min(p_partkey) AS id, {PART_TYPO} AS t FROM part GROUP BY t),
        w AS (SELECT id, t, list_sort(list_filter(string_split_regex(t, '[{_WS}]+'), lambda s: s <> '')) AS s FROM v),
        o AS (SELECT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb, a.s AS la, b.s AS lb, array_to_string(a.s, ' ') AS sa, array_to_string(b.s, ' ') AS sb
            FROM w a JOIN w b ON a.id > b.id AND 2 * greatest(length(a.t), length(b.t)) < 3 * least(length(a.t), length(b.t))),
        p AS MATERIALIZED (SELECT *, array_to_string(list_sort(list_filter(list_distinct(la), lambda x: list_contains(lb, x))), ' ') AS shared,
            array_to_string(list_sort(list_filter(list_distinct(la), lambda x: NOT list_contains(lb, x))), ' ') AS da,
            array_to_string(list_sort(list_filter(list_distinct(lb), lambda x: NOT list_contains(la, x))), ' ') AS db
            FROM o WHERE list_has_any(la, lb) OR levenshtein(ta, tb) <= (length(ta) + length(tb)) // 10 OR levenshtein(sa, sb) <= (length(sa) + length(sb)) // 19
                OR len(list_distinct(la)) < len(la) OR len(list_distinct(lb)) < len(lb)),
        q AS (SELECT *, 2 * length(shared) + CASE WHEN shared <> '' THEN 2 ELSE 0 END + length(da) + length(db) AS total FROM p),
        ways AS (SELECT a, b, ta AS x, tb AS y, (length(ta) + length(tb)) // 10 AS allowed FROM p
            UNION ALL SELECT a, b, sa, sb, (length(sa) + length(sb)) // 19 FROM p
            UNION ALL SELECT a, b, da, db, total // 19 FROM q WHERE da <> '' AND db <> ''),
        near AS MATERIALIZED (SELECT * FROM ways WHERE abs(length(x) - length(y)) <= allowed AND levenshtein(x, y) <= allowed),
        todo AS MATERIALIZED (SELECT DISTINCT x, y FROM near), {_lcs_sql("")},
        edges AS (SELECT a, b FROM near JOIN lcs USING (x, y) WHERE length(x) + length(y) - 2 * n <= allowed
            UNION SELECT a, b FROM q WHERE shared <> '' AND (da = '' OR db = '' OR 9 * (1 + least(length(da), length(db))) <= length(shared))
            UNION SELECT a.id, b.id FROM v a JOIN v b ON a.id > b.id AND 2 * greatest(length(a.t), length(b.t)) >= 3 * least(length(a.t), length(b.t))
                AND greatest(length(a.t), length(b.t)) <= 8 * least(length(a.t), length(b.t)) AND (contains(a.t, b.t) OR contains(b.t, a.t))),
        n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS place, coalesce(list(b), []) AS earlier FROM v LEFT JOIN edges ON a = id GROUP BY id),
        scan AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept
            UNION ALL SELECT n.place, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, id) END FROM scan JOIN n ON n.place = scan.place + 1)
        SELECT id AS p_partkey, t AS label FROM v WHERE list_contains((SELECT kept FROM scan ORDER BY place DESC LIMIT 1), id)"""

# Exact keys first; for the others the best score of at least 75 over all lookup keys, the earliest of equal ones.
_FUZZY_LOOKUP_SQL = f"""WITH RECURSIVE m AS (SELECT p_partkey, {LOOKUP_TYPO} AS label, {_on(_KEY_SQL, f"({LOOKUP_TYPO})")} AS k FROM part),
        l AS (SELECT min(p_partkey) AS ord, {_on(_KEY_SQL, f"({PART_LABEL})")} AS k FROM part GROUP BY k),
        o AS MATERIALIZED (SELECT DISTINCT k FROM m WHERE k <> '' AND k NOT IN (SELECT k FROM l)),
        pairs AS (SELECT o.k AS a, l.k AS b, ord, CASE WHEN length(o.k) <= length(l.k) THEN o.k ELSE l.k END AS short,
            CASE WHEN length(o.k) <= length(l.k) THEN l.k ELSE o.k END AS long FROM o, l),
        near AS MATERIALIZED (SELECT a, b, ord, length(a) + length(b) AS total FROM pairs WHERE levenshtein(a, b) <= (length(a) + length(b)) // 4),
        r_todo AS MATERIALIZED (SELECT DISTINCT a AS x, b AS y FROM near), {_lcs_sql("r_")},
        far AS MATERIALIZED (SELECT * FROM pairs WHERE 2 * length(long) >= 3 * length(short) AND length(long) <= 8 * length(short)),
        f_todo AS MATERIALIZED (SELECT DISTINCT short AS x, long AS y FROM far), {_lcs_sql("f_")},
        starts AS (SELECT x, y, unnest(generate_series(2 - length(x), length(y))) AS i FROM f_lcs WHERE 7 * n >= 5 * length(x)),
        windows AS MATERIALIZED (SELECT x AS short, y AS long, substr(y, greatest(i, 1), i + length(x) - greatest(i, 1)) AS w FROM starts),
        w_todo AS MATERIALIZED (SELECT DISTINCT short AS x, w AS y FROM windows), {_lcs_sql("w_")},
        best AS (SELECT short, long, max(1 - (length(x) + length(y) - 2 * n) / (length(x) + length(y))) * 100 * 0.9 AS score
            FROM windows JOIN w_lcs ON x = short AND y = w GROUP BY short, long),
        scored AS (SELECT a, ord, (1 - (total - 2 * n) / total) * 100 AS score FROM near JOIN r_lcs ON x = a AND y = b WHERE total - 2 * n <= total // 4
            UNION ALL SELECT a, ord, score FROM far JOIN best USING (short, long) WHERE score >= 75 - 1e-9),
        found AS (SELECT a AS k, ord FROM scored QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, ord) = 1
            UNION ALL SELECT k, ord FROM l)
        SELECT m.p_partkey, m.label, f.ord, p.p_name || ' ' || p.p_brand AS found, f.ord IS NOT NULL AS _matched
        FROM m LEFT JOIN found f USING (k) LEFT JOIN part p ON p.p_partkey = f.ord"""


def _windows_sql(p: str) -> str:
    """The best ratio ``best`` of the shorter of the texts ``x`` and ``y`` in the table ``far`` against windows of the longer."""
    return f"""{p}sides AS (SELECT DISTINCT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS short,
            CASE WHEN length(x) <= length(y) THEN y ELSE x END AS long FROM {p}far),
        {p}starts AS (SELECT short, long, unnest(generate_series(2 - length(short), length(long))) AS i FROM (SELECT DISTINCT short, long FROM {p}sides)),
        {p}windows AS MATERIALIZED (SELECT short, long, substr(long, greatest(i, 1), i + length(short) - greatest(i, 1)) AS w FROM {p}starts),
        {p}todo AS MATERIALIZED (SELECT DISTINCT short AS x, w AS y FROM {p}windows), {_lcs_sql(p)},
        {p}bests AS (SELECT short, long, max((1 - (length(x) + length(y) - 2 * n) / (length(x) + length(y))) * 100) AS best
            FROM {p}windows JOIN {p}lcs ON x = short AND y = w GROUP BY short, long),
        {p}partial AS MATERIALIZED (SELECT x, y, best FROM {p}sides JOIN {p}bests USING (short, long))"""


_PAIRS_SQL = f"WITH RECURSIVE t AS (SELECT p_partkey, {PART_TYPO} AS a, {PART_OTHER} AS b FROM part)"
_INDEL_SQL = f"""{_PAIRS_SQL}, todo AS MATERIALIZED (SELECT DISTINCT a AS x, b AS y FROM t), {_lcs_sql("")}
        SELECT p_partkey, round((1 - (length(a) + length(b) - 2 * n) / (length(a) + length(b))) * 100, 6) AS ratio FROM t JOIN lcs ON x = a AND y = b"""
_PARTIAL_SQL = f"""{_PAIRS_SQL}, far AS MATERIALIZED (SELECT DISTINCT a AS x, b AS y FROM t), {_windows_sql("")}
        SELECT p_partkey, round(best, 6) AS partial FROM t JOIN partial ON x = a AND y = b"""


def _wratio_sql() -> str:
    def words(column: str) -> str:
        return f"list_sort(list_filter(string_split_regex({column}, '[{_WS}]+'), lambda s: s <> ''))"

    def apart(x: str, y: str) -> str:
        return f"array_to_string(list_sort(list_filter(list_distinct({x}), lambda w: NOT list_contains({y}, w))), ' ')"

    return f"""{_PAIRS_SQL},
        w AS (SELECT *, {words("a")} AS la, {words("b")} AS lb, 2 * greatest(length(a), length(b)) >= 3 * least(length(a), length(b)) AS wide,
            CASE WHEN greatest(length(a), length(b)) <= 8 * least(length(a), length(b)) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale FROM t),
        v AS MATERIALIZED (SELECT *, array_to_string(la, ' ') AS ta, array_to_string(lb, ' ') AS tb, {apart("la", "lb")} AS da, {apart("lb", "la")} AS db,
            length(array_to_string(list_filter(list_distinct(la), lambda w: list_contains(lb, w)), ' ')) AS shared FROM w),
        todo AS MATERIALIZED (SELECT a AS x, b AS y FROM v UNION SELECT ta, tb FROM v WHERE NOT wide UNION SELECT da, db FROM v WHERE NOT wide), {_lcs_sql("")},
        f_far AS MATERIALIZED (SELECT a AS x, b AS y FROM v WHERE wide UNION SELECT ta, tb FROM v WHERE wide AND shared = 0
            UNION SELECT da, db FROM v WHERE wide AND shared = 0), {_windows_sql("f_")},
        r AS (SELECT x, y, (1 - (length(x) + length(y) - 2 * n) / greatest(length(x) + length(y), 1)) * 100 AS ratio FROM lcs),
        u AS (SELECT v.*, shared + least(shared, 1) + length(da) AS na, shared + least(shared, 1) + length(db) AS nb,
            ab.ratio AS ratio, tt.ratio AS sorted, dd.n AS common, p.best AS inner_best, pt.best AS sorted_best, pd.best AS rest_best
            FROM v JOIN r ab ON ab.x = a AND ab.y = b LEFT JOIN r tt ON tt.x = ta AND tt.y = tb LEFT JOIN lcs dd ON dd.x = da AND dd.y = db
            LEFT JOIN f_partial p ON p.x = a AND p.y = b LEFT JOIN f_partial pt ON pt.x = ta AND pt.y = tb LEFT JOIN f_partial pd ON pd.x = da AND pd.y = db)
        SELECT p_partkey, round(CASE WHEN wide THEN greatest(ratio, scale * inner_best,
                0.95::DOUBLE * scale * CASE WHEN shared > 0 THEN 100 ELSE greatest(sorted_best, rest_best) END)
            ELSE greatest(ratio, 0.95::DOUBLE * sorted, 0.95::DOUBLE * CASE WHEN shared > 0 AND (da = '' OR db = '') THEN 100
                ELSE greatest((1 - (length(da) + length(db) - 2 * common) / (na + nb)) * 100,
                    CASE WHEN shared > 0 THEN (1 - (1 + length(da)) / (shared + na)) * 100 ELSE 0 END,
                    CASE WHEN shared > 0 THEN (1 - (1 + length(db)) / (shared + nb)) * 100 ELSE 0 END) END) END, 6) AS score FROM u"""


def _clean_orders_sql(fill: str) -> str:
    return f"""WITH t AS (SELECT {dirty("n_null", "(o_orderkey % 280)")} AS a, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 280 AS DOUBLE) END AS w,
            make_timestamp(2023, 3, 1 + o_orderkey % 28, 0, 0, 0.0) AS order_date, 'S' || (o_orderkey % 5) AS state FROM orders),
        f AS (SELECT {fill}(a) AS fa, {fill}(w) AS fw FROM t)
        SELECT DISTINCT order_date, state, round(coalesce(CAST(a AS DOUBLE), fa), 6) AS amount_left, round(coalesce(w, fw), 6) AS weight FROM t, f"""


def _job_diff_sql() -> str:
    """Cells of the cleaning job that changed: raw text beside cleaned text."""
    cells = {
        "client_name": ("c_mktsegment", "client_name"), "total_price": ("money", "CAST(total_price AS VARCHAR)"),
        "email": ("j.email", "t.email"), "phone": ("j.phone", "t.phone"), "street_note": ("note", "street_note"),
        "address": ("ar", "address"), "points": ("CAST(j.points AS VARCHAR)", "CAST(t.points AS VARCHAR)"),
    }
    values = ", ".join(f"{{'col': '{c}', 'before': {b}, 'after': {a}}}" for c, (b, a) in cells.items())
    return f"""WITH t AS ({_clean_sql()}), {_CLEAN_SQL.removeprefix("WITH ")},
        p AS (SELECT k AS row_key, unnest([{values}]) AS x FROM j JOIN t ON t.cust_key = j.k)
        SELECT row_key, x.col AS col, x.before AS "before", x.after AS "after" FROM p
        WHERE nullif(trim(x.before), '') IS DISTINCT FROM nullif(trim(x.after), '')"""


def oracle_sql() -> dict[str, str]:
    s = _column_sql
    return {
        "headers_standardised": """SELECT c_custkey AS cust_key, c_name AS name_full, c_nationkey AS nation_key,
            c_acctbal AS acct___bal, c_mktsegment AS segment FROM customer""",
        "null_tokens": s("customer", "c_custkey", "raw_null", "cleaned", _NULL_SQL),
        "drop_empty": f"""WITH t AS (SELECT {_on(_NULL_SQL, "v")} AS raw_null, n_null FROM
            (SELECT {dirty("raw_null", "o_orderkey")} AS v, {dirty("n_null", "o_orderkey")} AS n_null FROM orders))
            SELECT * FROM t WHERE raw_null IS NOT NULL OR n_null IS NOT NULL""",
        "profile_columns": _profile_sql(),
        "detect_columns": _detect_sql(),
        "detect_columns_head15": _detect_sql(15),
        "parse_money": s("orders", "o_orderkey", "raw_money", "amount", _MONEY_SQL),
        "parse_dates": f"""SELECT o_orderkey, coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%d/%m/%Y'),
            try_strptime(raw_date, '%d-%m-%Y'), try_strptime(raw_date, '%m-%d-%Y')) AS parsed FROM ({_DATED_SQL})""",
        "clean_phone": s("customer", "c_custkey", "raw_phone", "phone", _PHONE_SQL),
        "fix_email": s("customer", "c_custkey", "raw_email", "email", _EMAIL_SQL),
        "strip_noise": s("customer", "c_custkey", "raw_noise", "cleaned", _NOISE_SQL),
        "strip_noise_documents": f"SELECT doc_id, {_on(_NOISE_SQL, 'text')} AS cleaned FROM documents",
        "strip_noise_pages": f"SELECT page_id, {_on(_NOISE_SQL, 'html')} AS cleaned FROM pages",
        "normalize_arabic": s("customer", "c_custkey", "raw_ar", "cleaned", _ARABIC_SQL),
        "normalize_key": f"SELECT p_partkey, {_on(_KEY_SQL, f'({PART_LABEL})')} AS join_key FROM part",
        "mask_email": s("customer", "c_custkey", "raw_email", "masked", _MASK_EMAIL_SQL),
        "mask_phone": s("customer", "c_custkey", "raw_phone", "masked", _MASK_PHONE_SQL),
        "mask_name": f"SELECT c_custkey, {_on(_MASK_NAME_SQL, 'c_name')} AS masked FROM customer",
        "fill_mean": _fill_sql("avg({c})"),
        "fill_median": _fill_sql("median({c})"),
        "fill_zero": _fill_sql("min(0)"),
        "dedupe_rows": "SELECT DISTINCT text, lang FROM documents",
        "dedupe_rows_with_id": """SELECT text, lang, source, doc_id FROM (SELECT *,
            row_number() OVER (PARTITION BY text, lang ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""",
        "dedupe_column": """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *,
            row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
        "dedupe_hot_key": f"""SELECT o_orderkey, dup_key FROM (SELECT *, row_number() OVER (PARTITION BY dup_key ORDER BY o_orderkey) AS rn
            FROM (SELECT o_orderkey, {dirty("dup_key", "o_orderkey")} AS dup_key FROM orders)) WHERE rn = 1""",
        "indel_ratio": _INDEL_SQL,
        "partial_ratio": _PARTIAL_SQL,
        "wratio": _wratio_sql(),
        "dedupe_fuzzy_names": _FUZZY_NAMES_SQL,
        "lookup_fuzzy": _FUZZY_LOOKUP_SQL,
        "lookup_exact": _LOOKUP_SQL + "SELECT o_orderkey, o_orderstatus, main_key, c_custkey, o_orderstatus_lookup, _matched FROM j",
        "lookup_match_count": _LOOKUP_SQL + "SELECT count(*) AS n_rows, count(*) FILTER (_matched) AS n_matched FROM j",
        "diff_cells": _DIFF_SQL + 'SELECT * FROM d',
        "diff_stats": _DIFF_SQL + """SELECT (SELECT count(*) FROM r) AS total_original, (SELECT count(*) FROM c) AS total_cleaned,
            (SELECT count(*) FROM r ANTI JOIN c USING (c_custkey)) AS removed_count, (SELECT count(DISTINCT row_key) FROM d) AS changed_count""",
        "diff_removed": _DIFF_SQL + "SELECT * FROM r ANTI JOIN c USING (c_custkey)",
        "diff_removed_topk": _DIFF_SQL + "SELECT * FROM r ANTI JOIN c USING (c_custkey) ORDER BY c_custkey LIMIT 20",
        "diff_changed_topk": _DIFF_SQL + """SELECT * FROM d WHERE row_key IN
            (SELECT row_key FROM d GROUP BY row_key ORDER BY row_key LIMIT 100)""",
        "changed_with_index": _DIFF_SQL + """, i AS (SELECT c_custkey AS row_key, row_number() OVER (ORDER BY c_custkey) AS row_index FROM r)
            SELECT row_index, col, "before", "after" FROM d JOIN i USING (row_key) WHERE row_key IN
            (SELECT row_key FROM d GROUP BY row_key ORDER BY row_key LIMIT 100)""",
        "removed_with_index": _DIFF_SQL + """, i AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row_index FROM r)
            SELECT * FROM i ANTI JOIN c USING (c_custkey) ORDER BY c_custkey LIMIT 20""",
        "diff_truncated": _DIFF_SQL + """SELECT count(DISTINCT row_key) > k AS truncated FROM d, (VALUES (100), (1000000000)) AS t(k) GROUP BY k""",
        "preview_topk": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
        "records_json": f"""SELECT '{{"o_orderkey":' || o_orderkey || ',"n_null":' || coalesce(CAST({dirty("n_null", "o_orderkey")} AS VARCHAR), 'null')
            || ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}}' AS record FROM orders""",
        "csv_scan": f"""SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
            {dirty("n_null", "o_orderkey")} AS n_null, nullif({dirty("raw_money", "o_orderkey")}, 'n/a') AS raw_money FROM orders""",
        "csv_repair": _CSV_REPAIR_SQL,
        "parse_date_shapes": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 6 THEN make_timestamp(2023, 3, {_DAY}, 0, 0, 0.0)
            WHEN o_orderkey % 8 = 6 THEN make_timestamp(2023, 3, {_DAY}, 14, 30, 0.0) END AS parsed FROM orders""",
        "arabic_marks": s("customer", "c_custkey", "raw_ar", "cleaned", r"regexp_replace({c}, '[\x{064B}-\x{065F}\x{0670}]', '', 'g')"),
        "arabic_tatweel": s("customer", "c_custkey", "raw_ar", "cleaned", "replace({c}, chr(1600), '')"),
        "arabic_alef": s("customer", "c_custkey", "raw_ar", "cleaned", "translate({c}, 'أإآ', 'ااا')"),
        "arabic_yeh": s("customer", "c_custkey", "raw_ar", "cleaned", "translate({c}, 'ى', 'ي')"),
        "arabic_digits": s("customer", "c_custkey", "raw_ar", "cleaned", "translate({c}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"),
        "clean_fill_mean": _clean_orders_sql("avg"),
        "clean_fill_median": _clean_orders_sql("median"),
        "clean_merge_raw": """SELECT c_custkey, 'Natiion-' || c_nationkey AS "Country", trim(c_mktsegment || ' ') AS "Segment", n_name || ' *#' AS "Label"
            FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        "parquet_round_trip": f"""SELECT c_custkey, c_name, CAST({dirty("n_null", "c_custkey")} AS DOUBLE) AS n_null,
            row_number() OVER (ORDER BY c_custkey) AS row_index FROM customer""",
        "clean_table": _clean_sql(),
        **dict.fromkeys(("clean_log", "job_log"), _CLEAN_SQL + """SELECT CAST(step AS INT) AS step, action, CAST(n AS BIGINT) AS n FROM (
            SELECT 0 AS step, 'merged' AS action, count(*) FILTER (hit) AS n FROM j
            UNION ALL SELECT 2, 'renamed', 1 UNION ALL SELECT 5, 'money', 1
            UNION ALL SELECT 6, 'duplicates', count(*) FILTER (rn > 1) FROM j
            UNION ALL SELECT 7, 'masked', 3) WHERE n > 0 OR action = 'merged'"""),
        "job_diff": _job_diff_sql(),
        "job_removed": _CLEAN_SQL + """SELECT k AS row_key, row_number() OVER (ORDER BY k) AS row_index, email, account AS account_id
            FROM j QUALIFY rn > 1""",
        **(llm.ORACLE_SQL if llm else {}),
    }
