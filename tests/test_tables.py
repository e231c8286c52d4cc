"""CSV repair, lookup join, diff and the whole cleaning job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewash import CleaningConfig, clean, cleaned_path, compute_diff, lookup_join, read_table, write_table
from tablewash.operators.diff import number_rows
from tablewash.operators.fill import fill_numeric
from tablewash.operators.lookup import match_count
from tablewash.operators.ordering import with_row_id, without_row_id
from tablewash.sources.csv import field_count


def rows(df, order=None):
    return [tuple(r) for r in (df.orderBy(order) if order else df).collect()]


@pytest.fixture
def csv_file(tmp_path):
    def write(text, name="t.csv"):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)
    return write


def test_csv_types(spark, csv_file):
    path = csv_file(
        "\ufeffid,name,ok,x,x,v,long\n1,NA,True,1.5,a,,123456789012345678901\n2,\"b, c\",false,2,,n/a,5\n 3 ,\"q\"\"t\",TRUE,1e3,z,,\n"
    )
    df = read_table(spark, path)
    assert df.dtypes[:7] == [
        ("id", "bigint"), ("name", "string"), ("ok", "boolean"), ("x", "double"), ("x.1", "string"),
        ("v", "double"), ("long", "string"),
    ]
    assert rows(without_row_id(df.orderBy("_rid"))) == [
        (1, None, True, 1.5, "a", None, "123456789012345678901"), (2, "b, c", False, 2.0, None, None, "5"),
        (3, 'q"t', True, 1000.0, "z", None, None),
    ]


def test_csv_short_rows_are_padded(spark, csv_file):
    assert rows(without_row_id(read_table(spark, csv_file("a,b\n1,2\n3\n\n4,5\n")).orderBy("_rid"))) == [
        (1, 2), (3, None), (4, 5)
    ]


def test_csv_repair(spark, csv_file):
    path = csv_file(
        "id,price,note\n1,$3,500,a\n2,\"4,5\",b\n3,x,y,z\n4,7\n5,1,2,3,4\n\n6,€ 9,000,\"q,r\"\n7,,\n8,a,12,5\n"
    )
    df = read_table(spark, path)
    assert {t for _, t in df.dtypes[:3]} == {"string"}
    # Line 1 splits "1,$3" only at "$3,500"; line 8 joins "12,5".
    assert rows(without_row_id(df.orderBy("_rid"))) == [
        ("1", "$3,500", "a"), ("2", "4,5", "b"), ("6", "€ 9,000", "q,r"), ("7", "", ""), ("8", "a", "12,5"),
    ]


def test_repair_joins_the_first_pair(spark, csv_file):  # V1: an over-long first row is repaired too
    path = csv_file("id,price\n1,2,3\n")
    assert rows(without_row_id(read_table(spark, path))) == [("1,2", "3")]


def test_field_count(spark):
    lines = ["a,b", '"a,b",c', 'a"b,c', '"x""y,",z', "", ",", '"open,x']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(field_count(F.col("v"))).collect()] == [2, 2, 2, 2, 1, 2, 1]


def test_format_dispatch(spark, tmp_path, csv_file):
    with pytest.raises(ValueError, match="spreadsheets"):
        read_table(spark, "a.xlsx")
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, "a.txt")
    assert cleaned_path("/d/sales.csv") == "/d/sales_cleaned.csv"
    df = spark.createDataFrame(
        [(1, 1.5, True, dt.datetime(2023, 1, 5), dt.datetime(2023, 1, 5, 1), None), (2, 1e7, None, None, None, 'a"b')],
        "i long, d double, b boolean, day timestamp_ntz, at timestamp_ntz, s string",
    )
    write_table(df.coalesce(1).orderBy("i"), str(tmp_path / "o.csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o.csv").glob("part-*")))
    assert text.splitlines() == [
        "i,d,b,day,at,s", "1,1.5,True,2023-01-05,2023-01-05 01:00:00,", '2,10000000.0,,,,"a""b"'
    ]
    write_table(df, str(tmp_path / "o.parquet"))
    back = read_table(spark, str(tmp_path / "o.parquet"))
    assert rows(without_row_id(back), "i") == rows(df, "i")


def test_row_ids_follow_file_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text("n\n" + "\n".join(str(i * 100 + k) for k in range(100)))
    df = read_table(spark, str(tmp_path), "csv")
    assert [r[0] for r in df.orderBy("_rid").select("n").collect()] == list(range(300))


def test_cells_with_line_breaks(spark, tmp_path, csv_file):
    df = read_table(spark, csv_file('id,t,n\n1,"line one\nline two",5\n2,"a ""b"", c",6\n3,"x\n\n,y",\n'))
    assert df.dtypes[:2] == [("id", "bigint"), ("t", "string")]
    assert rows(without_row_id(df.orderBy("_rid"))) == [(1, "line one\nline two", 5), (2, 'a "b", c', 6), (3, "x\n\n,y", None)]
    texts = spark.createDataFrame([(i, f'part {i}\n"quoted"\r\n\tend, {i}' if i % 3 else f"plain {i}") for i in range(60)], "i long, t string")
    write_table(texts.repartition(4), str(tmp_path / "o.csv"))
    assert rows(without_row_id(read_table(spark, str(tmp_path / "o.csv"))), "i") == [
        tuple(r) for r in rows(texts, "i")]


def test_row_ids_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "\n".join(str(k) for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = read_table(spark, str(tmp_path), "csv")
    first = {r.n: r["_rid"] for r in df.collect()}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert {r.n: r["_rid"] for r in df.select("*").collect()} == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(first, key=first.get) == list(range(5000))


def test_fill_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("nan"), 1.0), (None, 2.0), (3.0, None)], "v double, kept double")
    got = rows(fill_numeric(df, "mean", ["kept"]).select("v"))
    assert sorted(r[0] for r in got) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r[0] for r in rows(fill_numeric(df, "median", ["kept"]).select("v"))) == [1.0, 2.0, 2.0, 3.0]


def test_exact_lookup(spark):
    main = spark.createDataFrame(
        [(1, "Acme-1 Co.", "x"), (2, None, "y"), (3, "--", "z"), (4, "zzz", "w")], "id long, key string, city string"
    )
    sec = spark.createDataFrame(
        [(1, "acme 1 co", "A", "first", 7), (2, "ACME1CO", "B", "second", 8), (3, None, "C", "null", 9), (4, "!!", "D", "e", 1)],
        "ord long, name string, city string, note string, id long",
    )
    res = lookup_join(with_row_id(main, "id"), with_row_id(sec, "ord"), "key", "name")
    assert res.added == ["ord", "city_lookup", "note", "id_lookup"]
    out = res.df.drop("_rid", "ord")
    assert rows(out, "id") == [
        (1, "Acme-1 Co.", "x", "A", "first", 7, True), (2, None, "y", None, None, None, False),
        (3, "--", "z", None, None, None, False), (4, "zzz", "w", None, None, None, False),
    ]
    assert rows(match_count(res.df)) == [(4, 1)]
    assert dict(res.df.dtypes)["id_lookup"] == "bigint"  # V10


def test_missing_lookup_key_is_an_error(spark):  # V5
    df = with_row_id(spark.range(1), "id")
    with pytest.raises(ValueError, match="lookup key"):
        lookup_join(df, df, "nope", "id")


def test_lookup_names_are_checked_on_both_sides(spark):  # V3
    main = with_row_id(spark.createDataFrame([(1, "k", 1)], "i long, key string, v long"), "i")
    sec = with_row_id(spark.createDataFrame([(1, "k", 2, 3)], "j long, key string, v long, v_lookup long"), "j")
    assert lookup_join(main, sec, "key", "key").added == ["j", "v_lookup_1", "v_lookup"]


def test_float_keys_match_integers(spark):  # V7
    main = with_row_id(spark.createDataFrame([(1, 10000000.0)], "i long, key double"), "i")
    sec = with_row_id(spark.createDataFrame([(1, 10000000, "hit")], "j long, k long, v string"), "j")
    assert lookup_join(main, sec, "key", "k").df.select("v").first()[0] == "hit"


def test_diff(spark):
    raw = with_row_id(spark.createDataFrame(
        [(1, " a", 1e7, None, "", 1.0), (2, "b", 2.0, None, "x", None), (3, "c", 3.0, 1, None, 2.0)],
        "k long, s string, d double, n long, e string, f double"), "k")
    clean_ = raw.where("k < 3").withColumnRenamed("s", "S2").withColumn("S2", F.trim("S2")).withColumn(
        "n", F.lit(0)).withColumn("e", F.when(F.col("e") != "", F.col("e"))).withColumn("d", F.col("d").cast("long")).withColumn(
        "extra", F.lit(1))
    diff = compute_diff(raw, clean_)
    assert rows(diff.stats()) == [(3, 2, 1, 2)]
    assert rows(diff.cells(), "_rid") == [(1, "n", None, "0"), (2, "n", None, "0")]  # V8: 1e7 equals 10000000
    assert rows(diff.removed())[0][:3] == (3, 3, "c")
    assert [r["_rid"] for r in diff.changed(1).collect()] == [1]
    assert diff.truncated(1).first()[0] and not diff.truncated(2).first()[0]
    assert [r["row_index"] for r in number_rows(diff.changed(), raw).collect()] == [1, 2]


def test_three_row_fixture(spark, csv_file):
    path = csv_file("id,name,value\n1,Ahmed,10\n2,Mohamed, \n1,Ahmed,10\n")
    df = read_table(spark, path)
    assert dict(df.dtypes)["value"] == "string" and dict(df.dtypes)["id"] == "bigint"
    res = clean(df, CleaningConfig(remove_duplicates=True, fill_missing={"numeric": "zero"}))
    assert rows(res.df, "id") == [(1, "Ahmed", "10"), (2, "Mohamed", None)]
    assert rows(res.log()) == [(6, "duplicates", 1)]
    assert rows(res.diff().stats()) == [(3, 2, 1, 0)]
    numbered = number_rows(res.diff().removed(), res.raw)
    assert [r["row_index"] for r in numbered.collect()] == [3]


def test_all_steps_in_order(spark):
    main = spark.createDataFrame(
        [
            (1, " Ann Lee ", "$1,500", "05/01/2023", "ANN@@x.org", "(202) 555-0100", "a*b#", "أ", "k-1", None),
            (2, "nan", "null", "", " ", '"', None, None, None, None),
            (3, "Bob", "2k", "01-15-2023", "bad", "12", "*nan*", "ب", "k1", 4.0),
            (4, "Ann Lee", "n/a", "x", None, "1", "ok", "ت", "zz", 8.0),
        ],
        "Row Id long, `Client Name` string, `Total Price` string, `Order Date` string, `E-mail` string, `Phone` string, note string, ar string, `look` string, num double".replace("Row Id", "`Row Id`"),
    )
    sec = spark.createDataFrame([(1, "K1", "x@@y.org"), (2, "q", "z")], "n long, code string, mail string")
    config = CleaningConfig(
        standardize_columns=True, clean_arabic=True, remove_duplicates=True, dedupe_column="Client Name",
        merge_active=True, merge_key_main="look", merge_key_sec="code", clean_merged_columns=False, clean_money=True,
        fix_dates=True, fix_phones=True, fix_emails=True, remove_special_chars=True, anonymize_pii=True,
        ignore_columns=["look"], fill_missing={"numeric": "mean"},
    )
    res = clean(main, config, sec, order_by="Row Id", lookup_order_by="n")
    out = res.df.orderBy("row_id")
    assert out.columns == [
        "row_id", "client_name", "total_price", "order_date", "e_mail", "phone", "note", "ar", "look", "num", "n", "mail"
    ]
    got = rows(out)
    assert got[0] == (1, "A****", 1500.0, dt.datetime(2023, 1, 5), "a****@x.org", "******0100", "ab", "ا", "k-1", 6.0, 1, "x@@y.org")
    assert got[2] == (3, "B****", 2000.0, dt.datetime(2023, 1, 15), None, None, "nan", "ب", "k1", 4.0, 1, "x@@y.org")
    assert len(got) == 3 and got[1][2] == 1750.0  # money gap filled, row 4 is a copy of row 1's client
    log = {r["action"]: r["n"] for r in res.log().collect()}
    assert log == {"merged": 2, "renamed": 1, "dates": 1, "money": 1, "duplicates": 1, "masked": 3}


def test_preview_parts(spark):
    df = spark.createDataFrame([(1, " a"), (2, None)], "k long, s string")
    parts = clean(df, CleaningConfig(ignore_columns=["k"]), order_by="k").preview()
    assert rows(parts["stats"]) == [(2, 2, 0, 0)]
    assert rows(parts["head"]) == [('{"k":1,"s":"a"}',), ('{"k":2,"s":null}',)]
    assert rows(parts["log"]) == [] and not parts["truncated"].first()[0]


def test_without_lookup_table_merge_is_skipped(spark):
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    assert clean(df, CleaningConfig(merge_active=True, merge_key_main="s"), order_by="k").df.columns == ["k", "s"]


def test_files_of_a_folder_keep_their_own_column_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b,c\n1,2,x\n", "utf-8")
    (folder / "2.csv").write_text("﻿b,c,a\n5,y,6\n7,z,8\n", "utf-8")
    df = read_table(spark, str(folder), "csv")
    assert df.columns[:3] == ["a", "b", "c"] and dict(df.dtypes)["a"] == "bigint"
    assert sorted(r[:3] for r in df.collect()) == [(1, 2, "x"), (6, 5, "y"), (8, 7, "z")]
    (folder / "3.csv").write_text("c,a,b\nq,$1,200,3\nw,5,6\n", "utf-8")  # a broken amount in another order
    assert sorted(r[:3] for r in read_table(spark, str(folder), "csv").collect()) == [
        ("$1,200", "3", "q"), ("1", "2", "x"), ("5", "6", "w"), ("6", "5", "y"), ("8", "7", "z")]
    (folder / "4.csv").write_text("a,b,other\n1,2,3\n", "utf-8")
    with pytest.raises(ValueError, match="other"):
        read_table(spark, str(folder), "csv")


def test_an_unclosed_quote_does_not_swallow_lines(spark, csv_file):
    df = read_table(spark, csv_file('a,b\n1,"x\n2,y\n3,z\n'))
    assert sorted(r[:2] for r in df.collect()) == [("1", "x"), ("2", "y"), ("3", "z")]
    closed = read_table(spark, csv_file('a,b\n1,"x\n2,y"\n3,z\n'))
    assert sorted(r[:2] for r in closed.collect()) == [(1, "x\n2,y"), (3, "z")]
