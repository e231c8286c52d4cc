"""CSV scan with type inference, and repair of lines broken by an unquoted comma."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import patterns as P
from tablewash.functions.text import strip
from tablewash.operators.checkpoints import staged
from tablewash.operators.headers import ROW_ID

BROKEN = "_broken_line"
# A quoted field; commas inside it do not split.
QUOTED_FIELD = r'(?<=^|,)"(?:[^"]|"")*(?:"|$)'
# A line whose last field is quoted and still open.
OPEN_LINE = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+$'
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity)\s*$"
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")
ROWS_PER_PARTITION_BITS = 33
# Header lines that the files of one folder may differ in.
MOST_HEADERS = 100


def header_names(line: str) -> list[str]:
    """Names of a header line; a repeated name becomes ``a.1``, an empty one ``Unnamed: i``."""
    names, used = [], set()
    for i, raw in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name = base = raw or f"Unnamed: {i}"
        n = 0
        while name.lower() in used:
            n += 1
            name = f"{base}.{n}"
        used.add(name.lower())
        names.append(name)
    return names


def field_count(line: Column) -> Column:
    """Number of fields of a CSV line."""
    bare = F.regexp_replace(line, QUOTED_FIELD, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def repair_fields(fields: Column, n: int) -> Column:
    """Join the first neighbours that look like a number split at its comma.

    ``fields`` is an array of n + 1 texts.  NULL when no pair qualifies.
    """
    def splits(i: Column) -> Column:
        left = strip(F.get(fields, i))
        right = strip(F.get(fields, i + 1))
        return left.rlike(rf"^[$€£]|{P.DIGIT}$") & right.rlike(rf"^{P.DIGIT}")

    at = F.get(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), splits), F.lit(0))
    joined = F.concat(strip(F.get(fields, at)), F.lit(","), strip(F.get(fields, at + 1)))
    return F.when(
        at.isNotNull(),
        F.concat(
            F.slice(fields, F.lit(1), at), F.array(joined), F.slice(fields, at + 3, F.lit(n))
        ),
    )


def split_line(line: Column, n: int) -> Column:
    """Fields of a CSV line as an array of ``n`` texts, empty fields as ''."""
    names = [f"f{i}" for i in range(n)]
    schema = ", ".join(f"{c} string" for c in names)
    row = F.from_csv(line, schema, {"escape": '"'})
    return F.array(*[F.coalesce(row[c], F.lit("")) for c in names])


def repair_line(line: Column, n: int) -> Column:
    """The ``n`` fields of a line with ``n`` or, if it can be mended, ``n + 1`` fields.

    NULL for any other line: short, longer, blank or beyond repair.
    """
    count = field_count(line)
    return (
        F.when(strip(line) == "", F.lit(None))
        .when(count == n, split_line(line, n))
        .when(count == n + 1, repair_fields(split_line(line, n + 1), n))
    )


def _typed(raw: DataFrame, names: list[str], facts) -> DataFrame:
    out = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        value = F.when(~c.isin(*P.CSV_NULL_TOKENS), c)
        if not facts[f"seen{i}"]:
            value = F.lit(None).cast("double")
        elif facts[f"int{i}"]:
            value = F.trim(value).cast("bigint")
        elif facts[f"num{i}"]:
            value = F.trim(value).cast("double")
        elif facts[f"bool{i}"]:
            value = F.lower(value).cast("boolean")
        out.append(value.alias(name))
    return raw.select(*out, ROW_ID)


def infer_aggregates(names: list[str]) -> list[Column]:
    """One aggregate per column and type: whether every non-missing text fits it."""
    out = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        v = F.when(~c.isin(*P.CSV_NULL_TOKENS), c)
        integer = v.rlike(INTEGER)
        out += [
            (F.count(v) > 0).alias(f"seen{i}"),
            F.bool_and(integer & F.trim(v).try_cast("bigint").isNotNull()).alias(f"int{i}"),
            # An integer too long for BIGINT is kept as text rather than rounded.
            F.bool_and(
                v.rlike(NUMBER) & (~integer | F.trim(v).try_cast("bigint").isNotNull())
            ).alias(f"num{i}"),
            F.bool_and(v.isin(*BOOLEANS)).alias(f"bool{i}"),
        ]
    return out


def file_facts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Per file, from one pass over the text: the header line, whether a line ends inside a quoted field
    (``open_fields``), and whether such a field is never closed (``unclosed``: an odd number of quotes)."""
    lines = spark.read.option("encoding", encoding).text(path).where(F.trim("value") != "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    marked = lines.select(
        F.col("_metadata.file_path").alias("file"), "value", place.alias("place"), quotes.alias("quotes"),
        (F.col("value").contains('"') & F.col("value").rlike(OPEN_LINE)).alias("open"),
    )
    facts = marked.groupBy("file").agg(
        F.min_by("value", "place").alias("header"), F.bool_or("open").alias("open_fields"), F.sum("quotes").alias("quotes"))
    return facts.select("file", "header", "open_fields", (F.col("open_fields") & (F.col("quotes") % 2 == 1)).alias("unclosed"))


def _header_orders(facts: DataFrame, path: str) -> tuple[list[str], dict[str, list[int]]]:
    """The column names, and for each header line that has them in another order the places of the columns.

    The names stand as in the first file; a file with other names is an error.
    """
    found = facts.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").limit(MOST_HEADERS + 1).collect()
    if not found:
        raise ValueError(f"{path} is empty")
    if len(found) > MOST_HEADERS:
        raise ValueError(f"{path} has files with more than {MOST_HEADERS} different header lines")
    names = header_names(found[0]["header"])
    orders = {}
    for row in found[1:]:
        own = header_names(row["header"])
        if sorted(own) != sorted(names):
            raise ValueError(f"{row['file']} has the columns {own}, but {found[0]['file']} has {names}")
        if own != names:
            orders[row["header"]] = [own.index(name) for name in names]
    return names, orders


def _in_order(raw: DataFrame, facts: DataFrame, names: list[str], orders: dict[str, list[int]]) -> DataFrame:
    """The fields of files with another column order, put in the order of the names."""
    if not orders:
        return raw
    fields = F.array(*[F.col(f"`{c}`") for c in names])
    known = F.create_map(*[x for header, places in orders.items() for x in (F.lit(header), F.array(*map(F.lit, places)))])
    places = facts.select(F.col("file").alias("_file"), known[F.col("header")].alias("_places"))
    joined = raw.join(places, F.col(f"{ROW_ID}.file") == F.col("_file"), "left")
    return joined.withColumn("_moved", _moved(fields, orders)).select(
        *[F.get("_moved", F.lit(i)).alias(c) for i, c in enumerate(names)], BROKEN, ROW_ID, "_places")


def _moved(fields: Column, orders: dict[str, list[int]]) -> Column:
    """Fields in the order of the names."""
    if not orders:
        return fields
    return F.when(F.col("_places").isNull(), fields).otherwise(F.transform("_places", lambda i: F.get(fields, i)))


def read_csv(
    spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None
) -> DataFrame:
    """Read CSV with a header line; ``_rid`` is the position in the files.

    The fields are parsed once and written to the shared work folder; types, row
    ids and all later jobs read that copy, so ids do not depend on how the files
    were split.  If any record has more fields than the header, the whole table
    is read in repair mode instead: all columns are strings, records one field too
    long are mended where a number was split at its comma, and the other broken
    ones are dropped.

    The files of a folder may have their columns in different orders, each as its
    own header says; the order of the first file holds.  Other names are an error.

    Cells may hold line breaks: with ``multi_line=None`` one pass over the text
    looks for a line that ends inside a quoted field.  Such files are read one
    task per file; without them files are split.  Where a quoted field is never
    closed, the lines after it are no part of it: the table is read line by line
    in repair mode.  Where quotes at the start of a field are plain text, pass
    ``multi_line=False``.
    """
    facts = staged(file_facts(spark, path, encoding), "csv-files")
    names, orders = _header_orders(facts, path)
    quoting = facts.agg(F.bool_or("open_fields").alias("open"), F.bool_or("unclosed").alias("unclosed")).first()
    line_by_line = multi_line is None and quoting["unclosed"]
    if multi_line is None:
        multi_line = quoting["open"] and not line_by_line
    stored = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*stored, BROKEN]])
    scan = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("columnPruning", False)
        .csv(path)
    )
    in_partition = F.monotonically_increasing_id().bitwiseAND(
        F.lit((1 << ROWS_PER_PARTITION_BITS) - 1)
    )
    parsed = scan.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            in_partition.alias("row"),
        ).alias(ROW_ID),
    )
    raw = _in_order(staged(parsed, "csv").toDF(*names, BROKEN, ROW_ID), facts, names, orders)
    n = len(names)
    checks = raw.agg(
        F.coalesce(F.bool_or(field_count(F.col(BROKEN)) > n), F.lit(False)).alias("over_long"),
        *infer_aggregates(names),
    ).first()
    if not checks["over_long"] and not line_by_line:
        return _typed(raw, names, checks)
    parsed = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
    fields = F.when(F.col(BROKEN).isNull(), parsed).otherwise(_moved(repair_line(F.col(BROKEN), n), orders))
    return (
        raw.select(fields.alias("_fields"), ROW_ID)
        .where(F.col("_fields").isNotNull())
        .select(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(names)], ROW_ID)
    )
