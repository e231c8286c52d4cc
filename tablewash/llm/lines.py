"""Removal of lines that many documents repeat, as keep bitmaps.

1. *Occurrences.*  Each line with a key of ``min_chars`` code points or more becomes one row of
   the key's hash, its document and its position; texts do not move.
2. *Order.*  The rows are range-partitioned by hash and slice of the document and sorted by
   hash, slice, document (largest first) and position.  A slice is a hash of the document, so a
   line that a third of all documents hold is spread over ``SLICES`` ranges; the slices of any
   other line stand side by side, mostly in one task.
3. *First occurrences* are streamed from that order: per slice one row with its largest document
   and its number of documents; these are added up per hash.
4. *Bitmaps.*  A line of a repeated key outside the key's largest document is dropped.  Its
   position sets one bit in a 64-bit word; words in which all lines stay are left out.

Only SQL functions are used.  Keys are compared by two independent 64-bit hashes.

Defined cases: a NULL text is the empty text, which is one empty line.  A document is a pair of
id and text: rows that repeat both are one document and get the same bitmap, rows that share an
id only are several.  Of several documents with the largest id all keep the line; no id ranks
below all ids.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SLICES = 4096
WHITE = " \t\n\x0b\x0c\r"
BITS = 64


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    return docs.select(docs[id_column].alias("doc"), text.alias("content")).withColumn("body", F.xxhash64("content"))


def occurrences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 20) -> DataFrame:
    """One row per line with a long key, in the order of step 2."""
    lines = _rows(docs, id_column, text_column).select("doc", "body", F.posexplode(F.split("content", "\n")).alias("position", "line"))
    long = lines.where(F.char_length(F.btrim("line", F.lit(WHITE))) >= min_chars).withColumn("key", line_key(F.col("line")))
    named = long.select(
        F.xxhash64("key").alias("high"), F.xxhash64(F.lit("line"), "key").alias("low"),
        F.pmod(F.xxhash64("doc", "body"), F.lit(SLICES)).cast("int").alias("slice"), "doc", "body", "position",
    )
    return named.repartitionByRange("high", "low", "slice").sortWithinPartitions(
        "high", "low", "slice", F.desc_nulls_last("doc"), "body", "position")


def _first_marked(found: DataFrame) -> DataFrame:
    """``first`` marks where a document begins within a hash and slice; streamed, without a further shuffle or sort."""
    order = Window.partitionBy("high", "low", "slice").orderBy(F.desc_nulls_last("doc"), "body", "position")
    before = F.lag(F.struct("doc", "body")).over(order)
    return found.withColumn("first", ~before.eqNullSafe(F.struct("doc", "body")))


def _repeated(marked: DataFrame, min_docs: int) -> DataFrame:
    """Per hash and slice of a repeated key: ``lead``, the largest document that holds the key in any slice."""
    first = marked.where("first")
    keys = first.groupBy("high", "low").agg(F.max("doc").alias("lead"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return first.select("high", "low", "slice").distinct().join(keys.drop("n"), ["high", "low"])


def keep_bitmaps(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 20, min_docs: int = 3,
) -> DataFrame:
    """Per document that loses a line: ``doc``, ``body`` (hash of the text), ``n_dropped`` and ``words``.

    ``words`` is the compressed bitmap: the number of each 64-line word that loses a line, and its bits (set: the line stays).
    """
    marked = written(_first_marked(occurrences(docs, id_column, text_column, min_chars)), "lines")
    dropped = marked.join(_repeated(marked, min_docs), ["high", "low", "slice"]).where(~F.col("doc").eqNullSafe(F.col("lead")))
    word = F.expr(f"position div {BITS}").cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, position % {BITS})")
    words = dropped.groupBy("doc", "body", word).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc", "body").agg(
        F.sum(F.bit_count("gone").cast("bigint")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("words"),
    )


def kept_lines(lines: Column, words: Column) -> Column:
    """The lines of a text that its bitmap keeps."""
    sparse = F.map_from_entries(words)
    last = ((F.size(lines) - 1) / BITS).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(sparse, w), F.lit(-1).cast("bigint")))
    return F.filter(lines, lambda line, i: F.getbit(F.get(dense, (i / BITS).cast("int")), i % BITS) == 1)


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 20, min_docs: int = 3,
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_lines``, ``n_dropped``, ``kept_sha256`` and ``kept_text``."""
    maps = keep_bitmaps(docs, id_column, text_column, min_chars, min_docs).withColumnsRenamed({"doc": "map_doc", "body": "map_body"})
    rows = _rows(docs, id_column, text_column)
    joined = rows.join(maps, (rows["body"] == maps["map_body"]) & rows["doc"].eqNullSafe(maps["map_doc"]), "left")
    kept = F.when(F.col("words").isNull(), F.col("content")).otherwise(F.array_join(kept_lines(F.split("content", "\n"), F.col("words")), "\n"))
    return joined.select(
        F.col("doc").alias(id_column), F.size(F.split("content", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), kept.alias("kept_text"),
    ).withColumn("kept_sha256", F.sha2("kept_text", 256))
