"""How far the sources of a language differ in their words, priced from joint tables of count levels.

1. *Counts.*  Tasks count the terms of their texts per (language, source) and send one row per
   distinct term, not one per word; Spark adds these up.
2. *Prices.*  A group gives a term a price that depends only on its count there (its level) and on
   the group's total: integers, by decimal division.
3. *Blocks.*  The kept terms of a language are cut into blocks of about ``BLOCK_TERMS``, terms of
   like frequency together, so that a block has few levels; its sources into parts of about
   ``BLOCK_GROUPS``.  One task gets the counts of one block for one pair of parts.
4. *Products.*  There, each (group, level) is an indicator column over the terms, level 0 included.
   The product of this matrix with its transpose holds the joint table of every pair of groups:
   how many terms have level i in the one and level j in the other.  Entries are whole numbers
   far below 2^24, so the product is exact.  Each entry times the difference of its two prices,
   summed per pair of groups and over all blocks, is the divergence of the pair.

No task holds more than one block, whatever the size of a source; the pairs are the result itself.

Defined cases: NULL text, language and source are ''.  A group without terms has its row in every
pair; a language without kept terms has divergence 0.  Repeated rows count as often as they stand.
Ties in value go by the item's UTF-8 bytes.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

BLOCK_TERMS, BLOCK_GROUPS, BLOCK_COLUMNS = 1024, 64, 1024
HELD_TERMS, PIECE = 200_000, 1 << 20
SCALE = 1_000_000_000
# A-Z in lower case; all other ASCII characters but a-z become a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
PAIRS = "lang string, a string, b string, value bigint"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists from about ``PIECE`` bytes each."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and numbers of texts per group and term; the term '' stands for the group itself."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (counts, docs) in held.items():
            for c, values in zip(columns, ([lang] * len(docs), [source] * len(docs), docs, [counts[t] for t in docs], docs.values()), strict=True):
                c.extend(values)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns[2] = pa.array(columns[2], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, text in zip(groups, batch.column("text").cast(pa.binary()), strict=True):
            counts, docs = held.setdefault(group, (Counter(), Counter()))
            before, own = len(docs), {b""}
            for words in terms_of(text.as_py()):
                counts.update(words)
                own.update(words)
            docs.update(own)
            size += len(docs) - before
            if size > HELD_TERMS:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def joint_prices(term: np.ndarray, group: np.ndarray, level: np.ndarray, price: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """For each pair of groups the sum over the terms of the differences of their prices.

    ``term`` (numbers from 0 without gaps), ``group``, ``level`` and ``price`` list the counts above 0; ``zero`` has each
    group's price of level 0.
    """
    if not len(term):
        return np.zeros((len(zero), len(zero)))
    kinds, which = np.unique(np.stack([group, level]), axis=1, return_inverse=True)
    which, width, height = which.ravel(), kinds.shape[1] + len(zero), int(term.max()) + 1
    if width > BLOCK_COLUMNS and height > 1:
        low = term < height // 2
        return joint_prices(term[low], group[low], level[low], price[low], zero) + joint_prices(
            term[~low] - height // 2, group[~low], level[~low], price[~low], zero)
    # The columns of a group stand together, that of level 0 first.
    first = np.searchsorted(kinds[0], np.arange(len(zero))) + np.arange(len(zero))
    column = which + group + 1
    prices = np.empty(width)
    prices[first], prices[column] = zero, price
    seen = np.zeros((height, width), np.float32)
    seen[:, first] = 1
    seen[term, first[group]] = 0
    seen[term, column] = 1
    tables = (seen.T @ seen).astype(np.float64)
    tables *= np.abs(prices[:, None] - prices[None, :])
    return np.add.reduceat(np.add.reduceat(tables, first, axis=0), first, axis=1)


def price_block(table: pa.Table) -> pa.Table:
    """The part of each pair's divergence that the terms of one block make up."""
    names = table.column("source").combine_chunks().dictionary_encode()
    group, names = names.indices.to_numpy(), names.dictionary
    is_group = table.column("term").is_null().to_numpy()
    price, part = table.column("price").to_numpy(), table.column("part").to_numpy()
    zero, parts = np.zeros(len(names)), np.zeros(len(names), np.int64)
    zero[group[is_group]], parts[group[is_group]] = price[is_group], part[is_group]
    terms = table.column("term").filter(pa.array(~is_group)).combine_chunks().dictionary_encode().indices.to_numpy()
    own = ~is_group
    value = joint_prices(terms, group[own], table.column("n").to_numpy()[own], price[own], zero)
    absent = int(table.column("terms").to_numpy()[is_group][0]) - (int(terms.max()) + 1 if len(terms) else 0)
    value += absent * np.abs(zero[:, None] - zero[None, :])
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    a, b = np.nonzero((parts[:, None] == low) & (parts[None, :] == high))
    if low == high:
        a, b = a[a < b], b[a < b]
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "a": names.take(pa.array(a)),
                     "b": names.take(pa.array(b)), "value": value[a, b].astype(np.int64)})


def price(n: Column, total: Column, terms: Column, smooth: int) -> Column:
    """``1 + floor(SCALE * (n + smooth) / (total + smooth * terms))`` in exact decimals; NULL without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + smooth).cast("decimal(20,0)")
    below = F.when(terms > 0, (total + smooth * terms).cast("decimal(20,0)"))
    return F.call_function("div", above, below) + 1


def _ranked(df: DataFrame, part: str, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = df.withColumn("rank", rank)
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def source_divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: per source the other sources of its language by
    divergence (part ``pair``), and the ``top`` terms that it prices above its language (part ``term``)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "counts")
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs)
    terms = terms.withColumn("band", F.length(F.bin("n_lang")))
    bands = terms.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("sum_lang"))
    blocks = F.ceil(F.col("kept") / BLOCK_TERMS)
    terms = terms.join(bands.select("lang", "band", blocks.alias("blocks")), ["lang", "band"])
    terms = terms.select("lang", "term", "n_lang", "band", F.pmod(F.xxhash64("term"), "blocks").alias("slot"))
    cells = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang", "band", "slot"), "cells")

    langs = bands.groupBy("lang").agg(F.sum("kept").alias("v"), F.sum("sum_lang").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = counts.where("term = ''").select("lang", "source")
    sizes = found.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_GROUPS).alias("parts"))
    none = F.lit(0).cast("bigint")
    groups = found.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.withColumns({c: F.coalesce(c, none) for c in ("v", "total", "total_lang")})
    groups = written(groups.withColumns({
        "zero": F.coalesce(price(none, F.col("total"), F.col("v"), smooth), none),
        "part": F.pmod(F.xxhash64("source"), "parts"),
    }), "groups")

    priced = cells.join(groups, ["lang", "source"]).withColumn("price", price(F.col("n"), F.col("total"), F.col("v"), smooth))
    above = priced.withColumn("value", F.col("price") - price(F.col("n_lang"), F.col("total_lang"), F.col("v"), smooth)).where("value > 0")
    by_term = _ranked(above.withColumnRenamed("term", "item"), "term", top)

    slots = cells.select("lang", "band", "slot", "term").distinct().groupBy("lang", "band", "slot").agg(F.count(F.lit(1)).alias("terms"))
    bare = groups.where("v = 0").select("lang", F.lit(0).alias("band"), none.alias("slot"), none.alias("terms")).distinct()
    members = slots.unionByName(bare).join(groups, "lang").select(
        "lang", "band", "slot", "source", "part", "parts", F.lit(None).cast("string").alias("term"), none.alias("n"), F.col("zero").alias("price"), "terms")
    entries = priced.select("lang", "band", "slot", "source", "part", "parts", "term", "n", "price", none.alias("terms"))
    sent = entries.unionByName(members).withColumn("other", F.explode(F.sequence(none, F.col("parts") - 1)))
    sent = sent.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other", "parts")
    pairs = sent.groupBy("lang", "band", "slot", "low", "high").applyInArrow(price_block, PAIRS)
    # A block names the two in any order.
    pairs = pairs.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    by_source = _ranked(pairs.select("lang", both.alias("pair"), "value").select("lang", "pair.*", "value"), "pair")
    return by_source.unionByName(by_term)
