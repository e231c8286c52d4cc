"""Which pairs of strings are worth comparing: shared-gram keys, exact by counting.

Let ``a`` (shorter) and ``b`` differ by at most D insertions and deletions with
``lcs`` letters in common.  The common letters form at most D + 1 runs, so

* one run has at least ceil(lcs / (D + 1)) letters, and of all grams of length q
  at least lcs - (D + 1) * (q - 1) survive in ``b``;
* of P disjoint pieces of ``a`` at least P - D survive (the pigeonhole idea of
  Li et al., Pass-Join, VLDB 2012).

If at least ``c`` of the P published grams survive, the rarest P - c + 1 of them
contain a survivor, so the ``c`` - 1 most frequent ones need no index entry (the
prefix filter of Xiao et al., PPJoin, WWW 2008).  The shorter string publishes
those rarest grams (role S), the longer all its grams of that length (role L),
and an equality join on the gram finds every similar pair.  Nothing is sampled
or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.functions.similarity import TOKEN_BREAK

MAX_GRAM = 4
# Lengths above this share one gram rule: the guaranteed run only grows with length.
LENGTH_TABLE = 64


@dataclass(frozen=True)
class GramRule:
    """How a shorter string of one length publishes its grams."""

    gram: int
    stride: int      # 1: all grams, gram: disjoint pieces
    skippable: int   # the most frequent grams that need no entry
    partner_min: int
    partner_max: int


def gram_rule(length: int, partners: Sequence[tuple[int, int, int]]) -> GramRule | None:
    """``partners``: (partner length, least LCS, largest distance) for each feasible length."""
    if not partners:
        return None
    lo, hi = min(p for p, _, _ in partners), max(p for p, _, _ in partners)
    most = max(d for _, _, d in partners)
    run = min(MAX_GRAM, min(-(-lcs // (d + 1)) for _, lcs, d in partners))
    # Disjoint pieces keep the index small; they may be one letter shorter than the run.
    for q in (run, run - 1):
        if most > 0 and q >= 2 and length // q > most:
            return GramRule(q, q, length // q - most - 1, lo, hi)
    survivors = min(lcs - (d + 1) * (run - 1) for _, lcs, d in partners)
    return GramRule(run, 1, survivors - 1, lo, hi)


def ratio_rule(length: int, cutoff: int) -> GramRule | None:
    """Rule for ``ratio >= cutoff`` between a string of ``length`` and a longer or equal one."""
    partners = []
    for other in range(length, length * (200 - cutoff) // cutoff + 1):
        total = length + other
        distance = total * (100 - cutoff) // 100
        distance -= (distance - total) % 2
        if distance >= max(1, other - length):
            partners.append((other, (total - distance) // 2, distance))
    return gram_rule(length, partners)


def contained_rule(length: int) -> GramRule:
    """Rule for a shorter string that the longer one, 1.5 to 8 times as long, contains."""
    return GramRule(min(MAX_GRAM, length), 1, 0, -(-3 * length // 2), 8 * length)


def window_rule(length: int, cutoff: int) -> GramRule | None:
    """Rule for ``0.9 * partial_ratio >= cutoff``, length ratio from 1.5 to 8."""
    found = []
    for window in range(1, length + 1):
        total = length + window
        lcs = -(-cutoff * 10 * total // 1800)
        if lcs <= window:
            found.append((window, lcs, total - 2 * lcs))
    rule = gram_rule(length, found)
    if rule is None:
        return None
    return GramRule(rule.gram, rule.stride, rule.skippable, -(-3 * length // 2), 8 * length)


GRAMS = "array<struct<gram:string,pos:int>>"


def grams(text: Column, q: Column | int, stride: Column | int = 1) -> Column:
    """Array of (gram, pos): all grams of length ``q``, or every ``stride``-th."""
    q = F.lit(q) if isinstance(q, int) else q
    stride = F.lit(stride) if isinstance(stride, int) else stride
    starts = F.sequence(F.lit(1), F.length(text) - q + 1, stride)
    found = F.transform(
        starts, lambda i: F.struct(F.substr(text, i, q).alias("gram"), i.alias("pos"))
    )
    return F.when(F.length(text) >= q, found).otherwise(F.array().cast(GRAMS))


def _by_length(values: Sequence[int], length: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), F.least(length, F.lit(len(values))).cast("int")
    )


def _without_positions(found: Column) -> Column:
    return F.array_distinct(
        F.transform(found, lambda g: F.struct(g["gram"].alias("gram"), F.lit(0).alias("pos")))
    )


def gram_members(
    df: DataFrame,
    text: str,
    rule_of: Callable[[int], GramRule | None],
    tag: str,
    positions: bool,
    contained: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The S and L rows of each text: ``df`` plus ``key``, ``pos``, ``len``.

    S rows also have ``weight`` and ``limit`` for ``rarest_grams``.  With
    ``positions`` off, a repeated gram of a text gives one row; ``contained``
    says that partners hold the whole shorter text, so that any one gram will do.
    """
    rules = [rule_of(n) for n in range(1, LENGTH_TABLE + 1)]
    tail = rules[-1]
    if tail is not None and any(rule_of(n).gram < tail.gram for n in range(65, 8 * 65, 65)):
        raise AssertionError("a longer string must not need shorter grams")
    t = F.col(text)
    n = F.length(t)
    gram = _by_length([r.gram if r else 0 for r in rules], n)
    # Past the table every gram is published and none is skipped, which is always enough.
    stride = _by_length([r.stride if r else 1 for r in rules[:-1]] + [1], n)
    skippable = _by_length([r.skippable if r else 0 for r in rules[:-1]] + [0], n)
    published = F.when(gram > 0, grams(t, gram, stride)).otherwise(F.array().cast(GRAMS))

    # Gram lengths that the partners of a longer string of each length may publish.
    reach: dict[int, list[int]] = {}
    for r in filter(None, rules):
        span = reach.setdefault(r.gram, [r.partner_min, r.partner_max])
        span[0], span[1] = min(span[0], r.partner_min), max(span[1], r.partner_max)
    if tail is not None:
        reach[tail.gram][1] = 1 << 30
    all_grams = F.array().cast(GRAMS)
    for q, (lo, hi) in sorted(reach.items()):
        wanted = F.when((n >= lo) & (n <= hi), grams(t, q)).otherwise(F.array().cast(GRAMS))
        all_grams = F.concat(all_grams, wanted)
    limit = F.lit(0) if contained else F.greatest(F.size(published) - 1 - skippable, F.lit(0))
    if not positions:
        published, all_grams = _without_positions(published), _without_positions(all_grams)

    # Per-text values come first: beside an explode they would be worked out per gram.
    base = df.withColumns({"len": n, "limit": limit, "weight": F.lit(1)})

    def rows(found: Column) -> DataFrame:
        return base.select("*", F.explode(found).alias("_g")).withColumns({
            "key": F.xxhash64(F.lit(tag), F.col("_g.gram")), "pos": F.col("_g.pos")
        }).drop("_g")

    return rows(published), rows(all_grams).drop("limit", "weight")


def rarest_grams(short: DataFrame, long: DataFrame, owner: str) -> DataFrame:
    """Keep, per ``owner``, the rarest published grams that are enough to find any partner.

    Rare means few L rows.  A gram is kept while the weights of the rarer ones
    sum to at most ``limit``.  Grams without any L row find nothing and are
    dropped after they were counted.
    """
    frequency = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(owner).orderBy("n", "key", "pos")
    rarer = F.sum("weight").over(order) - F.col("weight")
    return (
        short.join(frequency, "key", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rarer", rarer)
        .where((F.col("rarer") <= F.col("limit")) & (F.col("n") > 0))
        .drop("rarer", "n", "weight", "limit")
    )


BAGS = ("parity", "mask")


def with_letter_bag(df: DataFrame, text: str) -> DataFrame:
    """Add two 64-bit sketches of the letters of a text, white space left out.

    The letters form a set of (letter, 1st, 2nd, ... occurrence), each hashed to
    one bit: ``parity`` combines the bits by XOR, ``mask`` by OR.  Letters that
    two texts do not share can only hide behind each other, so the sketches
    bound distances from below.
    """
    bare = F.regexp_replace(F.col(text), TOKEN_BREAK, "")
    counted = F.transform(
        F.array_distinct(F.split("_bare", "")),
        lambda c: F.struct(
            c.alias("letter"),
            F.when(c == "", F.lit(0))
            .otherwise(F.length("_bare") - F.length(F.replace(F.col("_bare"), c, F.lit(""))))
            .alias("n"),
        ),
    )
    bits = F.flatten(
        F.transform(
            F.filter(counted, lambda s: s["n"] > 0),
            lambda s: F.transform(
                F.sequence(F.lit(1), s["n"]),
                lambda k: F.call_function(
                    "shiftleft", F.lit(1).cast("bigint"),
                    F.pmod(F.xxhash64(s["letter"], k), F.lit(64)).cast("int"),
                ),
            ),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        df.withColumn("_bare", bare)
        .withColumn("_bits", bits)
        .withColumns({
            "parity": F.aggregate("_bits", zero, lambda x, b: x.bitwiseXOR(b)),
            "mask": F.aggregate("_bits", zero, lambda x, b: x.bitwiseOR(b)),
        })
        .drop("_bare", "_bits")
    )


def bag_distance(parity_a: Column, parity_b: Column) -> Column:
    """Lower bound of the indel distance; NULL if a sketch is NULL."""
    return F.bit_count(parity_a.bitwiseXOR(parity_b))


def bag_excess(mask_a: Column, mask_b: Column) -> Column:
    """Letters of the first text that the second lacks, at least."""
    return F.bit_count(mask_a.bitwiseAND(F.bitwise_not(mask_b)))


def ratio_compatible(
    s_len: Column, l_len: Column, low_shift: Column, high_shift: Column, cutoff: int
) -> Column:
    """Length and position bounds of a shared run under ``ratio >= cutoff``.

    The shift, position in the longer less position in the shorter, is known to
    lie between ``low_shift`` and ``high_shift``.
    """
    distance = F.floor((s_len + l_len) * (100 - cutoff) / 100)
    gap = l_len - s_len
    return (
        (gap >= 0)
        & (gap <= distance)
        & (2 * low_shift <= distance + gap)
        & (2 * high_shift >= gap - distance)
    )


# A key with more rows than this is spread over several tasks.
HOT_KEY_ROWS = 4096
# Parts of a hot key in which its rows look up how far they are to be spread.
LOOKUP_PARTS = 64


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_join(many: DataFrame, few: DataFrame, spread: str, *also: str) -> DataFrame:
    """Join two gram tables on ``key`` and the columns ``also``, with the rows of hot keys spread over salts.

    Rows of ``many`` take a salt by the hash of ``spread``; rows of ``few`` under
    a hot key are repeated for each of its salts, as many as its rows ask for.
    The rows of a hot key look its salts up in parts, so that this join does not
    bring them together either.  The partition number is fixed: a small table can
    still mean many comparisons.
    """
    hot = (
        many.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY_ROWS)
        .select("key", F.ceil(F.col("n") / HOT_KEY_ROWS).cast("int").alias("salts"))
    )
    in_parts = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_PARTS - 1))))
    salts = F.coalesce("salts", F.lit(1))
    part = F.pmod(F.xxhash64(F.lit("part"), spread), F.lit(LOOKUP_PARTS)).cast("int")
    left = many.withColumn("part", part).join(in_parts, ["key", "part"], "left").drop("part")
    left = left.withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    right = few.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    left = left.drop("salts").repartition(shuffle_partitions(many), "key", "salt")
    return left.join(right.drop("salts"), ["key", "salt", *also])
