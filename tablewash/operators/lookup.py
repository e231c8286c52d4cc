"""Lookup left join: bring the columns of a second table in by a normalised key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.functions import patterns as P
from tablewash.functions import similarity
from tablewash.functions.text import as_text, normalize_key
from tablewash.operators import headers
from tablewash.operators.candidates import (
    BAGS,
    bag_distance,
    bag_excess,
    contained_rule,
    gram_members,
    rarest_grams,
    ratio_compatible,
    ratio_rule,
    salted_join,
    shuffle_partitions,
    window_rule,
    with_letter_bag,
)
from tablewash.operators.checkpoints import cut
from tablewash.operators.headers import ROW_ID
from tablewash.operators.ordering import row_id

KEY, MATCHED = "_key", "_matched"
# The score of a contained key.  A looser search begins here; a key found at it is not searched further down.
CONTAINED = 90
# At and below this score the longest partners, over eight times as long, would count too.
LEAST_THRESHOLD = 60


@dataclass(frozen=True)
class LookupResult:
    """Joined table (with ``_matched``) and the names of the added columns."""

    df: DataFrame
    added: list[str]


def added_names(main: DataFrame, lookup: DataFrame, key_sec: str) -> dict[str, str]:
    """Lookup column -> name in the result.

    A name the main table has becomes ``X_lookup``, then ``X_lookup_1``, ...;
    names are checked against both tables.
    """
    ours = {c.lower() for c in headers.business_columns(main)}
    wanted = [c for c in headers.business_columns(lookup) if c != key_sec]
    free = [c for c in wanted if c.lower() not in ours]
    shared = [c for c in wanted if c.lower() in ours]
    renamed = headers.unique_names([f"{c}_lookup" for c in shared], taken=[*ours, *free])
    return {c: dict(zip(shared, renamed)).get(c, c) for c in wanted}


def key_of(df: DataFrame, column: str) -> Column:
    """Normalised key, NULL where there is nothing to match on."""
    if column not in df.columns:
        raise ValueError(f"lookup key {column!r} is not in the table: {df.columns}")
    text = as_text(F.col(f"`{column}`"), df.schema[column].dataType)
    return F.nullif(normalize_key(text), F.lit(""))


def first_per_key(lookup: DataFrame, key_sec: str) -> DataFrame:
    """Lookup rows with ``_key``: the first row of each key, keyless rows left out."""
    order = Window.partitionBy(KEY).orderBy(row_id(lookup, "a lookup join"))
    return (
        lookup.withColumn(KEY, key_of(lookup, key_sec))
        .where(F.col(KEY).isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1")
        .drop("_rank")
    )


def _sides(keys: DataFrame, cutoff: int) -> dict[str, tuple[DataFrame, DataFrame]]:
    """S and L rows of one table for ``weighted score >= cutoff``, by way of meeting."""
    contained = cutoff * 10 >= 900
    window = contained_rule if contained else lambda n: window_rule(n, cutoff)
    return {
        "ratio": gram_members(keys, "key_text", lambda n: ratio_rule(n, cutoff), f"r{cutoff}", True),
        "window": gram_members(keys, "key_text", window, f"w{cutoff}", False, contained),
    }


def _meetings(main_keys: DataFrame, lookup_keys: DataFrame, cutoff: int, way: str) -> DataFrame:
    """Distinct (key_text, lookup_key) pairs that share a gram and pass the native bounds."""
    mine, theirs = _sides(main_keys, cutoff)[way], _sides(lookup_keys, cutoff)[way]

    def meet(many: DataFrame, few: DataFrame, main_is_short: bool) -> DataFrame:
        few = few.select("key", *[F.col(c).alias(f"r_{c}") for c in ("key_text", "pos", "len", *BAGS)])
        joined = salted_join(many, few, "key_text")
        ours = {c: F.col(c) for c in ("pos", "len", *BAGS)}
        other = {c: F.col(f"r_{c}") for c in ("pos", "len", *BAGS)}
        short, long = (ours, other) if main_is_short else (other, ours)
        if way == "ratio":
            shift = long["pos"] - short["pos"]
            apart = bag_distance(short["parity"], long["parity"])
            fits = ratio_compatible(short["len"], long["len"], shift, shift, cutoff) & (
                100 * apart <= (100 - cutoff) * (short["len"] + long["len"])
            )
        else:
            # A winning window covers at least this part of the shorter text: 5/7 of it at 75, at 90 all of it.
            lacking = bag_excess(short["mask"], long["mask"])
            covered = (180 - cutoff) * lacking <= 2 * (90 - cutoff) * short["len"]
            fits = (2 * long["len"] >= 3 * short["len"]) & (long["len"] <= 8 * short["len"]) & covered
        return joined.where(fits).select("key_text", F.col("r_key_text").alias("lookup_key"))

    # Each side publishes its rarest grams, as counted on the other side.
    main_short = rarest_grams(mine[0], theirs[1], "key_text")
    lookup_short = rarest_grams(theirs[0], mine[1], "key_text")
    pairs = meet(main_short, theirs[1], True).unionByName(meet(mine[1], lookup_short, False))
    return pairs.distinct().repartition(shuffle_partitions(main_keys), "key_text", "lookup_key")


def scored_candidates(main_keys: DataFrame, lookup_keys: DataFrame, cutoff: int) -> DataFrame:
    """(key_text, lookup_key, score) for every pair with a score of at least ``cutoff``.

    Keys hold no white space, so the token forms of the score never win.  A pair
    may appear twice, once for each part of the score.
    """
    main_keys, lookup_keys = with_letter_bag(main_keys, "key_text"), with_letter_bag(lookup_keys, "key_text")
    a, b = F.col("key_text"), F.col("lookup_key")
    total = F.length(a) + F.length(b)
    allowed = F.floor(total * (100 - cutoff) / 100)
    by_ratio = (
        _meetings(main_keys, lookup_keys, cutoff, "ratio")
        .where(similarity.no_farther(a, b, allowed))
        .withColumn("distance", total - 2 * similarity.lcs_length(a, b))
        .where(F.col("distance") <= allowed)
        .select("key_text", "lookup_key", ((1 - F.col("distance") / total) * 100).alias("score"))
    )
    if cutoff > CONTAINED:
        return by_ratio
    main_shorter = F.length(a) <= F.length(b)
    windows = _meetings(main_keys, lookup_keys, cutoff, "window").select(
        "key_text", "lookup_key",
        F.when(main_shorter, a).otherwise(b).alias("short"), F.when(main_shorter, b).otherwise(a).alias("long"),
    )
    if cutoff == CONTAINED:
        by_window = windows.where(F.contains("long", "short")).select(
            "key_text", "lookup_key", F.lit(90.0).alias("score")
        )
    else:
        # The letters outside the common ones, which make up at least cutoff / (180 - cutoff) of the shorter text.
        reachable = F.floor(F.length("long") + F.length("short") * (180 - 3 * cutoff) / (180 - cutoff))
        score = F.col("partial") * 0.9
        by_window = (
            windows.where(similarity.no_farther(F.col("short"), F.col("long"), reachable))
            .withColumn("partial", similarity.partial_ratio(F.col("short"), F.col("long")))
            # A hair under the cutoff: equal fractions may differ in the last bit.
            .where(score >= cutoff - 1e-9)
            .select("key_text", "lookup_key", score.alias("score"))
        )
    return by_ratio.unionByName(by_window)


def fuzzy_key_map(main_keys: DataFrame, lookup_keys: DataFrame, threshold: int = P.LOOKUP_CUTOFF) -> DataFrame:
    """(key_text, lookup_key) best match with a score of ``threshold`` or more; the earliest key wins a tie.

    ``main_keys`` has ``key_text``; ``lookup_keys`` has ``key_text`` and ``ord``.
    The search runs at falling cutoffs: close matches are found with long, rare
    grams, and only the keys still without one go on to the looser search.
    """
    lookup_keys = cut(lookup_keys)
    remaining = cut(main_keys)
    order = lookup_keys.select(F.col("key_text").alias("lookup_key"), "ord")
    found = []
    tiers = (CONTAINED, threshold) if threshold < CONTAINED else (threshold,)
    for i, cutoff in enumerate(tiers):
        best = cut(
            scored_candidates(remaining, lookup_keys.select("key_text"), cutoff)
            .join(order, "lookup_key")
            .groupBy("key_text")
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "lookup_key")).alias("b"))
            .select("key_text", F.col("b.lookup_key").alias("lookup_key"))
        )
        found.append(best)
        if i + 1 < len(tiers):
            remaining = cut(remaining.join(best, "key_text", "left_anti"))
    return reduce(DataFrame.unionByName, found)


def lookup_join(
    main: DataFrame, lookup: DataFrame, key_main: str, key_sec: str, fuzzy: bool = False,
    threshold: int = P.LOOKUP_CUTOFF,
) -> LookupResult:
    """Left join ``lookup`` into ``main`` on the normalised key; row count unchanged.

    NULL and empty keys never match, the first lookup row of a key wins, and the
    lookup key column is not added.  With ``fuzzy``, a key without an exact
    partner takes the most similar lookup key, if its score reaches ``threshold``
    (a whole number above 60).  The boolean ``_matched`` column
    tells which rows were enriched; ``strip_matched`` removes it.
    """
    if not (isinstance(threshold, int) and LEAST_THRESHOLD < threshold <= 100):
        raise ValueError(f"the threshold must be a whole number from {LEAST_THRESHOLD + 1} to 100, not {threshold!r}")
    names = added_names(main, lookup, key_sec)
    firsts = first_per_key(lookup, key_sec)
    keyed = main.withColumn(KEY, key_of(main, key_main))
    partner = firsts.select(
        F.col(KEY),
        *[F.col(f"`{old}`").alias(new) for old, new in names.items()],
        F.lit(True).alias(MATCHED),
    )
    if fuzzy:
        exact = firsts.select(F.col(KEY).alias("key_text"), F.col(ROW_ID).alias("ord"))
        open_keys = (
            keyed.where(F.col(KEY).isNotNull())
            .select(F.col(KEY).alias("key_text"))
            .distinct()
            .join(exact, "key_text", "left_anti")
        )
        found = fuzzy_key_map(open_keys, exact, threshold)
        near = found.join(partner, found["lookup_key"] == partner[KEY]).select(
            F.col("key_text").alias(KEY), *names.values(), MATCHED
        )
        partner = partner.unionByName(near)
    # Keyless rows match nothing: give each a private key, or they would all
    # meet in one task.  Normalised keys hold word characters only.
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*_spread_columns(main)).cast("string"))
    keyed = keyed.withColumn(KEY, F.coalesce(F.col(KEY), spread))
    joined = keyed.join(partner, KEY, "left").select(
        *[F.col(f"`{c}`") for c in main.columns],
        *[F.col(f"`{c}`") for c in names.values()],
        F.coalesce(MATCHED, F.lit(False)).alias(MATCHED),
    )
    return LookupResult(joined, list(names.values()))


def _spread_columns(main: DataFrame) -> list[Column]:
    if ROW_ID in main.columns:
        return [F.col(ROW_ID)]
    return [F.col(f"`{c}`") for c in main.columns]


def strip_matched(df: DataFrame) -> DataFrame:
    return df.drop(MATCHED)


def match_count(joined: DataFrame) -> DataFrame:
    """One row: rows in, rows enriched."""
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(MATCHED)).alias("matched")
    )
