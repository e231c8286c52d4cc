"""Fuzzy deduplication on one column: drop a row similar to an earlier kept one.

The result is defined by a sequential scan: a value is dropped when its weighted
score against any value kept before it is at least 90.  That is the
lexicographically first maximal independent set of the similarity graph, and
rounds reach it in parallel (Blelloch, Fineman, Shun, SPAA 2012): keep what has
no open earlier neighbour, drop what has a kept one, repeat.  Along a chain, where
each value has one open earlier neighbour, decisions are passed by pointer doubling,
so the jobs grow with the logarithm of the chain, not with its length.

Only distinct values take part.  Values meet on shared-gram keys, and per key
every open value is compared with the first ``window`` open ones only, so a key
that a third of all values share costs each of them ``window`` comparisons, not
one per pair.  A value that might have earlier partners outside the window stays
open for the next, wider round; no partner is ever left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.functions import patterns as P
from tablewash.functions import similarity
from tablewash.functions.text import as_text
from tablewash.operators.candidates import (
    BAGS,
    MAX_GRAM,
    bag_distance,
    bag_excess,
    contained_rule,
    gram_members,
    rarest_grams,
    ratio_compatible,
    ratio_rule,
    salted_join,
    shuffle_partitions,
    with_letter_bag,
)
from tablewash.operators.checkpoints import cut
from tablewash.operators.headers import ROW_ID
from tablewash.operators.ordering import row_id

FIRST_WINDOW = 64
WINDOW_GROWTH = 4
# Sub-groups in which a hot key is ranked before its final ranking.
RANK_SALTS = 64

OPEN, KEPT, DROPPED = 0, 1, 2
# The four ways to reach a score of 90; each has its own keys and its own test.
RATIO, CONTAINED, PIECES, WORDS = 0, 1, 2, 3


def _word_members(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists that share all words of the shorter list, or all but a tenth of its letters.

    With the unshared words at most (U - 10) / 10 letters long, U the length of
    the shorter list, words with more letters than that include a shared one.
    """
    limit = F.greatest(F.floor((F.col("total") - 10) / 10), F.lit(0)).cast("int")
    entries = words.withColumn("limit", limit).select(
        "id", "len", "several", "limit", *BAGS, F.explode(F.array_distinct("words")).alias("word")
    ).select(
        "id", "len", "several", "limit", *BAGS, F.length("word").alias("weight"),
        F.xxhash64(F.lit("w"), "word").alias("key"), F.lit(0).alias("pos"),
    )
    return entries, entries.drop("weight", "limit")


def _piece_members(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of nearly the same words share a piece of a word.

    With U letters in the shorter list at most U / 9 insertions and deletions
    are allowed, so U // 9 + 1 disjoint pieces inside words suffice.  Word order
    is free, so positions are not used.
    """
    allowed = F.floor(F.col("total") / 9).cast("int")
    words = words.withColumn("distinct", F.array_distinct("words"))

    def parts(q: int, step: int) -> Column:
        return F.flatten(
            F.transform(
                "distinct",
                lambda w: F.when(
                    F.length(w) >= q,
                    F.transform(
                        F.sequence(F.lit(1), F.length(w) - q + 1, F.lit(step)),
                        lambda i: F.substr(w, i, F.lit(q)),
                    ),
                ).otherwise(F.array().cast("array<string>")),
            )
        )

    def count(q: int) -> Column:
        return F.aggregate("distinct", F.lit(0), lambda n, w: n + F.floor(F.length(w) / q).cast("int"))

    # The longest pieces that leave one to spare, else the longest that suffice.
    size = F.lit(1)
    for spare, q in [(0, 2), (0, 3), (0, MAX_GRAM), (1, 3), (1, MAX_GRAM)]:
        size = F.when(count(q) > allowed + spare, F.lit(q)).otherwise(size)
    sized = words.withColumns({"size": size, "limit": allowed})
    published = F.array().cast("array<string>")
    for q in range(1, MAX_GRAM + 1):
        published = F.when(F.col("size") == q, parts(q, q)).otherwise(published)
    every = F.flatten(F.array(*[F.array_distinct(parts(q, 1)) for q in range(1, MAX_GRAM + 1)]))

    def rows(found: Column) -> DataFrame:
        return sized.select("id", "len", "several", "limit", *BAGS, F.explode(found).alias("gram")).select(
            "id", "len", "several", "limit", *BAGS, F.lit(1).alias("weight"),
            F.xxhash64(F.lit("p"), "gram").alias("key"), F.lit(0).alias("pos"),
        )

    return rows(published), rows(every).drop("limit", "weight")


def _split_by_word_count(short: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two texts of one bare word never meet on word keys: their ratio says it all.

    Key side m serves shorter lists of several words (or one in white space),
    side o those of one bare word.
    """
    s = short.withColumn("key", F.xxhash64("key", F.when(F.col("several"), "m").otherwise("o")))
    sides = F.when(F.col("several"), F.array(F.lit("m"), F.lit("o"))).otherwise(F.array(F.lit("m")))
    l = long.withColumn("side", F.explode(sides)).withColumn("key", F.xxhash64("key", "side"))
    return s.drop("several"), l.drop("several", "side")


def _members(values: DataFrame) -> DataFrame:
    """(key, kind, role, id, pos, len) rows on which values meet."""
    texts = values.select("id", "value", *BAGS)
    # A repeated word counts once in one of the word tests: no bag speaks for both.
    once = F.size("words") == F.size(F.array_distinct("words"))
    words = values.where(F.size("words") > 0).select(
        "id", "words", F.length("value").alias("len"), F.length("sorted").alias("total"),
        (F.col("value") != F.get("words", F.lit(0))).alias("several"), *[F.when(once, F.col(c)).alias(c) for c in BAGS],
    )
    sides = {
        RATIO: gram_members(texts, "value", lambda n: ratio_rule(n, P.DEDUPE_CUTOFF), "r", True),
        CONTAINED: gram_members(texts, "value", contained_rule, "c", False, contained=True),
        PIECES: _split_by_word_count(*_piece_members(words)),
        WORDS: _split_by_word_count(*_word_members(words)),
    }
    parts = []
    for kind, (short, long) in sides.items():
        short = rarest_grams(short, long, "id")
        # An L row is of use only where some shorter text published the gram.
        long = long.join(short.select("key").distinct(), "key", "left_semi")
        parts += [
            side.select("key", F.lit(kind).alias("kind"), F.lit(role).alias("role"), "id", "pos", "len", *BAGS)
            for role, side in (("S", short), ("L", long))
        ]
    return reduce(DataFrame.unionByName, parts)


def _leaders(members: DataFrame, window: int) -> DataFrame:
    """First ``window`` + 1 members of each (key, role), ranked in two skew-safe stages."""
    salt = F.pmod(F.xxhash64("id"), F.lit(RANK_SALTS))
    first = Window.partitionBy("key", "role", "salt").orderBy("id")
    second = Window.partitionBy("key", "role").orderBy("id")
    return (
        members.groupBy("key", "role", salt.alias("salt"), "id", "len", *BAGS)
        .agg(F.min("pos").alias("l_low"), F.max("pos").alias("l_high"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= window + 1)
        .withColumn("rank", F.row_number().over(second))
        .where(F.col("rank") <= window + 1)
        .withColumn("beyond", F.col("rank") > window)
        .withColumn("other", F.when(F.col("role") == "S", "L").otherwise("S"))
        # A leader meets the other role; the first one outside the window marks both.
        .select("*", F.explode(
            F.when(F.col("beyond"), F.array("role", "other")).otherwise(F.array("other"))
        ).alias("meets"))
        .select(
            "key",
            F.col("meets").alias("role"),
            F.col("role").alias("l_role"),
            F.col("id").alias("l_id"),
            F.col("len").alias("l_len"),
            "l_low",
            "l_high",
            *[F.col(c).alias(f"l_{c}") for c in BAGS],
            "beyond",
        )
    )


def _plausible() -> Column:
    """Length, position and letter bounds of a member and a leader, by kind."""
    member_short = F.col("role") == "S"
    s_len = F.when(member_short, F.col("len")).otherwise(F.col("l_len"))
    l_len = F.when(member_short, F.col("l_len")).otherwise(F.col("len"))
    low = F.when(member_short, F.col("l_low") - F.col("pos")).otherwise(F.col("pos") - F.col("l_high"))
    high = F.when(member_short, F.col("l_high") - F.col("pos")).otherwise(F.col("pos") - F.col("l_low"))
    apart = bag_distance(F.col("parity"), F.col("l_parity"))
    mine, theirs = F.col("mask"), F.col("l_mask")
    lacking = bag_excess(
        F.when(member_short, mine).otherwise(theirs), F.when(member_short, theirs).otherwise(mine)
    )
    near = 2 * F.greatest("len", "l_len") < 3 * F.least("len", "l_len")
    total = s_len + l_len
    return (
        F.when(
            F.col("kind") == RATIO,
            ratio_compatible(s_len, l_len, low, high, P.DEDUPE_CUTOFF) & (10 * apart <= total),
        )
        .when(F.col("kind") == CONTAINED, (2 * l_len >= 3 * s_len) & (l_len <= 8 * s_len) & (lacking == 0))
        # A list without words of its own counts one separator more.
        .when(F.col("kind") == PIECES, near & F.coalesce(19 * apart <= total + 2, F.lit(True)))
        # Unshared letters of the shorter list are at most a tenth of it.
        .otherwise(near & F.coalesce(10 * lacking <= F.greatest(s_len - 10, F.lit(0)), F.lit(True)))
    )


def _similar_pairs(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Those (later, earlier, kind) pairs that pass the test of their kind."""
    def sides(kind: int, *columns: str) -> DataFrame:
        out = pairs.where(F.col("kind") == kind).select("later", "earlier")
        for end, mark in (("later", "a"), ("earlier", "b")):
            texts = values.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{mark}") for c in columns])
            out = out.join(texts, end)
        return out

    def scored(df: DataFrame, x: Column, y: Column, allowed: Column) -> DataFrame:
        distance = F.length(x) + F.length(y) - 2 * similarity.lcs_length(x, y)
        return df.where(distance <= allowed).select("later", "earlier")

    a, b = F.col("value_a"), F.col("value_b")
    allowed = F.floor((F.length(a) + F.length(b)) / 10)
    by_ratio = scored(
        sides(RATIO, "value").where(similarity.no_farther(a, b, allowed)), a, b, allowed
    )
    longer_first = F.length(a) >= F.length(b)
    contained = sides(CONTAINED, "value").where(
        F.when(longer_first, F.contains(a, b)).otherwise(F.contains(b, a))
    ).select("later", "earlier")

    def word_sets(df: DataFrame) -> DataFrame:
        df = df.withColumns({
            "both": F.array_intersect("words_a", "words_b"),
            "rest_a": F.array_sort(F.array_except("words_a", "words_b")),
            "rest_b": F.array_sort(F.array_except("words_b", "words_a")),
        })
        return df.withColumns({
            "shared": F.length(similarity.joined(F.col("both"))),
            "rest_a": similarity.joined(F.col("rest_a")), "rest_b": similarity.joined(F.col("rest_b")),
            "gap": F.when(F.size("both") > 0, F.lit(2)).otherwise(F.lit(0)),
        })

    least = F.least(F.length("rest_a"), F.length("rest_b"))
    by_words = word_sets(sides(WORDS, "words")).where(
        (F.col("shared") > 0) & ((least == 0) | (9 * (1 + least) <= F.col("shared")))
    ).select("later", "earlier")

    # Sorted words, or the differing ones, within a nineteenth of their length.
    la, lb = F.length("sorted_a"), F.length("sorted_b")
    allowed = F.floor((la + lb) / 19)
    near = sides(PIECES, "words", "sorted", "letters", "set_letters").where(
        similarity.no_farther(F.col("letters_a"), F.col("letters_b"), allowed)
        | similarity.no_farther(F.col("set_letters_a"), F.col("set_letters_b"), allowed)
    )
    near = word_sets(near)
    rest_total = 2 * F.col("shared") + F.col("gap") + F.length("rest_a") + F.length("rest_b")
    near = near.select(
        "later", "earlier", F.inline(F.array(
            F.struct(F.col("sorted_a").alias("x"), F.col("sorted_b").alias("y"), F.floor((la + lb) / 19).alias("allowed")),
            F.struct(F.col("rest_a").alias("x"), F.col("rest_b").alias("y"), F.floor(rest_total / 19).alias("allowed")),
        )),
    ).where(similarity.no_farther(F.col("x"), F.col("y"), F.col("allowed")))
    by_pieces = scored(near, F.col("x"), F.col("y"), F.col("allowed"))
    return by_ratio.unionByName(contained).unionByName(by_words).unionByName(by_pieces).distinct()


def _advance(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One keep-and-drop step: drop next to a kept value, keep with no open earlier neighbour."""
    status = state.select(F.col("id").alias("earlier"), F.col("status").alias("s"))
    seen = (
        edges.join(status, "earlier")
        .groupBy("later")
        .agg(
            F.bool_or(F.col("s") == KEPT).alias("near_kept"),
            F.bool_or(F.col("s") == OPEN).alias("near_open"),
        )
        .withColumnRenamed("later", "id")
    )
    is_open = F.col("status") == OPEN
    return state.join(seen, "id", "left").select(
        "id",
        "incomplete",
        F.when(is_open & F.coalesce("near_kept", F.lit(False)), F.lit(DROPPED))
        .when(is_open & ~F.col("incomplete") & ~F.coalesce("near_open", F.lit(False)), F.lit(KEPT))
        .otherwise(F.col("status"))
        .alias("status"),
    )


def _pass_along(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Decide every open value that hangs on a decided one by a chain, however long.

    A value with one open earlier neighbour and no kept one is the opposite of that neighbour.  Such values
    point to their neighbour; pointers are doubled until each leads to a value that decides by itself or
    must wait, so a chain takes as many joins as its length has binary digits.
    """
    status = state.select(F.col("id").alias("earlier"), F.col("status").alias("s"))
    is_open = F.col("s") == OPEN
    seen = edges.join(status, "earlier").groupBy(F.col("later").alias("id")).agg(
        F.bool_or(F.col("s") == KEPT).alias("near_kept"),
        F.count_if(is_open).alias("n_open"),
        F.min(F.when(is_open, F.col("earlier"))).alias("parent"),
    )
    n_open = F.coalesce("n_open", F.lit(0))
    # What a value is by itself; NULL: the opposite of its neighbour.
    root = (
        F.when(F.coalesce("near_kept", F.lit(False)), F.lit(DROPPED))
        .when(F.col("incomplete") | (n_open > 1), F.lit(OPEN))
        .when(n_open == 0, F.lit(KEPT))
    )
    links = state.where(F.col("status") == OPEN).join(seen, "id", "left").withColumn("root", root)
    links = cut(links.select(
        "id", F.when(F.col("root").isNull(), F.col("parent")).otherwise(F.col("id")).alias("to"),
        F.col("root").isNull().alias("flip"), "root",
    ))
    while not links.where("root is null").isEmpty():
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("flip").alias("f"), F.col("root").alias("r"))
        links = cut(links.join(ahead, "to").select(
            "id", F.col("next").alias("to"), (F.col("flip") != F.col("f")).alias("flip"), F.col("r").alias("root")))
    decided = links.select("id", F.when(F.col("flip") & (F.col("root") != OPEN), KEPT + DROPPED - F.col("root"))
                           .otherwise(F.col("root")).alias("found"))
    return state.join(decided, "id", "left").select("id", "incomplete", F.coalesce("found", "status").alias("status"))


def _settle(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Repeat keep-and-drop on the known edges until nothing changes."""
    open_before, rounds = None, 0
    while True:
        # Two steps, keep and then drop, between checkpoints; what they leave may be chains.
        state = _advance(_advance(state, edges), edges)
        if rounds:
            state = _pass_along(cut(state), edges)
        state = cut(state)
        still_open = state.where(F.col("status") == OPEN).count()
        if still_open in (0, open_before):
            return state
        open_before, rounds = still_open, rounds + 1


def greedy_first_values(values: DataFrame, window: int = FIRST_WINDOW) -> DataFrame:
    """Ids of the kept values; ``values`` has a unique, ordered ``id`` and a ``value``."""
    words = similarity.tokens(F.col("value"))
    values = with_letter_bag(values, "value").select("id", "value", *BAGS, F.array_sort(words).alias("words"))
    values = cut(values.select(
        "id", "value", "words", *BAGS,
        similarity.joined(F.col("words")).alias("sorted"),
        similarity.letters(F.col("value")).alias("letters"),
        similarity.letters(similarity.joined(F.array_distinct("words"))).alias("set_letters"),
    ))
    members = cut(_members(values))
    remaining = values.select("id")
    kept = []
    while True:
        leaders = _leaders(members, window)
        earlier = F.col("l_id") < F.col("id")
        own_frontier = (F.col("role") == F.col("l_role")) & (F.col("l_id") == F.col("id"))
        # Outside the window itself, or with partners there that come earlier: not yet decidable.
        met = salted_join(members, leaders, "id", "role").where(
            F.when(F.col("beyond"), earlier | own_frontier).otherwise(earlier & _plausible())
        )
        met = cut(
            met.select(
                F.col("id").alias("later"),
                F.when(~F.col("beyond"), F.col("l_id")).alias("earlier"),
                F.when(~F.col("beyond"), F.col("kind")).alias("kind"),
            ).distinct().repartition(shuffle_partitions(members), "later", "earlier")
        )
        edges = cut(_similar_pairs(met.where("earlier is not null"), values))
        outside = met.where("earlier is null").select(
            F.col("later").alias("id"), F.lit(True).alias("outside")
        )
        state = remaining.join(outside, "id", "left").select(
            "id", F.coalesce("outside", F.lit(False)).alias("incomplete"), F.lit(OPEN).alias("status")
        )
        state = _settle(state, edges)
        kept.append(state.where(F.col("status") == KEPT).select("id"))
        remaining = state.where(F.col("status") == OPEN).select("id")
        if remaining.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        members = cut(members.join(remaining, "id", "left_semi"))
        window *= WINDOW_GROWTH


def kept_ids(df: DataFrame, column: str, window: int = FIRST_WINDOW) -> DataFrame:
    """The ``_rid`` of each row that stays; see :func:`dedupe_fuzzy`."""
    rid = row_id(df, "fuzzy dedupe")
    text = as_text(F.col(f"`{column}`"), df.schema[column].dataType)
    rows = df.select(text.alias("value"), rid.alias("id"))
    firsts = cut(rows.groupBy("value").agg(F.min("id").alias("id")))
    kept = greedy_first_values(firsts.where("value <> ''"), window)
    kept = kept.unionByName(firsts.where("value is null").select("id"))
    return kept.unionByName(rows.where("value = ''").select("id")).withColumnRenamed("id", ROW_ID)


def dedupe_fuzzy(df: DataFrame, column: str, window: int = FIRST_WINDOW) -> DataFrame:
    """Keep rows whose value is not similar (score 90) to an earlier kept value.

    Rows with an empty text are all kept.  NULL equals only NULL; the first
    NULL row is kept.  Needs a row order; runs jobs when called.
    """
    names = df.columns
    return df.join(kept_ids(df, column, window), ROW_ID, "left_semi").select(*[F.col(f"`{c}`") for c in names])
