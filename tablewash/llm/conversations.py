"""Cheapest repair of damaged conversations, with the ASCII-least list of edits among the cheapest.

1. *Order.*  The rows are range-partitioned and sorted by conversation, turn, role and text and
   written once; file and row number in the file then are the order of the rows.
2. *Faults.*  The first row of each (conversation, role, text) comes from an aggregate; each row
   becomes one symbol: its role's initial, or that it must go, and whether its end is cut off.
3. *Pieces.*  A conversation is decided in pieces of at most ``PIECE`` rows, each in its own task's
   stream.  A piece gives, for each pair of role states, the least weight of the edits that lead
   from the one to the other.  A weight is one integer: its high digits are the cost, its low digits
   the audit letters at fixed places (D, I, K, R as 1 to 4), the places after the last letter zero.
   So the integer minimum over the edges of the graph (row, state) decides cost and tie at once.
4. *Joining.*  The pieces of a conversation are joined from the last to the first by the same minimum.
   The whole audit goes into the result; its slices go back to the pieces.
5. *Repair.*  Rows and slices of a conversation are streamed in order through one hash.

A conversation of any length is never held whole: step 3 holds a piece, step 4 the audits (one
letter a row, part of the result), step 5 a slice and a batch; SHA-256 itself is sequential.

Defined cases: NULL role and text are one space, as are NULL ids and turns in the text that draws
the damage; a NULL ``conv_id`` is a conversation of its own; rows of one turn go by the first 16
characters of the role, the first 64 of the text and a hash of both, so copies are adjacent; a role's initial is its first character, none if it is empty.  Roles and
texts are compared by two 64-bit hashes.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

PIECE = 1024
# Costs of the edits, and of a row that stays although its end is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LETTERS = "DIKR"  # in ASCII order; 0 ends an audit
DIGIT_BITS = 3
# Role states: nothing yet, after the system row, after a user's row, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\x0c\r"

PIECES = "conv_id {id}, file string, part bigint, rows bigint, faults array<bigint>, turns array<bigint>, initials string, weights array<struct<cost:bigint,audit:string>>"
SLICES = "conv_id {id}, file string, part bigint, slice string, counts array<bigint>, audit string"
HASHES = "conv_id {id}, repaired_sha256 string"


class Weights:
    """Integers that hold a cost and an audit of at most ``places`` letters."""

    def __init__(self, places: int):
        self.shift = places * DIGIT_BITS
        self.ones = (1 << self.shift) - 1
        self.lead = {c: (i + 1) << (self.shift - DIGIT_BITS) for i, c in enumerate(LETTERS)}

    def before(self, letter: str, cost: int, weight: int) -> int:
        """The weight of an audit with one more edit in front; the place that is dropped at the end is zero."""
        audit = self.lead[letter] | ((weight & self.ones) >> DIGIT_BITS)
        return (((weight >> self.shift) + cost) << self.shift) | audit

    def read(self, weight: int) -> tuple[int, str]:
        digits = f"{weight & self.ones:0{max(1, self.shift // DIGIT_BITS)}o}".rstrip("0")
        return weight >> self.shift, digits.translate(str.maketrans("1234", LETTERS))

    def write(self, cost: int, audit: str) -> int:
        digits = audit.translate(str.maketrans(LETTERS, "1234"))
        return (cost << self.shift) | (int(digits or "0", 8) << (self.shift - DIGIT_BITS * len(audit)))


def _inserted(weights: Weights, layer: list[int | None]) -> list[int | None]:
    """The least weights where further rows may be put in first; more than three in a row only go round in a circle."""
    best = list(layer)
    for _ in range(3):
        for state, to in NEXT.items():
            if best[to] is not None:
                weight = weights.before("I", INSERT, best[to])
                best[state] = weight if best[state] is None else min(best[state], weight)
    return best


def _decide(symbols: str) -> list[tuple[int, str] | None]:
    """For each state before the rows and each after them (state before * 4 + state after) the cost and the audit.

    Symbols: ``x`` must go, ``s``, ``u``, ``a`` by initial, ``o`` another role; in upper case where the end is cut off.
    """
    weights = Weights(4 * len(symbols) + 3)
    out: list[tuple[int, str] | None] = [None] * 16
    for end in STATES:
        layer: list[int | None] = [None] * 4
        layer[end] = 0
        # Insertions after the last row belong to this piece; a piece after it begins with a row.
        layer = _inserted(weights, layer)
        for symbol in reversed(symbols):
            cut = TRUNCATED if symbol.isupper() else 0
            new: list[int | None] = []
            for state in STATES:
                ways = []
                if layer[state] is not None:
                    ways.append(weights.before("D", DELETE, layer[state]))
                if symbol != "x":
                    kept, named = KEEP.get((state, symbol.lower())), NEXT[state]
                    if kept is not None and layer[kept] is not None:
                        ways.append(weights.before("K", cut, layer[kept]))
                    if layer[named] is not None:
                        ways.append(weights.before("R", REROLE + cut, layer[named]))
                new.append(min(ways, default=None))
            layer = _inserted(weights, new)
        for state in STATES:
            if layer[state] is not None:
                out[4 * state + end] = weights.read(layer[state])
    return out


_decide_short = lru_cache(1 << 14)(_decide)


def decide(symbols: str) -> list[tuple[int, str] | None]:
    return _decide_short(symbols) if len(symbols) <= 32 else _decide(symbols)


def join_pieces(pieces: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """The cheapest edits of a whole conversation from those of its pieces in order."""
    best: list[tuple[int, str] | None] = [(0, "") if s in ACCEPTED else None for s in STATES]
    for piece in reversed(pieces):
        ways = [[(piece[4 * s + e], best[e]) for e in STATES if piece[4 * s + e] and best[e]] for s in STATES]
        places = max((len(a[1]) + len(b[1]) for w in ways for a, b in w), default=0)
        weights = Weights(places)
        best = [weights.read(min(weights.write(a[0] + b[0], a[1] + b[1]) for a, b in w)) if w else None for w in ways]
    return best[START]


def cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """The letters of each piece; those put in after its last row go with it."""
    out, at = [], 0
    for n in sizes:
        begin, left = at, n
        while left or (at < len(audit) and audit[at] == "I"):
            left -= audit[at] != "I"
            at += 1
        out.append(audit[begin:at])
    return out


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


_WEIGHT = pa.struct([("cost", pa.int64()), ("audit", pa.string())])


def piece_maker(kind: pa.DataType):
    """Rows (conversation, file, part, turn, initial, symbol) in order to one row per piece."""
    schema = pa.schema([("conv_id", kind), ("file", pa.string()), ("part", pa.int64()), ("rows", pa.int64()), ("faults", pa.list_(pa.int64())),
                        ("turns", pa.list_(pa.int64())), ("initials", pa.string()), ("weights", pa.list_(_WEIGHT))])

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (conv, file, part), group in groupby(rows, key=lambda r: r[:3]):
            _, _, _, turns, initials, symbols, faults = zip(*group, strict=True)
            known = [t for t in turns if t is not None]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            counts = [*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal]
            ways = [None if w is None else {"cost": w[0], "audit": w[1]} for w in decide("".join(symbols))]
            yield conv, file, part, len(symbols), counts, [min(known), max(known), len(set(known))] if known else [], _ends(initials), ways

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(pieces(_sorted_rows(batches)), schema)
    return run


def _ends(initials: tuple[str, ...]) -> str:
    """The first and the last initial, a tab between them."""
    return f"{initials[0]}\t{initials[-1]}"


def joiner(kind: pa.DataType):
    """Pieces in order to their slices of the audit; the first one also has the counts and the whole audit."""
    schema = pa.schema([("conv_id", kind), ("file", pa.string()), ("part", pa.int64()), ("slice", pa.string()),
                        ("counts", pa.list_(pa.int64())), ("audit", pa.string())])

    def slices(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            _, files, parts, sizes, faults, turns, initials, weights = zip(*group, strict=True)
            cost, audit = join_pieces([[w and (w["cost"], w["audit"]) for w in piece] for piece in weights])
            blank, duplicate, truncated, illegal = (sum(c) for c in zip(*faults, strict=True))
            ends = [i.split("\t") for i in initials]
            illegal += sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:], strict=False))
            known = [t for t in turns if t]
            gaps = 0
            if known:
                distinct = sum(t[2] for t in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
                gaps = known[-1][1] - known[0][0] + 1 - distinct
            counts = [gaps, blank, duplicate, truncated, illegal, cost]
            for i, text in enumerate(cut_audit(audit, list(sizes))):
                yield (conv, files[i], parts[i], text, None if i else counts, None if i else audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(slices(_sorted_rows(batches)), schema)
    return run


def repaired(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """Roles and texts of a repaired conversation from (slice, role, text) in order, slices before their rows."""
    state, letters = START, iter("")
    for piece, role, text in rows:
        if piece is not None:
            letters = iter(piece)
            # Rows put in before the first row of the piece.
            pending = next(letters, None)
            while pending == "I":
                state = NEXT[state]
                yield ROLES[state], ""
                pending = next(letters, None)
            continue
        if pending == "K":
            state = KEEP[state, role[:1]]
            yield role, text
        elif pending == "R":
            state = NEXT[state]
            yield ROLES[state], text
        pending = next(letters, None)
        while pending == "I":
            state = NEXT[state]
            yield ROLES[state], ""
            pending = next(letters, None)


def hasher(kind: pa.DataType):
    """Rows (conversation, file, part, order, slice, role, text) in order to the digest of each repaired conversation."""
    schema = pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())])

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            digest, first = hashlib.sha256(), True
            for role, text in repaired(r[4:] for r in group):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            yield conv, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(digests(_sorted_rows(batches)), schema)
    return run


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` after the damage that each row's id and turn draw."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fault")
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), drawn)
    hurt = plain.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy"))
    return hurt.drop("copy")


def _fault(text: Column, first: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return (F.when(bare == "", "blank").when(~first, "duplicate")
            .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))


def repair(rows: DataFrame) -> DataFrame:
    """Per ``conv_id`` of (damaged) ``rows`` the counts of faults, ``cost``, ``audit`` and ``repaired_sha256``."""
    spark = rows.sparkSession
    kind_sql = rows.schema["conv_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind_sql]
    # Short keys: bounds of the ranges are drawn from a sample of them.  Rows that are equal in all four
    # columns may stand in any order; the last key only spreads them.
    keys = {"k_role": F.left("role", F.lit(16)), "k_text": F.left("text", F.lit(64)), "k_hash": F.xxhash64("role", "text"),
            "spread": F.monotonically_increasing_id()}
    order = ["conv_id", "turn", *keys]
    placed = rows.select("conv_id", "turn", "role", "text").withColumns(keys)
    placed = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*keys), "conversations")
    # Files are numbered by range.
    number = F.concat(*[F.lpad(F.regexp_extract("_metadata.file_name", p, 1), 12, "0") for p in (r"^part-(\d+)", r"-c(\d+)\.")])
    placed = placed.select("*", number.alias("file"), F.col("_metadata.row_index").alias("row"),
                           F.expr(f"_metadata.row_index div {PIECE}").alias("part"))

    small = placed.select(
        "conv_id", "turn", "file", "row", "part", F.substring("role", 1, 1).alias("initial"), F.xxhash64("role", "text").alias("high"),
        F.xxhash64(F.lit("row"), "role", "text").alias("low"), _fault(F.col("text"), F.lit(True)).alias("fault"))
    small = written(small, "symbols")
    place = F.struct("file", "row")
    firsts = small.groupBy("conv_id", "high", "low").agg(F.min(place).alias("first"))
    firsts = firsts.withColumnsRenamed({"conv_id": "f_conv", "high": "f_high", "low": "f_low"})
    same = small["conv_id"].eqNullSafe(firsts["f_conv"]) & (small["high"] == firsts["f_high"]) & (small["low"] == firsts["f_low"])
    judged = small.join(firsts, same)
    fault = F.when((F.col("fault") != "blank") & (F.col("first") != place), "duplicate").otherwise(F.col("fault"))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    judged = judged.withColumn("fault", fault).select("conv_id", "file", "part", "row", "turn", "initial", symbol.alias("symbol"), "fault")

    keys = ["conv_id", "file", "part"]
    ordered = judged.repartition(*keys).sortWithinPartitions(*keys, "row").drop("row")
    pieces = written(ordered.mapInArrow(piece_maker(kind), PIECES.format(id=kind_sql)), "pieces")
    ordered = pieces.repartition("conv_id").sortWithinPartitions(*keys)
    slices = written(ordered.mapInArrow(joiner(kind), SLICES.format(id=kind_sql)), "slices")

    marks = slices.select(*keys, F.lit(-1).cast("bigint").alias("row"), "slice", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = placed.select(*keys, "row", F.lit(None).cast("string").alias("slice"), "role", "text")
    ordered = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions(*keys, "row")
    digests = ordered.mapInArrow(hasher(kind), HASHES.format(id=kind_sql)).withColumnRenamed("conv_id", "h_conv")
    totals = slices.where("counts IS NOT NULL")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = totals.join(digests, totals["conv_id"].eqNullSafe(digests["h_conv"]))
    return out.select("conv_id", *[F.col("counts")[i].alias(c) for i, c in enumerate(names)], "audit", "repaired_sha256")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows``, also where the damage left no row."""
    fixed = repair(damage(rows)).withColumnRenamed("conv_id", "r_conv")
    ids = rows.select("conv_id").distinct()
    joined = ids.join(fixed, ids["conv_id"].eqNullSafe(fixed["r_conv"]), "left").drop("r_conv")
    return joined.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna(
        {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
