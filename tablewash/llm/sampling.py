"""A bounded draw of rows to learn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 62


def bounded_draw(rows: DataFrame, keys: Sequence[str], text: str | None, max_rows: int, max_bytes: int = 1 << 30) -> DataFrame:
    """At most ``max_rows`` rows with at most ``max_bytes`` of text, drawn by a hash of the keys.

    Copies of a text have keys of their own and are drawn one by one, so a group of copies takes the part of
    the draw that it has of the table.  Texts longer than a hundredth of ``max_bytes`` are not drawn.  The draw
    does not depend on how the table is split.  Only hashes and sizes of about ``max_rows`` rows reach the driver.
    """
    marked = rows.withColumns({
        "_draw": F.pmod(F.xxhash64(F.lit("draw"), *keys), F.lit(SPAN)), "_size": F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0),
    }).where(F.col("_size") <= max_bytes // 100)
    # A little more than enough rows; the smallest hashes of them are taken.
    share = min(1.0, (max_rows + 6 * max_rows**0.5) / max(1, rows.count()))
    found = marked.where(F.col("_draw") <= int(SPAN * share)).select("_draw", "_size").orderBy("_draw", "_size").limit(max_rows).collect()
    last, taken, size = -1, 0, 0
    for row in found:
        size += row["_size"]
        if size > max_bytes:
            break
        last, taken = row["_draw"], taken + 1
    # Rows that repeat in all keys share a hash; the limit holds for them too.
    return marked.where(F.col("_draw") <= last).limit(taken).drop("_draw", "_size")
