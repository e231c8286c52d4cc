"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the nodes at both ends of each of the ``edges`` (a, b) are put together.

    A component takes the smallest label in it; nodes that share a label at the start are
    one component already.  The graph is contracted to labels first.  Each round takes the
    smallest label among the neighbours and then that label's own label, so chains shorten
    by half or better.  Only whether anything changed goes to the driver.
    """
    ends = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a") \
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
    both = written(ends.select("x", "y").union(ends.select("y", "x")).distinct(), "edges")
    now = written(both.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct(), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("y"), F.col("label").alias("near")), "y")
        near = near.groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        step = written(now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(step.join(jump, "label").select("node", "old", F.col("further").alias("label")), "labels")
        changed = after.where("label < old").limit(1).count()
        forget(now)
        forget(step)
        now = after.drop("old")
        if not changed:
            found = now.select(F.col("node").alias("label"), F.col("label").alias("root"))
            out = labels.join(found, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            out = written(out, "labels")
            forget(after)
            forget(both)
            return out
