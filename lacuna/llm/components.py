"""Connected components by label propagation with shortcuts (DataFrame joins only).

Each round hooks every component's label to the smallest label next to it and then halves
the label chains, so the number of rounds grows with the logarithm of the longest path.
Every round's table is written to the shared folder (``spark.checkpoint.dir``); neither
links nor components reach the driver, only the count of labels that still change.  Labels
are pre-aggregated (``min``) before each shuffle, so a hub of any degree is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of its component, for every node in an edge.
    Null ends and loops link nothing."""
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = scratch.write(both.select(F.col(a).alias("a"), F.col(b).alias("b"))
                          .unionByName(both.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct(), "links")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels, old = scratch.write(labels, "labels0"), "labels0"
    for i in range(1, 200):
        near = (links.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("near")))
        seen = (labels.join(near, "node")
                .select("node", "label", F.least("label", "near").alias("best")))
        # hook: the whole old component takes the smallest label any of its nodes sees
        hook = seen.groupBy(F.col("label").alias("old")).agg(F.min("best").alias("new"))
        hooked = seen.join(hook, F.col("label") == F.col("old")).select("node", F.col("label").alias("before"), F.least("best", "new").alias("label"))
        # shortcut: follow the label's own label once
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("top"))
        nxt = (hooked.join(up, F.col("label") == F.col("up"), "left")
               .select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "before"))
        nxt = scratch.write(nxt, f"labels{i}")
        changed = nxt.where("label != before").limit(1).count()
        scratch.drop(old)
        labels, old = nxt.select("node", "label"), f"labels{i}"
        if not changed:
            break
    else:
        raise RuntimeError("components did not converge")
    scratch.drop("links")
    return labels
