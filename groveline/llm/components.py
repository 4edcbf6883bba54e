"""Connected components of a link table, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b); component: the least node that can be reached.

    Each round every node takes the least label among its neighbours and itself, then that label's own label; so labels travel
    along chains in doubling steps. Each round's labels are written, and a round that changes nothing is the last.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node").select("node", F.least("component", "_near").alias("_to"), F.col("component").alias("_from"))
        jump = labels.select(F.col("node").alias("_to"), F.col("component").alias("_next"))
        now = written(step.join(jump, "_to").select("node", F.least("_to", "_next").alias("component"), (F.least("_to", "_next") != F.col("_from")).alias("changed")))
        labels = now.select("node", "component")
        if now.where("changed").limit(1).count() == 0:
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` as ``components`` gives them, when links(a, b) come to those that made them, written.

    Only the new links are followed, each as a link of the components that its ends are in by now; a component whose name changes is
    renamed once.
    """
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    step = components(written(ends.distinct()))
    new = step.join(labels, "node", "left_anti")
    known = labels.join(step.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    return written(known.select("node", F.coalesce("_to", "component").alias("component")).unionByName(new.select("node", "component")))
