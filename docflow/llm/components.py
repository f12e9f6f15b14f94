"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component: the smallest node reachable.  Nodes without links are not listed.

    Each round a node takes the least of its label's label and those of its neighbours, and hands what it found to
    its own old label (hooking), so whole regions move at once and the rounds grow with the logarithm of a chain's
    length.  Rounds go on until no label changes.  Labels are a table in the shared folder, so a round never depends
    on more than the one before it.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        grand = labels.join(up, labels.component == up.at).select("node", "component", "jump")
        near = both.join(grand.select(F.col("node").alias("b"), "jump"), "b").groupBy("a").agg(F.min("jump").alias("near"))
        low = stage(grand.join(near, grand.node == near.a).select("node", F.col("component").alias("was"), F.least("jump", "near").alias("component")), "labels")
        hook = low.groupBy(F.col("was").alias("at")).agg(F.min("component").alias("hook"))
        new = stage(low.join(hook, low.node == hook.at, "left").select("node", "was", F.least("component", "hook").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
