"""Connected components of a graph of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of `links` (a, b): label is the smallest node it reaches.

    Each round takes the least label among a node's neighbours, then that
    label's own label, so a chain shrinks by half a round.  Rounds are written
    to the shared folder; nothing is collected but whether labels still move.
    """
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-both")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("low"))
        low = labels.join(near, labels["node"] == near["at"], "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("low"))
        to = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        moved = low.join(to, low["low"] == to["via"], "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), F.col("label").alias("old"))
        moved = scratch.table(moved, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 2}")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
