"""Connected components of a table of links, by alternating star contraction in Spark.

Each round joins every node to its smallest neighbour; labels only ever fall, and rounds go on
until none changes.  Links stay a distributed table; the driver sees one changed-or-not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b); component is its smallest reachable node.

    Links to itself and repeated links are allowed; an empty table gives an empty result.
    Hot nodes: neighbours are only ever reduced by min(), which combines before the shuffle.
    """
    pairs = written(links.select("a", "b").where("a <> b").distinct(), "links")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    label = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        # labels of both ends of every link, the smaller offered to the node and to its old label
        ends = pairs.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        uneven = ends.where("ca <> cb").select(F.greatest("ca", "cb").alias("node"), F.least("ca", "cb").alias("component"))
        offers = written(uneven.groupBy("node").agg(F.min("component").alias("component")), "offers")
        if offers.isEmpty():
            return label
        # hook roots to smaller roots, then let every label follow its root until it stands still
        hooked = label.join(offers.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left")
        label = written(hooked.select("node", F.coalesce("lower", "component").alias("component")), "labels")
        while True:
            root = label.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("lower"))
            jumped = label.join(root, "component", "left").select("node", F.coalesce("lower", "component").alias("component"), F.col("lower").isNotNull().alias("moved"))
            jumped = written(jumped, "labels")
            label = jumped.select("node", "component")
            if jumped.where("moved").isEmpty():
                break
