"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of links (a, b: long): root is the component's smallest node.

    Each round points every node at its smallest neighbour or itself, follows the pointers to their ends by doubling,
    and replaces the links' ends by what they point at. The links that remain join different ends; rounds go on until
    there are none, each at least halving the nodes of a component. The smallest node always points at itself, so it
    ends as the root. Every round's tables are written to the shared folder. Null ends and loops are ignored.
    """
    spark = scratch.spark
    left = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = scratch.table(left, f"{name}_links0")
    known, step = None, 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        to = scratch.table(to.select("node", F.least("node", "low").alias("root")), f"{name}_to{step}_0")
        jump = 0
        while True:
            ends = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jump += 1
            # every root is a node, so the join loses nothing
            further = scratch.table(to.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), f"{name}_to{step}_{jump}")
            to = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        if known is None:
            known = to
        else:
            ends = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = known.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            known = scratch.table(known, f"{name}_known{step}")
        step += 1
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = left.join(a, "a").join(b, "b").where("ra <> rb")
        new = new.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = scratch.table(new, f"{name}_links{step}")
    if known is None:
        known = spark.createDataFrame([], "node long, root long")
    return known
