"""Connected components of a table of links, by alternating star contractions.

Each round rewires the links of every node to its smallest neighbour. Nodes with many links are no problem: the
smallest neighbour is a minimum, which Spark combines before the shuffle, and the join that hands it out has one
row per node on one side, so that adaptive execution can split the other. Links and results stay in tables;
only their number comes to the driver, to see that nothing moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b, rewired to the smallest neighbour of each node.

    A large star moves a node's larger neighbours, a small star its smaller ones and the node itself.
    """
    down = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    if large:
        both = down.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        moved = both.filter("near > node").join(least, "node").select(F.col("near").alias("a"), F.col("m").alias("b"))
    else:
        least = down.groupBy("node").agg(F.min("near").alias("m"))
        moved = (
            down.join(least, "node")
            .select(F.col("near").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        )
    return moved.filter("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. ``links`` has two columns of one type.

    Nodes without links to other nodes, also those linked to themselves only, are not in the result; NULL ends
    make no link; doubled links count once. An empty table gives an empty result.
    """
    now = written(
        links.toDF("a", "b")
        .filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(max_rounds):
        now = written(_stars(_stars(now, large=True), large=False), "links")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
