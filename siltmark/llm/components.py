"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp names the component by one of its nodes.

    Every node joins its smallest neighbour, then links are rewritten between the joined ones.
    Each round at least halves what is still connected, and every round's tables are written.
    """
    left = stored(links.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        joined = stored(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        if labels is None:
            labels = joined.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            step = joined.select(F.col("u").alias("comp"), "p")
            labels = labels.join(step, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        pu, pv = joined.select("u", F.col("p").alias("pu")), joined.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = left.join(pu, "u").join(pv, "v").where("pu != pv")
        left = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, comp long")
    return stored(labels)
