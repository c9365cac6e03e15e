"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import Space


def components(links: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component of ``links(a, b)``: labels spread along links and jump to
    their own labels, so rounds grow with the logarithm of the longest path."""
    space = Space(links.sparkSession, "components")
    one = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = space.stored(one.unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = space.stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        seen = labels.select(F.col("node").alias("y"), F.col("label").alias("l"))
        least = both.join(seen, "y").groupBy(F.col("x").alias("node")).agg(F.min("l").alias("least"))
        step = labels.join(least, "node").select("node", "label", F.least("label", "least").alias("hop"))
        roots = labels.select(F.col("node").alias("hop"), F.col("label").alias("root"))
        step = space.stored(step.join(roots, "hop").select("node", F.col("label").alias("was"), F.least("hop", "root").alias("label")))
        labels = step.select("node", "label")
        if not step.where("was <> label").limit(1).count():
            return labels.withColumnRenamed("label", "component")
