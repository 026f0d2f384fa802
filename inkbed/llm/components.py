"""Connected components of a table of links, by labels that travel along links, hook the labels they replace, and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that can be reached) of every node in links; nulls link nothing.

    Each round takes the least label among neighbours, tells it to the node that the old label names (so that whole trees
    are hooked) and then takes the label of the label: long chains, in any order of ids, take a logarithmic number of
    rounds.  Labels only fall, so rounds go on until none changes.  Only counts come to the driver.  An empty table gives
    an empty one.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = kept(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = kept(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("_near")), "v").groupBy("u").agg(F.min("_near").alias("_near"))
        own = labels.join(near, "u").select("u", F.col("label").alias("_old"), F.least("label", "_near").alias("label"), "_near")
        hooked = own.select(F.col("_old").alias("u"), F.lit(None).alias("_old"), F.col("_near").alias("label"))
        least = own.drop("_near").unionByName(hooked).groupBy("u").agg(F.max("_old").alias("_old"), F.min("label").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("_next"))
        after = kept(least.join(jump, "label").select("u", "_old", F.least("label", "_next").alias("label")), "labels")
        changed = not after.filter(F.col("label") != F.col("_old")).isEmpty()
        discard(last)
        last, labels = after, after.select("u", "label")
        if not changed:
            discard(both)
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
