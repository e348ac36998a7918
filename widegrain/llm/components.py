"""Connected components of a table of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Links of one node that one task has to hold.
LINKS = 256


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that a node reaches, for all nodes of links(a, b).

    Labels spread to neighbours and then jump to their label's label, so rounds
    grow with the logarithm of the longest path.  Nothing is collected but
    counts.  The links of a node with very many are dealt over several tasks,
    each of which gets a copy of its label."""
    links = links.where("a <> b")
    both = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    # degree of every node, carried along with its label
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"), F.ceil(F.count(F.lit(1)) / LINKS).alias("parts"))
    hubs = save(labels.where("parts > 1").select(F.col("node").alias("b"), "parts"), "hubs")
    dealt = both.join(hubs, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "parts"), F.lit(0)).alias("part"))
    labels = labels.select("node", F.least("node", "b").alias("comp"), "parts")
    while True:
        copies = labels.select(F.col("node").alias("b"), "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        near = dealt.join(copies, ["b", "part"]).groupBy("a").agg(F.min("comp").alias("least"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "least").alias("comp"), F.col("comp").alias("was"), "parts")
        spread = save(spread, "labels")
        jump = spread.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        labels = save(spread.join(jump, "comp").select("node", F.least("comp", "far").alias("comp"), "was", "parts"), "labels")
        if labels.where("comp <> was").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp", "parts")
