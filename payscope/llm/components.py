"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so a node with very many links is pre-aggregated before
the shuffle and split by the skew join; no group is gathered.  The links stay in written tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import keep


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v) with ``m``, the least of u and its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("lv")).select(F.col("u").alias("k"), F.least("u", "lv").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).drop("k")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v: longs); component is its smallest reachable node.

    Links of a node to itself and repeated links change nothing; an empty table gives an empty result.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, mark = keep(links, "cc-links"), None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        links = keep(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                     .select("e.u", "e.v").where("u <> v").distinct(), "cc-links")
