"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.store import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its smallest neighbour to its larger (or smaller) neighbours."""
    if large:
        near = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``links(a, b)``; the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Each round is a table in the shared folder.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links, before = stored(links, "links"), None
    while True:
        links = stored(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionAll(roots)
