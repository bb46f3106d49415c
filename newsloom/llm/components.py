"""Connected components of a link table by random-order contraction.

Every round each node picks the neighbour (or itself) with the smallest hash of the round, links are rewritten to the
picked nodes, and loops and repeats go. Nodes shrink by a constant factor a round whatever the shape, chains included,
so the rounds follow the logarithm of the nodes. All steps are joins and partial aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import is_empty, mixed, stored


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked node; root is one node of its component, the same for all of it.

    links holds longs a and b, in any order, repeats and loops allowed. Nodes without a link to another are left out.
    """
    rest = stored(_ordered(links), "links")
    picks: list[DataFrame] = []
    while not is_empty(rest):
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(mixed(c, 101 + len(picks)).alias("h"), F.col(c).alias("v"))
        pick = both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("p")).select(F.col("a").alias("id"), F.col("p.v").alias("root"))
        pick = stored(pick, "picks")
        picks.append(pick)
        left, right = pick.select(F.col("id").alias("a"), F.col("root").alias("ra")), pick.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = stored(_ordered(rest.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
    if not picks:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = picks[-1]
    for pick in reversed(picks[:-1]):
        later = found.select(F.col("id").alias("root"), F.col("root").alias("last"))
        found = pick.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    return found
