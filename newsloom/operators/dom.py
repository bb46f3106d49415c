"""The node relation: one row per node, for queries that join nodes across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.columns import let, pin
from newsloom.functions.markup import SKIPPED_TEXT, page_nodes
from newsloom.functions.scans import running_sum


def dom_nodes(captures: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """page_id, pre, last, depth, parent, tag, attrs, text, hidden; document order is ``pre``."""
    parsed = captures.select(*keep, page_nodes("html").alias("nodes"))
    rows = parsed.select(*keep, F.explode("nodes").alias("n"))
    return rows.select(*keep, "n.*").withColumn("hidden", F.col("tag").isin(*SKIPPED_TEXT))


def contains_join(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """Ancestor/descendant pairs of each page, no pair made before it is known to be one.

    What lies below an ancestor is one run of the page's descendants in document order. Both lists meet in one sort of
    their places, a running count gives each ancestor the ends of its run, and the runs are the result. A page holds a
    bounded number of nodes, so its lists are bounded.
    """
    a = ancestors.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pre").alias("a_pre"), F.col("last").alias("a_last"), F.col("tag").alias("a_tag")))).alias("above"))
    d = descendants.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pre").alias("d_pre"), F.col("tag").alias("d_tag")))).alias("below"))

    def event(at: Column, kind: int, i: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), i.alias("i"))

    # At equal places a descendant comes first, so the counts at an ancestor's own place and its last take it in.
    events = F.array_sort(
        F.concat(
            F.transform("below", lambda x: event(x["d_pre"], 0, F.lit(-1))),
            F.transform("above", lambda x, i: event(x["a_pre"], 1, i)),
            F.transform("above", lambda x, i: event(x["a_last"], 2, i)),
        )
    )

    def counted(e: Column) -> Column:
        return let(running_sum(F.transform(e, lambda x: (x["kind"] == 0).cast("int"))), lambda n: F.transform(e, lambda x, k: F.struct(x["kind"].alias("kind"), x["i"].alias("i"), F.get(n, k).alias("n"))))

    def ends(c: Column, kind: int) -> Column:
        return F.transform(F.array_sort(F.filter(c, lambda x: x["kind"] == kind)), lambda x: x["n"])

    both = a.join(d, "page_id").select("page_id", "above", "below", pin(let(events, counted)).alias("c"))
    runs = both.select("page_id", "above", "below", pin(ends(F.col("c"), 1)).alias("low"), pin(ends(F.col("c"), 2)).alias("high"))
    placed = F.transform("above", lambda x, i: F.struct(x.alias("a"), F.slice("below", F.get("low", i) + 1, F.get("high", i) - F.get("low", i)).alias("d")))
    pairs = runs.select("page_id", F.explode(placed).alias("r")).select("page_id", "r.a.*", F.explode("r.d").alias("d"))
    return pairs.select("page_id", "a_pre", "a_last", "a_tag", "d.d_pre", "d.d_tag")
