"""Mixing sources to target weights with DataFrame functions only.

Sizes are summed per source before any shuffle, targets are filled by weight under a cap (water filling over one narrow
row per source), and every document is emitted floor(rate) times plus one Bernoulli copy whose draw is a hash of its id.
The per-source table, a short row each, is the only thing that is sorted in one task; it is sent to every task only up
to a counted number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, stored, table, whole_row

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
#: Sources up to which their table, a short row each, is sent to every task; beyond it Spark picks the join.
SENT_SOURCES = 50_000


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows with source and size.

    Sources in code point order, null last, take the weights in turn. Together they get share times all sizes; a source
    stops at cap times its own size and what it can't take goes to the others by weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weighed = totals.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long").alias("weight"))
    # By size over weight, those that fill up come first; each sees what is left after the earlier ones took their cap.
    ratio = F.col("source_size") / F.col("weight")
    filling = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    left = weighed.select(
        "source",
        "source_size",
        "weight",
        (F.lit(cap) * F.col("source_size")).alias("limit"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("wanted"),
        F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)).alias("taken_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(after) + F.col("weight")).alias("weight_left"),
    )
    level = (F.col("wanted") - F.col("taken_before")) / F.col("weight_left")
    # The level rises while sources fill up and falls after, so the first source that doesn't fill sets it: the largest.
    levelled = left.withColumn("level", F.when(F.col("limit") > level * F.col("weight"), level))
    final = levelled.withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
    return final.select("source", "source_size", target.cast("double").alias("target"))


def draw(doc_id: Column | str, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies, the number of times the mix repeats each.

    A null text has size 0; a source of size 0 has target 0 and no copies. A null source is a source of its own.
    Rows that share a doc_id are drawn alike, and repeated rows each count with their size. Texts of any length are
    counted whole. Sources whose size over weight is equal fill up by code point. An empty table gives none. Other
    columns stay, whatever their names; those named like the added ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    # Other columns travel as one struct, so that they can't clash with those added on the way.
    known = ("doc_id", "source", "text")
    others = [c for c in docs.columns if c not in known]
    rest_of_row = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")] if others else []
    columns = [F.col(c) if c in known else F.col("_row")[c].alias(c) for c in docs.columns]
    sized = docs.select(*known, *rest_of_row, word_count("text").alias("size"))
    targets = stored(source_targets(docs.select("source", word_count("text").alias("size"))).withColumnRenamed("source", "_source"), "targets")
    if targets.count() <= SENT_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(draw("doc_id", seed) < rate - whole, 1).otherwise(0)
    planned = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    return planned.select(*columns, "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents: every row as often as its plan says, with the columns of docs.

    Null texts and sources, repeated rows, ties and an empty table are dealt with as mix_plan states; rows of size 0 in
    a source with words are drawn like others. Columns of any name stay.
    """
    # The copies of one document are a few by the cap, so the repeat never fans out.
    planned = mix_plan(docs.select("doc_id", "source", "text", whole_row(docs)), seed).filter(F.col("copies") > 0)
    return planned.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix_plan(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS n FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM f)::BIGINT
   - coalesce((SELECT sum(2 * source_size) FROM f g WHERE g.n < f.n), 0)::BIGINT)
   / (SELECT sum(weight) FROM f g WHERE g.n >= f.n)::BIGINT AS level FROM f),
v AS (SELECT max(level) FILTER (WHERE 2 * source_size > level * weight) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL THEN (2 * source_size)::DOUBLE ELSE least((2 * source_size)::DOUBLE, v.level * weight) END AS target FROM f, v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
   ('0x' || substr(md5(d.doc_id || '/mix-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
 size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
