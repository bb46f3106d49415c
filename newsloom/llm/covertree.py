"""Exact top-k by inner product with a dual tree: queries and data are both held in cover trees.

The upper level is a net of bounded size picked farthest-first from a sample; every row belongs to the node of its
nearest net point, and a node's covering radius is taken over all its rows. Below, each block of a node is a tree of its
own: a set of points within radius r of its centre is split into children that each lie within r / 2 of one of their
points, until it is small or no longer splits well. For a query node (centre a, radius r) and a data node (centre b,
radius s) no product exceeds a.b + r|b| + s|a| + rs; the pair is dropped when that is below the worst k-th score of the
query node. Queries first meet their own node, which gives every query a k-th score, then what these scores leave over.
Vectors of several lengths share the trees, short ones filled up with zeros, which keeps the bounds; a product counts
only between vectors of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import in_parts, is_empty, mixed, stored, table
from newsloom.llm.vectors import consecutive, filled, finite, padded
from newsloom.session import tune

#: Rows the net is picked from, nodes at most, rows of a data and of a query block, rows of a leaf.
SAMPLE, MOST_NODES, DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 512, 2048, 512, 64
#: What rounding may take from a bound: so much, and such a share of the product of the lengths.
SLACK, ROUNDED = 1e-6, 1e-10
#: No score: below every other, and its negative is a number as well.
NONE = np.iinfo(np.int64).min + 1


def net(rows: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points: each is the row farthest from those before it."""
    points, gap = rows[:1], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(points) < min(count, len(rows)) and gap.max() > 0:
        points = np.vstack([points, rows[np.argmax(gap)]])
        gap = np.minimum(gap, ((rows - points[-1]) ** 2).sum(axis=1))
    return points


def leaves(rows: np.ndarray, leaf: int = LEAF) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(row numbers, centre, radius) of the leaves of the rows' cover tree."""
    out = []

    def split(members: np.ndarray, centre: np.ndarray) -> None:
        gap = np.sqrt(((rows[members] - centre) ** 2).sum(axis=1))
        radius = float(gap.max())
        children = []
        rest = members
        # A set that falls apart into a child for every few rows gains nothing from deeper nodes.
        while radius > 0 and len(members) > leaf and len(rest) and len(children) <= 4 * len(members) // leaf:
            point = rows[rest[0]]
            close = np.sqrt(((rows[rest] - point) ** 2).sum(axis=1)) <= radius / 2
            children.append((rest[close], point))
            rest = rest[~close]
        if children and not len(rest):
            for child, point in children:
                split(child, point)
            return
        for at in range(0, len(members), leaf) if radius == 0 or len(members) <= leaf else [0]:
            part = members[at : at + leaf] if radius == 0 or len(members) <= leaf else members
            out.append((part, centre, radius))

    split(np.arange(len(rows)), rows[0])
    return out


def _node(points: np.ndarray, width: int):
    """Each row with its node, its distance from the net point, and floor-scaled whole components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = padded(batch.column("whole"), width)
            square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ points.T + (points**2).sum(axis=1)[None, :]
            node = np.argmin(square, axis=1)
            gap = np.sqrt(((rows - points[node]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column("vec_id"), batch.column("lot"), batch.column("whole"), pa.array(node.astype(np.int32)), pa.array(gap)], names=["vec_id", "lot", "whole", "node", "gap"])

    return run


def _tree(width: int, leaf: int):
    """One row for each block: its ids, rows and their lengths in leaf order, and the leaves' sizes, centres and radii."""

    def build(key: tuple, table: pa.Table) -> pa.RecordBatch:
        (rows, lengths), ids = padded(table.column("whole").combine_chunks(), width), np.asarray(table.column("vec_id"))
        found = leaves(rows, leaf)
        order = np.concatenate([f[0] for f in found])
        cells = [ids[order], rows[order], lengths[order], np.array([len(f[0]) for f in found], dtype=np.int64), np.array([f[1] for f in found]), np.array([f[2] for f in found])]
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["node", "block", "ids", "data", "lengths", "sizes", "centres", "radii"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from consecutive(batches, ["node", "block"], build)

    return run


TREE = "node int, block int, ids binary, data binary, lengths binary, sizes binary, centres binary, radii binary"


def _reach(points: np.ndarray, radii: np.ndarray, width: int):
    """For every query block the nodes beside its own that may still hold a score as good as its worst k-th."""
    norms = np.linalg.norm(points, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, block, centres, leaf_radii, worst in zip(*(batch.column(c).to_pylist() for c in ("node", "block", "centres", "radii", "worst")), strict=True):
                c, r = np.frombuffer(centres).reshape(-1, width), np.frombuffer(leaf_radii)
                long = np.linalg.norm(c, axis=1)[:, None]
                bound = c @ points.T + r[:, None] * norms[None, :] + long * radii[None, :] + r[:, None] * radii[None, :]
                bound += ROUNDED * (long + r[:, None]) * (norms + radii)[None, :]
                nodes = np.flatnonzero((bound.max(axis=0) + SLACK >= worst) & (radii >= 0))
                nodes = nodes[nodes != node]
                yield pa.record_batch([pa.array([node] * len(nodes), pa.int32()), pa.array([block] * len(nodes), pa.int32()), pa.array(nodes.astype(np.int32))], names=["qnode", "qblock", "node"])

    return run


def _search(width: int, k: int):
    """The k best of a data block for each query of a query block, no score below the query's k-th so far."""

    def pair(row: dict) -> tuple[list, list, list]:
        def tree(p):
            sizes = np.frombuffer(row[p + "sizes"], dtype=np.int64)
            ids, lengths = (np.frombuffer(row[p + c], dtype=np.int64) for c in ("ids", "lengths"))
            return ids, lengths, np.frombuffer(row[p + "data"]).reshape(-1, width), np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(row[p + "centres"]).reshape(-1, width), np.frombuffer(row[p + "radii"])

        qids, qlong, q, qat, qc, qr = tree("q")
        cids, clong, c, cat, cc, cr = tree("")
        start = {x["query"]: x["score"] for x in row["floors"] or []}
        floor = np.array([start.get(i, NONE) for i in qids.tolist()], dtype=np.int64)
        exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < 2**53
        cn, out = np.linalg.norm(cc, axis=1), ([], [], [])
        shared = len(np.unique(cids)) < len(cids)
        for n in range(len(qr)):
            lo, hi = qat[n], qat[n + 1]
            long = np.linalg.norm(qc[n])
            bound = cc @ qc[n] + qr[n] * cn + cr * long + qr[n] * cr + ROUNDED * (long + qr[n]) * (cn + cr)
            worst = floor[lo:hi].copy()
            score, ident = np.full((hi - lo, 0), NONE), np.zeros((hi - lo, 0), dtype=np.int64)
            for m in np.argsort(-bound, kind="stable"):
                if bound[m] + SLACK < worst.min():
                    break
                data, ids = c[cat[m] : cat[m + 1]], cids[cat[m] : cat[m + 1]]
                fresh = (q[lo:hi] @ data.T).astype(np.int64) if exact else q[lo:hi].astype(np.int64) @ data.T.astype(np.int64)
                other = (ids[None, :] == qids[lo:hi, None]) | (clong[None, cat[m] : cat[m + 1]] != qlong[lo:hi, None])
                fresh = np.where(other | (fresh < worst[:, None]), NONE, fresh)
                score, ident = np.hstack([score, fresh]), np.hstack([ident, np.broadcast_to(ids, fresh.shape)])
                best = np.lexsort((ident, -score), axis=1)[:, : None if shared else k]
                score, ident = np.take_along_axis(score, best, axis=1), np.take_along_axis(ident, best, axis=1)
                if shared:
                    score[:, 1:][(score[:, 1:] == score[:, :-1]) & (ident[:, 1:] == ident[:, :-1])] = NONE
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    score, ident = np.take_along_axis(score, best, axis=1), np.take_along_axis(ident, best, axis=1)
                if score.shape[1] == k:
                    worst = np.maximum(worst, score[:, -1])
            row_of, at = np.nonzero(score > NONE)
            out[0].extend(qids[lo + row_of].tolist())
            out[1].extend(ident[row_of, at].tolist())
            out[2].extend(score[row_of, at].tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array(x, pa.int64()) for x in pair(row)], names=["query", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int, shared: bool) -> DataFrame:
    if shared:
        found = found.repartition("query").dropDuplicates(["query", "vec_id", "score"])
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k rows with the highest inner product, ties to the smaller vec_id.

    Components become floor(scale * x). Rows whose vec_id or embedding is null or empty, or holds null or non-finite
    components take no part; zero vectors do. Every other row is a candidate, rows that share a vec_id each with its
    own score; as queries these share one list of k. A list names a vec_id once for each different score. A query finds
    rows of its own vector's length and never its own vec_id, and fewer than k if there are fewer. An empty table gives none.
    Scores are exact wherever they and their partial sums fit 64 bits.
    """
    spark = tune(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite("embedding"))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("whole"))
    # A lot tells apart the rows of one vec_id, so that they spread over blocks.
    whole = stored(whole.distinct().withColumn("lot", F.xxhash64("vec_id", "whole")).select("vec_id", "lot", "whole"), "whole-vectors")
    width = whole.agg(F.max(F.size("whole"))).first()[0]
    shared = not is_empty(whole.groupBy("vec_id").count().filter("count > 1"))
    sample = whole.orderBy(mixed("lot", 3)).limit(SAMPLE).select("whole").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = net(filled([r[0] for r in sample], width), min(MOST_NODES, max(1, whole.count() // DATA_BLOCK)))
    placed = stored(whole.mapInArrow(_node(points, width), "vec_id long, lot long, whole array<double>, node int, gap double"), "nodes")

    # One row for each of the net's points at most.
    radii = np.full(len(points), -1.0)
    for r in placed.groupBy("node").agg(F.max("gap").alias("r")).collect():
        radii[r["node"]] = r["r"] + SLACK

    def trees(part: DataFrame, size: int, leaf: int, name: str) -> DataFrame:
        counts = part.groupBy("node").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
        dealt = part.join(counts, "node").withColumn("block", in_parts("lot", F.col("blocks"))).select("node", "block", "vec_id", "whole")
        return stored(dealt.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(_tree(width, leaf), TREE), name)

    data = trees(placed, DATA_BLOCK, LEAF, "data-trees")
    asked = trees(placed.filter(is_query), QUERY_BLOCK, LEAF // 2, "query-trees")
    asked = asked.select(*[F.col(c).alias(f"q{c}") for c in asked.columns])
    places = data.select("node", "block")

    def search(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        met = pairs.join(asked, ["qnode", "qblock"])
        met = met.join(floors, ["qnode", "qblock"], "left") if floors is not None else met.withColumn("floors", F.lit(None).cast("array<struct<query:bigint,score:bigint>>"))
        both = met.join(data, ["node", "block"]).repartition("qnode", "qblock", "node", "block")
        return both.mapInArrow(_search(width, k), "query long, vec_id long, score long")

    near = asked.select("qnode", "qblock", F.col("qnode").alias("node")).join(places, "node")
    first = stored(_best(search(near, None), k, shared).select("query", "vec_id", "score", "rank"), "first-scores")
    kth = first.filter(F.col("rank") == k).select("query", "score")
    # A query block holds so many rows at most; a query without k scores yet has no floor.
    ids = placed.filter(is_query).select("vec_id", "lot", F.col("node").alias("qnode"))
    counts = ids.groupBy("qnode").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    where = ids.join(counts, "qnode").select(F.col("vec_id").alias("query"), "qnode", in_parts("lot", F.col("blocks")).alias("qblock")).distinct()
    scored = where.join(kth, "query", "left")
    floors = scored.groupBy("qnode", "qblock").agg(
        F.collect_list(F.when(F.col("score").isNotNull(), F.struct("query", "score"))).alias("floors"), F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("worst")
    )
    floors = stored(floors, "floors")
    reach = asked.select("qnode", "qblock", "qcentres", "qradii").join(floors.select("qnode", "qblock", "worst"), ["qnode", "qblock"])
    reach = reach.select(F.col("qnode").alias("node"), F.col("qblock").alias("block"), F.col("qcentres").alias("centres"), F.col("qradii").alias("radii"), "worst")
    far = reach.mapInArrow(_reach(points, radii, width), "qnode int, qblock int, node int").join(places, "node")
    rest = search(far, floors.select("qnode", "qblock", "floors"))
    out = _best(first.select("query", "vec_id", "score").unionByName(rest), k, shared)
    return out.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
