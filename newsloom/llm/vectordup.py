"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one row kept per group.

Every vector is compared in its own cell and also visits cells near its border. For x at home in a and y in b the margins
x.(a - b) and y.(b - a) add up to (x - y).(a - b), at most |x - y||a - b|, and unit vectors at cosine t are sqrt(2 - 2t)
apart: one of the two margins is at most half of that, so visiting all cells within half finds every link, whatever the
vectors. A caller who knows that differences point in random directions of all columns may cut the reach to sure standard
deviations of one, sure / sqrt(columns) of the whole; vectors that vary in few directions lose links by that. A pair that
meets in two cells is counted in one of them. Equal vectors are one class with a count. Classes are stored once, in chunks
of bounded size with a bit for each cell that a vector visits, and chunks meet in pairs that are read from there: no vector
is written once a visit, and within a pair only members and visitors of a cell are compared. Vectors are first scaled by a
power of two, which is exact, so that no square over- or underflows. Vectors of several lengths share the cells, short ones
filled up with zeros, but link only with vectors of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import mixed, stored, table
from newsloom.llm.components import components
from newsloom.llm.vectors import filled, finite, padded
from newsloom.session import tune

#: Rows that k-means is fitted on, cells at most, rounds of k-means, rows of a block, and bytes of the vectors of a chunk.
SAMPLE, MOST_CELLS, ROUNDS, BLOCK, CHUNK = 8192, 2048, 8, 1024, 2 << 20

#: Columns of a chunk, as lists or bytes over its classes, and those that a comparison reads.
PACKED = ["h1", "h2", "cid", "n", "least", "home", "long", "visits", "vectors"]
PACKED_AS = "h1 array<long>, h2 array<long>, cid array<long>, n array<long>, least array<long>, home array<int>, long array<int>, visits binary, vectors binary"
COMPARED = ["cid", "n", "home", "long", "visits", "vectors"]


def balanced(rows: np.ndarray) -> np.ndarray:
    """Each row scaled by the power of two that brings its largest component between 1/2 and 1."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows, seeded by every row in turn that is far from those before."""
    cells = max(1, min(cells, len(rows)))
    centroids, best = rows[:1], rows @ rows[0]
    while len(centroids) < cells:
        centroids = np.vstack([centroids, rows[np.argmin(best)]])
        best = np.maximum(best, rows @ centroids[-1])
    for _ in range(rounds):
        owner = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, rows)
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centroids)
    return centroids


def _packed(centroids: np.ndarray, threshold: float, width: int, sure: float | None, kind: str, most: int):
    """Classes in chunks of up to ``most``, ordered by their cells, with a bit for each cell that a vector visits."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 * (1.0 if sure is None else min(1.0, sure / np.sqrt(width)))
    far = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        homes, bits, vectors, lengths = [], [], [], []
        for batch in held:
            rows, long = padded(batch.column("vector"), width)
            rows = balanced(rows)
            unit = rows / np.linalg.norm(rows, axis=1)[:, None]
            near = unit @ centroids.T
            home = np.argmax(near, axis=1)
            visits = near.max(axis=1)[:, None] - near <= reach * far[home] + 1e-9
            visits[np.arange(len(rows)), home] = True
            homes.append(home)
            bits.append(np.packbits(visits, axis=1))
            vectors.append(rows.astype(kind))
            lengths.append(long)
        home = np.concatenate(homes)
        order = np.argsort(home, kind="stable")
        cells = [np.concatenate(x)[order].tobytes() for x in (bits, vectors)]
        plain = [home[order].astype(np.int32), np.concatenate(lengths)[order].astype(np.int32)]
        listed = [pa.concat_arrays([b.column(c) for b in held]).take(pa.array(order)) for c in ("h1", "h2", "cid", "n", "least")]
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), values)
        return pa.record_batch([*map(whole, listed), *(whole(pa.array(x)) for x in plain), *(pa.array([x], pa.binary()) for x in cells)], names=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - sum(b.num_rows for b in held))
                batch = batch.slice(part.num_rows)
                held.append(part)
                if sum(b.num_rows for b in held) == most:
                    yield chunk(held)
                    held = []
        if held:
            yield chunk(held)

    return run


class _Chunk:
    """One side of a pair of chunks, as matrices."""

    def __init__(self, row: dict[str, pa.Scalar], width: int, kind: str) -> None:
        self.cid, self.n, self.home, self.long = (row[c].values.to_numpy() for c in ("cid", "n", "home", "long"))
        count = len(self.cid)
        bits = np.frombuffer(row["visits"].as_buffer(), dtype=np.uint8).reshape(count, -1)
        #: For each cell, who visits it.
        self.visitors = np.ascontiguousarray(np.unpackbits(bits, axis=1).T.astype(bool))
        self.data = np.frombuffer(row["vectors"].as_buffer(), dtype=kind).reshape(count, width).astype(np.float64)
        self.length = np.sqrt((self.data * self.data).sum(axis=1))
        self.unit = (self.data / self.length[:, None]).astype(np.float32)
        starts = np.flatnonzero(np.diff(self.home, prepend=-1))
        self.cells = list(zip(self.home[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), count], strict=True))


def _smallest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a block the smallest row it reaches, the number of rows for a column that reaches none."""
    none = len(linked)
    a = np.arange(none)
    while True:
        b = np.where(linked, a[:, None], none).min(axis=0)
        to = np.minimum(a, np.where(linked, b[None, :], none).min(axis=1))
        to = to[to]
        if (to == a).all():
            return a, b
        a = to


def _merged(count: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``count`` places the smallest one that the edges join it with."""
    label = np.arange(count)
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((closer := label[label]) != label).any():
            label = closer


def _compare(threshold: float, width: int, kind: str, block: int):
    # Single precision tells which rows of a block may have a link, double precision decides.
    maybe = threshold - 1e-6 - width * 1.2e-7

    def meet(members: _Chunk, guests: _Chunk, at: tuple[int, int], first: bool, found: np.ndarray, edges: list) -> None:
        """Links of members with the guests of their cells. A pair that meets in both its homes belongs to the smaller one."""
        own = members is guests
        for cell, start, end in members.cells:
            here = np.flatnonzero(guests.visitors[cell])
            for i in range(start, end, block) if len(here) else ():
                for j in range(0, len(here), block):
                    g = here[j : j + block]
                    near = members.unit[i : min(i + block, end)] @ guests.unit[g].T
                    if near.max() < maybe:
                        continue
                    near = near >= maybe
                    m, g = i + np.flatnonzero(near.any(axis=1)), g[near.any(axis=0)]
                    linked = (members.data[m] @ guests.data[g].T) / (members.length[m][:, None] * guests.length[g][None, :]) >= threshold
                    linked &= members.long[m][:, None] == guests.long[g][None, :]
                    home = guests.home[g]
                    again = members.visitors[np.ix_(home, m)].T
                    linked &= ~again | (home > cell) | ((home == cell) & (m[:, None] < g[None, :] if own else first))
                    if not linked.any():
                        continue
                    found[at[0] + m] += linked @ guests.n[g]
                    found[at[1] + g] += members.n[m] @ linked
                    a, b = _smallest(linked)
                    edges += [(at[0] + m, at[0] + m[a]), (at[1] + g[b < len(m)], at[0] + m[b[b < len(m)]])]

    def pair(left: _Chunk, right: _Chunk) -> pa.RecordBatch | None:
        own = left is right
        ids = left.cid if own else np.concatenate([left.cid, right.cid])
        found, edges = np.zeros(len(ids), dtype=np.int64), []
        behind = 0 if own else len(left.cid)
        meet(left, right, (0, behind), True, found, edges)
        if not own:
            meet(right, left, (behind, 0), False, found, edges)
        if not edges:
            return None
        hit = np.flatnonzero(found)
        label = _merged(len(ids), edges)
        return pa.record_batch([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(found[hit])], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, _Chunk]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                for side in ("x", "y"):
                    chunk = batch.column(f"{side}_chunk")[k].as_py()
                    if held.get(side, (None,))[0] != chunk:
                        held[side] = (chunk, _Chunk({c: batch.column(f"{side}_{c}")[k] for c in COMPARED}, width, kind))
                (x, left), (y, right) = held["x"], held["y"]
                if (out := pair(left, left if x == y else right)) is not None:
                    yield out

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.95, block: int = BLOCK, sure: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row with columns vec_id and embedding.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, the others with
    vectors of their own length, however small or large their components. Repeated rows are vectors of their own and link with each other. A null vec_id counts as
    a vector, its component_id is the smallest known vec_id of its group. An empty table gives none. Other columns are
    not read.
    """
    spark = tune(rows.sparkSession)
    kind, element = ("<f4", "float") if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else ("<f8", "double")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    ok = F.coalesce(finite("vector") & F.exists("vector", lambda x: x != 0), F.lit(False))
    kept = [F.when(ok, x).alias(n) for n, x in (("h1", F.xxhash64("vector")), ("h2", mixed("vector", 5)), ("vector", F.col("vector").cast(f"array<{element}>")))]
    rows = stored(rows.select("vec_id", *kept), "vectors")
    sound = rows.filter(F.col("h1").isNotNull())
    width = sound.agg(F.max(F.size("vector"))).first()[0]
    if width:
        keys = sound.select("h1", "h2").distinct()
        count = keys.count()
        drawn = F.broadcast(keys.orderBy(mixed("h1", 3), "h2").limit(SAMPLE))
        sample = sound.join(drawn, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("vector").alias("vector")).orderBy(mixed("h1", 3), "h2").select("vector").collect()
        fit = balanced(filled([r[0] for r in sample], width))
        fit /= np.linalg.norm(fit, axis=1)[:, None]
        centroids = spherical_kmeans(fit, min(MOST_CELLS, max(1, round(count**0.5 / 2))))
        most = max(1, min(CHUNK // (width * int(kind[-1])), 8 * block))
        grouped = sound.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"))
        grouped = grouped.coalesce(max(spark.sparkContext.defaultParallelism, -(-count // most))).withColumn("cid", F.monotonically_increasing_id())
        chunks = grouped.mapInArrow(_packed(centroids, threshold, width, sure, kind, most), PACKED_AS)
        chunks = stored(chunks.withColumn("chunk", F.monotonically_increasing_id()), "vector-chunks")
        # Each pair of chunks meets once, in an order by hash, so that no task has most of them; both sides are read where they are stored.
        left, right = (chunks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("chunk", *COMPARED)]) for side in ("x", "y"))
        x, y = F.col("x_chunk"), F.col("y_chunk")
        pairs = left.join(right, (x == y) | ((x != y) & ((x < y) == (F.xxhash64(F.least(x, y), F.greatest(x, y)) % 2 == 0))))
        links = stored(pairs.mapInArrow(_compare(threshold, width, kind, block), "a long, b long, links long"), "vector-links")
        classes = chunks.select(F.inline(F.arrays_zip("h1", "h2", "cid", "n", "least")))
    else:
        links = spark.createDataFrame([], "a long, b long, links long")
        classes = spark.createDataFrame([], "h1 long, h2 long, cid long, n long, least long")
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    found = stored(components(links.select("a", "b")).withColumnRenamed("id", "cid"), "vector-components")
    least = found.join(classes.select("cid", "least"), "cid").groupBy("root").agg(F.min("least").alias("component"))
    labels = classes.join(counts, "cid", "left").join(found.join(least, "root"), "cid", "left")
    labels = labels.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(labels, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b AS id, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
"""
