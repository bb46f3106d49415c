"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Documents become token ids once. Full windows stand alone; what is left of a document is packed with what is left of
others. Documents are dealt to shards of a bounded number of tokens by lexical likeness: a tree of median cuts through
random projections of their weighted terms, fitted on a sample, puts like documents into one cell, and shards are equal
stretches of the cells in tree order. A cell of many copies that is longer than a shard spreads over its stretch by a hash.
A shard holds an inverted index over all its documents with BM25 weights from corpus-wide document frequencies. The
longest unused rest is the seed, whose terms are all looked up; its unused neighbours are taken best first, a handful at a
time: those that fit, then the first that doesn't fit, cut to close the window. Only the last window of a shard has padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.bytepair import encoder
from newsloom.llm.common import in_parts, stored, table
from newsloom.llm.vectors import consecutive
from newsloom.session import tune

WINDOW, SHARD_TOKENS = 1024, 1 << 21
#: BM25's constants, neighbours that are tried together, best first, until none is left.
K1, B, NEIGHBOURS = 1.2, 0.75, 16
#: Tokens that a document counts for at least when shards are cut, so that a shard's documents are bounded as well.
LEAST_TOKENS = 64
#: Terms that at least this share of a shard's documents hold are multiplied as a matrix of at most so many numbers, for so many seeds at once.
DENSE, DENSE_CELLS, SEEDS = 1 / 16, 1 << 22, 64
#: Numbers of a document's sketch, rows that the tree is fitted on, cells a shard has, sampled rows a cell needs.
SKETCH, SAMPLE, CELLS, CELL_ROWS = 32, 8192, 4, 2


def _encode(path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        tail = np.array([end], dtype=e.kind).tobytes()
        for batch in batches:
            ids = [e.encode(t or "") + tail for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // e.kind.itemsize for i in ids], pa.int64())], names=["doc_id", "ids", "tokens"])

    return run


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of every different term of every document, by document and term."""
    if not docs:
        return (np.zeros(0, dtype=np.int64),) * 3
    both = np.repeat(np.arange(len(docs), dtype=np.int64) << 32, [len(d) for d in docs]) + np.concatenate(docs)
    both.sort()
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, dtype=np.int64)
    return both[first] >> 32, both[first] & 0xFFFFFFFF, np.diff(np.append(first, len(both)))


def _frequencies(kind: str):
    """Documents that hold each id, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            held = _terms([np.frombuffer(i, dtype=kind) for i in batch.column("ids").to_pylist()])[1]
            found = np.bincount(held, minlength=len(total))
            found[: len(total)] += total
            total = found
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["id", "docs"])

    return run


class Shard:
    """The index of one shard: its documents' terms with BM25 weights, by term for rare ones, as a matrix for common ones.

    Only documents that are still wanted are held; ``keep`` leaves out the others. Scores of the seeds that come next
    are made together for the matrix, and one by one for the postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        owner, term, tf = _terms(docs)
        length = np.array([len(d) for d in docs], dtype=np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        held = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(held >= max(2, DENSE * len(docs)))
        common = common[np.argsort(-held[common], kind="stable")][: DENSE_CELLS // max(1, len(docs))]
        column = np.full(len(idf), -1)
        column[common] = np.arange(len(common))
        dense = column[term] >= 0
        self.matrix = np.zeros((len(docs), len(common)), dtype=np.float32)
        self.matrix[owner[dense], column[term[dense]]] = weight[dense]
        self.held = self.matrix > 0
        owner, term, weight = owner[~dense], term[~dense], weight[~dense]
        self.queries = np.split(term, np.searchsorted(owner, np.arange(1, len(docs))))
        order = np.argsort(term, kind="stable")
        self.term, self.owner, self.weight = term[order], owner[order], weight[order]
        self.docs, self.terms = np.arange(len(docs)), len(idf)
        self.ready: dict[int, np.ndarray] = {}
        self.place()

    def place(self) -> None:
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.term, minlength=self.terms))))

    def keep(self, wanted: np.ndarray) -> None:
        """Leaves out all documents but the wanted ones, given for those held now."""
        number = np.cumsum(wanted) - 1
        stays = wanted[self.owner]
        self.term, self.owner, self.weight = self.term[stays], number[self.owner[stays]], self.weight[stays]
        self.docs, self.matrix = self.docs[wanted], self.matrix[wanted]
        self.ready = {}
        self.place()

    def scores(self, doc: int, coming: np.ndarray) -> np.ndarray:
        """The scores of the documents held, in their order; coming names seeds that follow, this one first."""
        if doc not in self.ready:
            together = coming[:SEEDS]
            self.ready = dict(zip(together.tolist(), self.held[together].astype(np.float32) @ self.matrix.T, strict=True))
        out = self.ready[doc].astype(np.float64)
        terms = self.queries[doc]
        begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return out + np.bincount(self.owner[at], weights=self.weight[at], minlength=len(out))


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, names: list | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0.

    Documents of the same name are repeats and no neighbours of each other.
    """
    name = np.unique([-1 if n is None else n for n in names or range(len(docs))], return_inverse=True)[1]
    pieces, sequence = [], 0
    start = []
    for d, ids in enumerate(docs):
        full = len(ids) // window
        for k in range(full):
            pieces.append((d, k * window, window, sequence, 0))
            sequence += 1
        start.append(full * window)
    left = np.array([len(ids) - s for ids, s in zip(docs, start, strict=True)])
    index = Shard(docs, idf, mean)
    order = np.argsort(-left, kind="stable")
    spare = len(order) - 1

    def take(d: int, room: int, offset: int) -> int:
        n = min(int(left[d]), room)
        pieces.append((d, start[d], n, sequence, offset))
        start[d] += n
        left[d] -= n
        return n

    for turn, seed in enumerate(order):
        while left[seed]:
            used = take(seed, window, 0)
            if used < window:
                wanted = left[index.docs] > 0
                if wanted.sum() < 0.7 * len(wanted):
                    index.keep(wanted)
                after = order[turn : turn + 4 * SEEDS]
                near = index.scores(seed, np.concatenate(([seed], after[left[after] > 0])))
                near[(left[index.docs] == 0) | (name[index.docs] == name[seed])] = 0
                # The best few first; all others are sorted only if these leave room.
                best = np.argpartition(-near, NEIGHBOURS)[:NEIGHBOURS] if len(near) > NEIGHBOURS else np.arange(len(near))
                rest, at = None, 0
                while used < window:
                    if at:
                        if rest is None:
                            near[best] = 0
                            rest = np.flatnonzero(near > 0)
                            rest = rest[np.lexsort((index.docs[rest], -near[rest]))]
                        best = rest[(at - 1) * NEIGHBOURS : at * NEIGHBOURS]
                    else:
                        best = best[near[best] > 0]
                        best = best[np.lexsort((index.docs[best], -near[best]))]
                    at += 1
                    some = index.docs[best].tolist()
                    if not some:
                        break
                    for d in some:
                        if 0 < left[d] <= window - used:
                            used += take(d, window, used)
                    for d in some:
                        if used < window and left[d]:
                            used += take(d, window - used, used)
                # Without neighbours left, the shortest unused rests close the window.
                while used < window and spare >= 0:
                    if left[order[spare]]:
                        used += take(order[spare], window - used, used)
                    if not left[order[spare]]:
                        spare -= 1
            sequence += 1
    return pieces


@lru_cache(maxsize=1)
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, SKETCH), dtype=np.float32)


def _sketches(ids: list, idf: np.ndarray, kind: str) -> np.ndarray:
    """Unit random projections of the documents' weighted terms."""
    directions = _directions(len(idf))
    out = np.zeros((len(ids), SKETCH))
    owner, term, _ = _terms([np.frombuffer(i, dtype=kind) for i in ids])
    ends = np.searchsorted(owner, np.arange(len(ids) + 1))
    for k in range(len(ids)):
        terms = term[ends[k] : ends[k + 1]]
        out[k] = idf[terms] @ directions[terms]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]


def _sampled(idf: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _sketches(batch.column("ids").to_pylist(), idf, kind)
            yield pa.record_batch([pa.array([r.tobytes() for r in sketch], pa.binary()), batch.column("tokens")], names=["sketch", "tokens"])

    return run


class Tree:
    """Cells of like sketches in tree order, and the stretch from 0 to 1 of all sampled tokens that each holds."""

    def __init__(self, rows: np.ndarray, tokens: np.ndarray, cells: int) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, min(cells, len(rows) // CELL_ROWS)))))
        self.direction, self.cut = np.zeros((1 << self.depth, SKETCH)), np.zeros(1 << self.depth)
        members = {1: np.arange(len(rows))}
        for node in range(1, 1 << self.depth):
            own = members[node]
            if len(own):
                spread = rows[own] - rows[own].mean(axis=0)
                self.direction[node] = np.linalg.eigh(spread.T @ spread)[1][:, -1]
                self.cut[node] = np.median(rows[own] @ self.direction[node])
            right = rows[own] @ self.direction[node] > self.cut[node]
            members[2 * node], members[2 * node + 1] = own[~right], own[right]
        held = np.bincount(self.cell(rows), weights=tokens, minlength=1 << self.depth)
        self.end = np.cumsum(held) / held.sum()
        self.start = np.concatenate(([0.0], self.end[:-1]))

    def cell(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((rows * self.direction[node]).sum(axis=1) > self.cut[node])
        return node - (1 << self.depth)


def _deal(tree: Tree, idf: np.ndarray, kind: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.cell(_sketches(batch.column("ids").to_pylist(), idf, kind))
            place = tree.start[cell] + np.asarray(batch.column("u")) * (tree.end - tree.start)[cell]
            shard = np.minimum(shards - 1, (place * shards).astype(np.int64)).astype(np.int32)
            yield pa.record_batch([pa.array(shard), batch.column("doc_id"), batch.column("ids")], names=["shard", "doc_id", "ids"])

    return run


def _pack(idf: np.ndarray, mean: float, kind: str, window: int):
    def shard(key: tuple, rows: pa.Table) -> pa.RecordBatch:
        doc_ids = rows.column("doc_id").to_pylist()
        docs = [np.frombuffer(i, dtype=kind) for i in rows.column("ids").to_pylist()]
        pieces = pack_shard(docs, idf, mean, window, doc_ids)
        d, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
        ids = [docs[a][b : b + n].astype("<u4").tobytes() for a, b, n in zip(d, start, length, strict=True)]
        return pa.record_batch(
            [pa.array([doc_ids[k] for k in d], pa.int64()), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array([len(docs[k]) for k in d], pa.int64()), pa.array(sequence + (key[0] << 32)), pa.array(offset)],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from consecutive(batches, ["shard"], shard)

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end: int = 0) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids, doc_tokens, sequence_id and offset.

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers; each document ends with the id end, so a
    null or empty text is that id alone. A piece lies at offset in its sequence of at most window ids. Rows that share a
    doc_id, or have none, are documents of their own; they spread over shards, and neighbours of equal score are taken
    by their order in the shard, by doc_id and text. Very long texts are full windows but for their rest; a document of a few
    tokens counts for LEAST_TOKENS of a shard, so that many short ones spread. An empty table gives none. Columns other than doc_id and text are
    not read. path names the ranks of the vocabulary.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    coded = stored(rows.mapInArrow(_encode(path, end), "doc_id long, ids binary, tokens long"), "token-ids")
    total = coded.agg(F.count("*").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.greatest("tokens", F.lit(LEAST_TOKENS))), F.lit(0)).alias("cost")).first()
    e = encoder(path)
    # One number for each id of the vocabulary.
    held = np.zeros(e.size + 1)
    for r in coded.select("ids").mapInArrow(_frequencies(e.kind.str), "id long, docs long").groupBy("id").agg(F.sum("docs").alias("docs")).collect():
        if r["id"] < len(held):
            held[r["id"]] = r["docs"]
    idf = np.log1p((total["docs"] - held + 0.5) / (held + 0.5))
    # The stored rows are read alike each time, so the number of a row tells repeats apart and a task's rerun gives the same.
    shards = max(1, math.ceil(total["cost"] / shard_tokens))
    key = F.xxhash64("doc_id", "ids", F.monotonically_increasing_id())
    if shards == 1:
        dealt = coded.select(F.lit(0).alias("shard"), "doc_id", "ids")
    else:
        share = in_parts(key, math.ceil(total["docs"] / SAMPLE), 12)
        sample = coded.withColumn("share", share).filter("share = 0").limit(2 * SAMPLE).mapInArrow(_sampled(idf, e.kind.str), "sketch binary, tokens long").collect() or [(np.ones(SKETCH).tobytes(), 1)]
        tree = Tree(np.array([np.frombuffer(r[0]) for r in sample]), np.array([max(r[1], LEAST_TOKENS) for r in sample]), CELLS * shards)
        numbered = coded.select((in_parts(key, 1 << 20) / (1 << 20)).alias("u"), "doc_id", "ids")
        dealt = numbered.mapInArrow(_deal(tree, idf, e.kind.str, shards), "shard int, doc_id long, ids binary")
    sorted_shards = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("ids"))
    mean = max(1.0, total["tokens"] / max(1, total["docs"]))
    return sorted_shards.mapInArrow(_pack(idf, mean, e.kind.str, window), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(table(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
