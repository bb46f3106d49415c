"""Near duplicates by MinHash: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A signature is 32 values of 16 bits in 8 chunks of 4. Two signatures that differ in at most 15 values have, by
pigeonhole, a chunk with at most one differing value. Each chunk is therefore indexed four times, each time leaving one
value out: 32 exact keys of three values find all pairs up to that distance. A pair at similarity 0.85 exceeds the
distance with a chance of about 3 in a million.

Equal sets are one class, whatever their number. Keys join classes, first each member with one centre of its bucket;
confirmed links give components. Only buckets whose other members still lie in different components are searched in
full, in blocks of bounded size, so a group of copies never turns into all its pairs and no link between components
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import in_parts, stored, table
from newsloom.llm.components import components
from newsloom.llm.words import binaries, mix, shingles, sliced
from newsloom.session import tune

VALUES, CHUNK = 32, 4
BLOCK = 1024
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """(texts with a set, VALUES) 16-bit MinHash values; the last 16 bits of a mixed minimum."""
    full = np.diff(where) > 0
    starts = where[:-1][full]
    out = np.empty((len(starts), VALUES), dtype=np.uint16)
    if len(starts):
        for k, seed in enumerate(_SEEDS):
            out[:, k] = mix(np.minimum.reduceat(values * seed, starts)) & np.uint64(0xFFFF)
    return out


def _signatures(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                values, where = shingles(part.column("text"), size)
                full = np.diff(where) > 0
                starts = where[:-1][full]
                digests = np.zeros((2, part.num_rows), dtype=np.uint64)
                sig = np.empty((part.num_rows, VALUES), dtype=np.uint16)
                if len(starts):
                    digests[0, full] = np.add.reduceat(mix(values), starts)
                    digests[1, full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    sig[full] = _minima(values, where)
                places = np.zeros(part.num_rows + 1, dtype=np.int64)
                np.cumsum(np.where(full, VALUES, 0), out=places[1:])
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(where)), *(pa.array(d.view(np.int64)) for d in digests), binaries(sig[full].ravel(), places)],
                    schema=schema,
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and left-out value: the key packs chunk, place and the three 16-bit values."""
    for batch in batches:
        ids = batch.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, VALUES).astype(np.int64)
        keys = np.empty((len(ids), VALUES), dtype=np.int64)
        for k in range(VALUES):
            chunk, out = divmod(k, CHUNK)
            a, b, c = (sig[:, chunk * CHUNK + i] for i in range(CHUNK) if i != out)
            keys[:, k] = (np.int64(k) << 48) | (a << 32) | (b << 16) | c
        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(ids, VALUES))], names=["key", "id"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                values, where = shingles(part.column("text"), size)
                yield pa.record_batch([part.column("doc_id"), binaries(values, where)], names=["id", "hashes"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _star_links(percent: int):
    """Rows sorted by group with the centre first: each member is held against its centre only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre, found = None, [], []
        for g, salt, member, ident, hashes in _rows(batches, ["g", "salt", "member", "id", "hashes"]):
            if (g, salt) != group:
                group, centre = (g, salt), []
            values = np.frombuffer(hashes, dtype=np.uint64)
            if not member:
                centre.append(values)
            elif any(_similar(c, values, percent) for c in centre):
                found.append((g, ident))
                if len(found) >= 10_000:
                    yield _pairs_out(found)
                    found = []
        yield _pairs_out(found)

    return run


def _cross(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components in one pair of blocks; one suffices for each two components."""
    ids, comps, sides = ([r[k] for r in rows] for k in (0, 1, 2))
    sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
    if len(set(comps)) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    both, out = len(set(sides)) > 1, []
    for k, own in enumerate(sets):
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        close = np.flatnonzero(100 * common >= percent * (sizes + len(own) - common))
        for j in close:
            if j > k and (not both or sides[j] != sides[k]) and root(comps[j]) != root(comps[k]):
                parent[root(comps[j])] = root(comps[k])
                out.append((ids[k], ids[j]))
    return out


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for key, i, j, ident, comp, side, hashes in _rows(batches, ["key", "i", "j", "id", "comp", "side", "hashes"]):
            if (key, i, j) != group:
                if len(rows) > 1:
                    yield _pairs_out(_cross(rows, percent))
                group, rows = (key, i, j), []
            rows.append((ident, comp, side, hashes))
        if len(rows) > 1:
            yield _pairs_out(_cross(rows, percent))

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Two documents link if 100 * common shingles >= percent * shingles of either. component_id is the smallest doc_id
    reachable by links, kept whether it is the row's own. A null, empty or wordless text has no shingles, links with
    nothing and is kept. Rows that share a doc_id are one document with the links of each. A row without doc_id links
    with nothing, has no component_id and is kept. An empty table gives none. Other columns are not read.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(docs.mapInArrow(_signatures(size), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signatures")
    usable = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keys = stored(classes.select("rep", "sig").mapInArrow(_keys, "key long, id long"), "keys")
    buckets = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = stored(keys.join(buckets, "key"), "buckets")

    # Members meet the centre of their bucket, each pair once; a centre with many members is split by salt.
    pairs = shared.filter(F.col("id") != F.col("centre")).select(F.col("centre").alias("g"), "id").distinct()
    degree = pairs.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    placed = pairs.join(degree, "g").select("g", in_parts("id", F.col("salts")).alias("salt"), F.lit(True).alias("member"), "id")
    centres = placed.select("g", "salt").distinct().select("g", "salt", F.lit(False).alias("member"), F.col("g").alias("id"))
    met = stored(placed.unionByName(centres), "stars")
    wanted = met.select(F.col("id").alias("doc_id")).distinct()
    sets = stored(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "id long, hashes binary"), "sets", "none")
    sorted_groups = met.join(sets, "id").repartition("g", "salt").sortWithinPartitions("g", "salt", "member")
    star_links = stored(sorted_groups.mapInArrow(_star_links(percent), "a long, b long"), "star-links")

    # Buckets whose members beside the centre lie in different components still hide links; these are searched in blocks.
    first = stored(components(star_links), "first-components")
    labelled = shared.join(first.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    others = F.when(F.col("id") != F.col("centre"), F.col("comp"))
    split = labelled.groupBy("key").agg(F.min(others).alias("lo"), F.max(others).alias("hi")).filter(F.col("lo") != F.col("hi")).select("key")
    rest = labelled.join(split, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", in_parts("id", F.col("blocks")))
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "comp", F.col("own").alias("side")
    )
    blocks = dealt.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = star_links.unionByName(blocks.mapInArrow(_block_links(percent), "a long, b long"))

    # Rows with the same doc_id are one node, so their classes link as well.
    member = usable.join(classes.drop("sig"), ["d1", "d2", "n_shingles"])
    own = member.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = own.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter(F.col("lo") != F.col("hi"))
    twice = own.join(repeated.select("a"), "a").select("a", "b").unionByName(own.join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi"))
    found = stored(components(links.unionByName(twice)), "components")
    smallest = found.join(found.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")

    by_class = classes.select("d1", "d2", "n_shingles", F.col("rep").alias("id")).join(smallest, "id", "left")
    by_class = by_class.select("d1", "d2", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    out = signed.join(by_class, ["d1", "d2", "n_shingles"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.least("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that repeat a kept one; all columns as they are.

    Rows that share a kept doc_id are one document, so all of them stay, equal ones too.
    """
    gone = near_duplicates(docs, size, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
