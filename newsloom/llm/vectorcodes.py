"""Product codes of vectors by exact integer Lloyd rounds over cover trees.

Each task keeps the rows it reads in blocks. A block has one cover tree for each part position: a node's points lie
within its radius of its centre, its children are centres more than half that radius apart, each with the points within
half of it. Points are stored in the order of the tree, so a subtree is a run of rows and running totals give its sum
and count. A round sends the codebooks down the trees: where the nearest entry is nearer to the centre than any other
by more than twice the radius, the whole subtree goes to it; other nodes are opened, and the points of an open leaf are
compared one by one in whole numbers. Only sums and counts of codebook entries leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored, table
from newsloom.llm.vectors import finite
from newsloom.session import tune

#: Parts of a vector, entries of a part's codebook, rounds, scale; numbers and rows of a block at most, points of a leaf.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK, BLOCK_ROWS, LEAF = 1 << 19, 4096, 16
#: A node goes as a whole only if it is nearer by this share more than the radius asks, far above rounding.
SLACK = 1e-9
BLOCKS = "width int, ids array<bigint>, labels array<bigint>, points binary, orders binary, nodes array<binary>"


def part_width(width: int) -> int:
    """Components of one part: a length that 8 doesn't divide is filled up with zeros."""
    return -(-width // PARTS)


def whole_numbers(rows: np.ndarray, width: int) -> np.ndarray:
    """floor(4096 x), within bounds that keep squared distances of whole vectors exact in 64 bits, filled to 8 parts."""
    most = int(2**30 / max(width, 1) ** 0.5)
    whole = np.clip(np.floor(rows * SCALE), -most, most).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, PARTS * part_width(width) - width)))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points in the tree, and its nodes: centre (a place in the order), start, end, first child, last child, radius.

    Children of a node follow each other; a leaf has none.
    """
    order = np.arange(len(points))
    nodes = [[0, 0, len(points), 0, 0, 0.0]]
    at = 0
    while at < len(nodes):
        _, start, end, _, _, _ = nodes[at]
        members = order[start:end]
        gap = ((points[members] - points[members[0]]) ** 2).sum(axis=1)
        far = float(np.sqrt(gap.max())) if len(members) else 0.0
        nodes[at][0], nodes[at][5] = start, far
        if len(members) > leaf and far > 0:
            limit, rest, runs = far * far / 4, members, []
            while len(rest):
                # The node's own centre is its first child's too.
                near = gap <= limit if rest is members else ((points[rest] - points[rest[0]]) ** 2).sum(axis=1) <= limit
                runs.append(rest[near])
                rest = rest[~near]
            order[start:end] = np.concatenate(runs)
            nodes[at][3], place = len(nodes), start
            for run in runs:
                nodes.append([0, place, place + len(run), 0, 0, 0.0])
                place += len(run)
            nodes[at][4] = len(nodes)
        at += 1
    return order, np.array(nodes, dtype=np.float64)


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points to entries, exact."""
    out = np.zeros((len(points), len(book)), dtype=np.int64)
    for k in range(points.shape[1]):
        gap = points[:, k, None] - book[None, :, k]
        out += gap * gap
    return out


def assign(points: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Runs of rows that go to an entry as a whole (starts, ends, entries), and single places with their entries.

    points lie in the order of the tree. Ties go to the lower entry.
    """
    whole, places, picks = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start, end, child, last = (nodes[:, k].astype(np.int64) for k in range(1, 5))
    front = np.array([0] if len(points) else [], dtype=np.int64)
    while len(front):
        gap = squares(points[nodes[front, 0].astype(np.int64)], book)
        best = gap.argmin(axis=1)
        near = np.sqrt(gap.astype(np.float64))
        two = np.partition(near, 1, axis=1)[:, :2] if len(book) > 1 else np.column_stack([near[:, 0], np.full(len(near), np.inf)])
        sure = two[:, 1] - two[:, 0] > 2 * nodes[front, 5] + SLACK * (1 + two[:, 0] + nodes[front, 5])
        # Equal points share their centre's entry, ties included.
        sure |= nodes[front, 5] == 0
        whole.append((start[front[sure]], end[front[sure]], best[sure]))
        open_ = front[~sure]
        leaf = child[open_] == 0
        found = _ranges(start[open_[leaf]], end[open_[leaf]])
        places.append(found)
        picks.append(squares(points[found], book).argmin(axis=1))
        front = _ranges(child[open_[~leaf]], last[open_[~leaf]])
    return whole, np.concatenate(places), np.concatenate(picks)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _block(width: int, held: list[tuple]) -> pa.RecordBatch:
    ids, labels = ([x for h in held for x in h[k]] for k in (0, 1))
    points = whole_numbers(np.concatenate([h[2] for h in held]), width)
    size = part_width(width)
    trees = [cover_tree(points[:, p * size : (p + 1) * size]) for p in range(PARTS)]
    orders = np.array([t[0] for t in trees], dtype=np.int32)
    row = [[width], [ids], [labels], [points.astype(np.int32).tobytes()], [orders.tobytes()], [[t[1].tobytes() for t in trees]]]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary())]
    names = ["width", "ids", "labels", "points", "orders", "nodes"]
    return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows as they come, each of one vector length."""
    open_: dict[int, list[tuple]] = {}
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        for width in np.unique(sizes):
            part = batch.filter(pa.array(sizes == width))
            rows = np.asarray(part.column("vector").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(part.num_rows, int(width))
            held = open_.setdefault(int(width), [])
            held.append((part.column("vec_id").to_pylist(), part.column("label").to_pylist(), rows))
            if sum(len(h[0]) for h in held) >= min(BLOCK_ROWS, max(1, BLOCK // max(int(width), 1))):
                yield _block(int(width), held)
                del open_[int(width)]
    for width, held in open_.items():
        yield _block(width, held)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], int]]:
    """width, points, orders, nodes and place of every block of a batch."""
    for k in range(batch.num_rows):
        width = batch.column("width")[k].as_py()
        count = len(batch.column("ids")[k])
        points = np.frombuffer(batch.column("points")[k].as_py(), dtype=np.int32).astype(np.int64).reshape(count, PARTS * part_width(width))
        orders = np.frombuffer(batch.column("orders")[k].as_py(), dtype=np.int32).reshape(PARTS, count)
        yield width, points, orders, [np.frombuffer(n, dtype=np.float64).reshape(-1, 6) for n in batch.column("nodes")[k].as_py()], k


def _sums(books: dict[int, np.ndarray]):
    """Counts and componentwise sums of every entry, one set of rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, points, orders, nodes, _ in _opened(batch):
                size, book = part_width(width), books[width]
                if width not in totals:
                    totals[width] = np.zeros((PARTS, book.shape[1], size + 1), dtype=np.int64)
                for p in range(PARTS):
                    mine = np.ones((len(points) + 1, size + 1), dtype=np.int64)
                    mine[1:, :size] = points[orders[p], p * size : (p + 1) * size]
                    running = mine.copy()
                    running[0] = 0
                    np.cumsum(running, axis=0, out=running)
                    whole, places, picks = assign(mine[1:, :size], nodes[p], book[p])
                    for start, end, entries in whole:
                        np.add.at(totals[width][p], entries, running[end] - running[start])
                    np.add.at(totals[width][p], picks, mine[1:][places])
        for width, total in totals.items():
            part, entry, place = (x.ravel() for x in np.indices(total.shape))
            columns = [np.full(total.size, width), part, entry, place, total.ravel()]
            yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(columns, ("i4", "i4", "i4", "i4", "i8"), strict=True)], names=["width", "part", "entry", "place", "total"])

    return run


def _coded(books: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, points, orders, nodes, k in _opened(batch):
                size, book = part_width(width), books[width]
                codes = np.zeros((len(points), PARTS), dtype=np.uint8)
                error = np.zeros(len(points), dtype=np.int64)
                for p in range(PARTS):
                    mine = points[orders[p], p * size : (p + 1) * size]
                    whole, places, picks = assign(mine, nodes[p], book[p])
                    picked = np.zeros(len(points), dtype=np.int64)
                    for start, end, entries in whole:
                        picked[_ranges(start, end)] = np.repeat(entries, end - start)
                    picked[places] = picks
                    codes[orders[p], p] = picked
                    error[orders[p]] += ((mine - book[p][picked]) ** 2).sum(axis=1)
                texts = [c.tobytes().hex() for c in codes]
                lists = [batch.column(c).slice(k, 1).flatten() for c in ("ids", "labels")]
                yield pa.record_batch([pa.array(np.full(len(points), width, dtype=np.int32)), *lists, pa.array(texts, pa.string()), pa.array(error)], names=["width", "vec_id", "label", "code", "error"])

    return run


def first_books(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the parts of its 16 smallest vec_ids: [part, entry, component]."""
    first = rows.select("size", "vec_id").distinct()
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("size").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("at") <= ENTRIES)
    # Sixteen ids a length.
    first = F.broadcast(first.select(F.col("size").alias("of"), F.col("vec_id").alias("id"), "at"))
    begun = rows.join(first, (F.col("size") == F.col("of")) & F.col("vec_id").eqNullSafe(F.col("id"))).groupBy("size", "at").agg(F.min("vector").alias("vector"))
    few = begun.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("at", "vector"))).alias("top"))
    books = {}
    for row in few.collect():
        width = row["size"]
        first = whole_numbers(np.array([list(t["vector"]) for t in row["top"]], dtype=np.float64).reshape(len(row["top"]), width), width)
        books[width] = first.reshape(len(first), PARTS, part_width(width)).transpose(1, 0, 2)
    return books


def book_digest(book: np.ndarray) -> str:
    return sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def product_codes(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """width, vec_id, label, code and error of every kept row, and the codebooks by vector length.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length have codebooks
    of their own; a length that 8 doesn't divide is filled up with zeros, which add nothing to a distance. Scaled
    components are held within 2**30 / sqrt(length) of 0, so that distances are exact. The first entries are the 16
    smallest vec_ids, fewer if there are fewer, null last; of rows that share a vec_id the one with the smallest
    components begins an entry, and all are coded. An empty table gives no rows and no codebooks. Columns other than
    vec_id, embedding and label are not read. The driver holds one codebook for each length and nothing of the rows.
    """
    spark = tune(rows.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    empty = F.coalesce(F.size("vector") == 0, F.lit(False))
    kept = kept.filter(finite("vector") | empty).withColumn("size", F.size("vector"))
    books = first_books(kept.select("size", "vec_id", "vector"))
    blocks = stored(kept.mapInArrow(_trees, BLOCKS), "cover-trees")
    for _ in range(rounds if books else 0):
        sums = blocks.mapInArrow(_sums(books), "width int, part int, entry int, place int, total long")
        total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        found = sums.groupBy("width", "part", "entry", "place").agg(total).collect()
        books = {width: book.copy() for width, book in books.items()}
        counts = {(r["width"], r["part"], r["entry"]): int(r["total"]) for r in found if r["place"] == part_width(r["width"])}
        for r in found:
            n = counts[r["width"], r["part"], r["entry"]]
            if n and r["place"] < part_width(r["width"]):
                books[r["width"]][r["part"], r["entry"], r["place"]] = int(r["total"]) // n
    coded = blocks.mapInArrow(_coded(books), "width int, vec_id long, label long, code string, error long")
    return (coded if books else spark.createDataFrame([], coded.schema)), books


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = product_codes(table(spark, folder, "embeddings"))
    coded = stored(coded, "codes")
    # Sums of a label meet before its rows are looked up, so a label of a third of all rows is one row here.
    whole = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    labels = coded.groupBy("label").agg(whole).withColumnRenamed("label", "of")
    digest = F.create_map(*[F.lit(x) for width, book in books.items() for x in (width, book_digest(book))]) if books else F.create_map().cast("map<int,string>")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.element_at(digest, F.col("width")).alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd rounds written out, one pair of tables a round."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS e FROM embeddings"
        "  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 8 + 1 : (part + 1) * len(e) // 8] AS e FROM v, range(8) r(part))",
        "b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    near = (
        "a{k} AS MATERIALIZED (SELECT vec_id, part, (min(struct_pack(d := d, entry := entry))) AS best FROM (SELECT p.vec_id, p.part, b.entry,"
        "  list_inner_product(p.e, p.e) - 2 * list_inner_product(p.e, b.e) + list_inner_product(b.e, b.e) AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY vec_id, part)"
    )
    for k in range(ROUNDS):
        steps += [
            near.format(k=k),
            f"c{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY place) AS e FROM (SELECT part, entry, place, floor(sum(x) / count(*)) AS m FROM"
            f"  (SELECT p.part, a.best.entry AS entry, unnest(p.e) AS x, unnest(range(len(p.e))) AS place FROM p JOIN a{k} a USING (vec_id, part)) GROUP BY part, entry, place) GROUP BY part, entry)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(c.e, b.e) AS e FROM b{k} b LEFT JOIN c{k} c ON b.part = c.part AND b.entry = c.entry)",
        ]
    steps += [
        near.format(k=ROUNDS),
        f"o AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(e) AS x, unnest(range(len(e))) AS place FROM b{ROUNDS}))",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h"


#: Exact while vec_id is unique and all vectors have one length that 8 divides, as the tables' are.
SQL = _sql()
