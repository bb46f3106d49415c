"""What each filter of a chain removes in every order, from a sparse document-term matrix.

Tasks turn about SHARD bytes of text at a time into one CSR shard: a row for each document, a column for each word,
counts as values, over a dictionary of the shard's own words. The shards' dictionaries meet once, sorted by word in
buckets, where every word gets its global code; the codes go back to their shards and replace the local ones. Row sums
are words, nonzero counts are distinct words. Two filters read these; two read characters; one asks whether a smaller
doc_id has the same text. Documents then only count by part, failed filters and labels, and each part's counts give all
120 orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import in_parts, stored, table
from newsloom.llm.vectors import consecutive
from newsloom.llm.words import sliced, text_bytes, word_spans
from newsloom.session import tune

#: Bytes of text that begin a new shard, bytes looked at at once, buckets of the dictionary, rows of an Arrow batch of codes.
SHARD, PIECE, BUCKETS, CODE_ROWS = 16 << 20, 4 << 20, 4096, 16384
#: Fewest words, fewest distinct words and most capitals in a hundred, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "#$%&*|"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_FACTS = "docs array<struct<doc_id:bigint,source:string,text:binary,capitals:boolean,marks:boolean>>"
LOCAL = f"shard long, {_FACTS}, words array<string>, width long, cells binary, counts binary"
CSR = f"shard long, {_FACTS}, starts binary, columns binary, counts binary"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in MARKS]] = True


def matrix(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a shard, the filled cells (row * number of words + column, rising) of its matrix, and their counts."""
    coded, rows, at = [], [], 0
    for part in sliced(pa.record_batch([texts], names=["text"]), "text", PIECE):
        data, ends = text_bytes(part.column(0))
        begin, end, first = word_spans(data, ends, _BLANK)
        places = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(end - begin, out=places[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(data[~_BLANK[data]])])
        coded.append(words.dictionary_encode())
        rows.append(np.repeat(np.arange(at, at + part.num_rows, dtype=np.int64), np.diff(first)))
        at += part.num_rows
    if not coded:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = pa.chunked_array(coded).unify_dictionaries()
    words = shared.chunk(0).dictionary
    found = [np.unique(r * max(len(words), 1) + c.indices.to_numpy(zero_copy_only=False), return_counts=True) for r, c in zip(rows, shared.chunks, strict=True)]
    cells, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return words.cast(pa.large_string()).cast(pa.string()), cells, counts


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes for a shuffle: equal bytes of all of them together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def loosened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _between(found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the places found lie in each text."""
    return np.diff(np.searchsorted(found, ends))


def _facts(batch: pa.RecordBatch) -> pa.Array:
    data, ends = text_bytes(batch.column("text"))
    capitals = _between(np.flatnonzero((data >= 65) & (data <= 90)), ends)
    points = np.diff(ends) - _between(np.flatnonzero((data & 0xC0) == 0x80), ends)
    marks = _between(np.flatnonzero(_MARK[data]), ends)
    whole = memoryview(data)
    digests = [blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = [batch.column("doc_id"), batch.column("source"), pa.array(digests, pa.binary()), pa.array(100 * capitals > CAPITALS * points), pa.array(marks > 0)]
    return pa.StructArray.from_arrays(columns, ["doc_id", "source", "text", "capitals", "marks"])


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, weight = [], 0

        def shard() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words, cells, counts = matrix(rows.column("text"))
            facts = pa.concat_arrays([_facts(part) for part in sliced(rows, "text", PIECE)])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (facts, words)]
            number += 1
            blobs = [pa.array([squeezed(x)], pa.binary()) for x in (np.diff(cells, prepend=0), counts)]
            return pa.record_batch([pa.array([number - 1], pa.int64()), *lists, pa.array([len(words)], pa.int64()), *blobs], names=["shard", "docs", "words", "width", "cells", "counts"])

        for batch in batches:
            sizes = np.cumsum(np.diff(text_bytes(batch.column("text"))[1]))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, before + size - weight, side="right")))
                held.append(batch.slice(at, upto - at))
                weight += int(sizes[upto - 1] - before)
                at = upto
                if weight >= size or at < batch.num_rows:
                    yield shard()
                    held, weight = [], 0
        if held:
            yield shard()

    return run


def local_shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Shards over dictionaries of their own: docs, words, and the filled cells and counts, squeezed for their way."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_shards(size), LOCAL)


def word_codes(shards: DataFrame) -> DataFrame:
    """shard, place, word and code for each word of each shard: a word has one code, whatever its shards.

    Words are dealt to buckets by hash and numbered in order within; the code is the bucket and the number. A word is
    there once for each shard, so no word makes a bucket heavier than the others by more than the count of shards.
    """
    words = shards.select("shard", F.posexplode("words").alias("place", "word")).withColumn("bucket", in_parts("word", BUCKETS))
    number = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    return words.select("shard", "place", "word", (F.shiftleft(F.col("bucket").cast("long"), 40) + number).alias("code"))


def dictionary(shards: DataFrame) -> DataFrame:
    """word and code, once each."""
    return word_codes(shards).groupBy("word").agg(F.first("code").alias("code"))


def _code_list(key: tuple, rows: pa.Table) -> pa.RecordBatch:
    return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([squeezed(rows.column("code").to_numpy())], pa.binary())], names=["shard", "codes"])


def _code_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from consecutive(batches, ["shard"], _code_list)


def _recoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            width, codes = max(batch.column("width")[k].as_py(), 1), batch.column("codes")[k].as_py()
            cells = np.cumsum(loosened(batch.column("cells")[k].as_py()))
            codes = loosened(codes) if codes is not None else np.zeros(0, np.int64)
            starts = np.searchsorted(cells, np.arange(len(batch.column("docs")[k]) + 1, dtype=np.int64) * width)
            blobs = [starts.astype(np.int64), codes[cells % width], loosened(batch.column("counts")[k].as_py()).astype(np.int32)]
            yield pa.record_batch([batch.column("shard").slice(k, 1), batch.column("docs").slice(k, 1), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["shard", "docs", "starts", "columns", "counts"])


def document_terms(docs: DataFrame, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix as CSR shards over the global dictionary, and the shards over their own.

    A shard is a row: docs (their doc_id, source, digest of the text and two flags), starts (int64, one more than docs),
    columns (int64 word codes) and counts (int32), the last three as bytes. Null texts are empty rows of the matrix.
    """
    spark = docs.sparkSession
    shards = stored(local_shards(docs, size), "csr")
    codes = word_codes(shards.select("shard", "words")).select("shard", "place", "code")
    # Codes are narrow rows, many to a batch; pages and documents are wide ones, few to a batch.
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CODE_ROWS))
    try:
        lists = stored(codes.repartition("shard").sortWithinPartitions("shard", "place").mapInArrow(_code_lists, "shard long, codes binary"), "word-codes")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    return shards.drop("words").join(lists, "shard", "left").mapInArrow(_recoded, CSR), shards


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, text and failed for every document: bits of the filters A to D that it fails."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs = batch.column("docs").slice(k, 1).flatten()
            starts, columns, counts = (np.frombuffer(batch.column(c)[k].as_py(), dtype=t) for c, t in (("starts", np.int64), ("columns", np.int64), ("counts", np.int32)))
            sums = np.zeros(len(counts) + 1, dtype=np.int64)
            np.cumsum(counts, out=sums[1:])
            words, distinct = sums[starts[1:]] - sums[starts[:-1]], np.diff(starts)
            flags = [words < WORDS, 100 * distinct < DISTINCT * words, *(docs.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in (3, 4))]
            failed = sum(f.astype(np.int32) << b for b, f in enumerate(flags))
            yield pa.record_batch([docs.field(0), docs.field(1).fill_null(""), docs.field(2), pa.array(failed, pa.int32())], names=["doc_id", "part", "text", "failed"])


def audit_rows(count: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for the counts of the 32 sets of failed filters."""
    sets = np.arange(32)
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (sets & bit) > 0, (sets & before) > 0
            here = fails & ~gone
            before |= bit
            total[letter] += int(count[here].sum())
            rows.append((order, step, count[(sets & before) == 0].sum(), count[here].sum(), count[fails & gone].sum(), count[bit], good[here].sum(), toxic[here].sum()))
    return [(*r, total[r[0][r[1] - 1]]) for r in rows]


_OUT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _OUT)


def _all_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sets in zip(batch.column("part").to_pylist(), batch.column("sets").to_pylist(), strict=True):
            counts = np.zeros((3, 32), dtype=np.int64)
            for s in sets:
                counts[:, s["failed"]] += (s["n"], s["n"] * s["good"], s["n"] * s["toxic"])
            rows = audit_rows(*counts)
            columns = [pa.array([part] * len(rows), pa.string()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())]
            columns += [pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(2, 9)]
            yield pa.record_batch(columns, names=["part", "filter_order", "step", *_OUT])


def audit(docs: DataFrame, labels: DataFrame, size: int = SHARD) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step keeps, removes and leaves to others.

    A null text is empty and fails A; an empty text passes B and C. A null source counts with the empty one. Rows
    that repeat a doc_id count each: they fail E only through a smaller doc_id, and a null doc_id never fails it. A
    document is good (toxic) if any label row of its id says quality (toxic) 1; other labels and nulls say nothing.
    Columns other than doc_id, source, text and the labels' doc_id, quality, toxic are not read. An empty table gives
    no rows, an empty table of labels zeros. Texts of any length are read whole; a task holds one shard, at least one text.
    """
    tune(docs.sparkSession)
    terms, _ = document_terms(docs, size)
    facts = terms.mapInArrow(_failures, "doc_id long, part string, text binary, failed int")
    # Rows meet by their own ids first, so a text that a third of the rows share is counted before it is one key.
    rows = stored(facts.groupBy("doc_id", "part", "text", "failed").agg(F.count("*").alias("n")), "facts")
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
    marked = rows.join(marks, "doc_id", "left")
    good, toxic = (F.coalesce(F.col(c), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    same = marked.select("doc_id", "part", "text", "failed", "n", good, toxic).groupBy("text", "failed", "part", "good", "toxic")
    none = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    same = same.agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), none.alias("without"))
    first = F.min("least").over(Window.partitionBy("text"))
    same = same.withColumn("passed", F.col("without") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    both = F.array(F.struct(F.col("failed"), F.col("passed").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("passed")).alias("n")))
    sets = same.select("part", "good", "toxic", F.explode(both).alias("s")).groupBy("part", "s.failed", "good", "toxic").agg(F.sum("s.n").alias("n"))
    # At most 32 sets of failed filters by four kinds of labels a part.
    return sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets")).mapInArrow(_all_orders, _SCHEMA)


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
first AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 5 * length(w.text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS failed
  FROM w JOIN first USING (text) LEFT JOIN l USING (doc_id)),
h AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || letter, used | bit FROM o JOIN b ON used & bit = 0),
s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(c.bit), 0) FROM b c WHERE strpos(filter_order, c.letter) < step)::BIGINT AS before
  FROM o, range(1, 6) r(step) JOIN b ON substr(filter_order, step, 1) = letter WHERE used = 31),
c AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN failed & bit > 0 AND failed & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN failed & bit > 0 AND failed & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN failed & bit > 0 AND failed & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN failed & bit > 0 AND failed & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c
"""
