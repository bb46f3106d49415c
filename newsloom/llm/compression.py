"""Quality by compression: a text is like those whose zstandard dictionary makes it smaller.

One dictionary is built from good and one from bad labelled texts. A text is compressed piece by piece with both; the
difference of its two sizes over the larger of them, and the bytes it takes a byte of text, go through a logistic curve
fitted on other labelled texts, which makes the difference a probability of the label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import mixed, stored, table
from newsloom.llm.words import sliced, text_bytes
from newsloom.session import tune

#: Labelled documents of either label that the model takes, half of them for dictionaries, half for the curve.
TRAIN = 4000
#: Bytes of a piece, pieces of either label that a dictionary is built from, bytes of a dictionary, compression level.
PIECE, PIECES, DICTIONARY, LEVEL = 1024, 16000, 112640, 3
#: Least pieces for a built dictionary; fewer are one after the other the dictionary.
FEW = 64
THRESHOLD = 0.3
SHRINK = 1e-3


def held_out(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Dictionaries of bad and good texts, and the curve: a constant and a weight for each of the two measures.

    Without texts of both labels there are no dictionaries, and the constant alone is the score.
    """

    bad: bytes = b""
    good: bytes = b""
    raw: tuple[bool, bool] = (False, False)
    base: float = 0.0
    weights: tuple[float, float] = (0.0, 0.0)


def pieces(text: memoryview, size: int = PIECE) -> Iterator[memoryview]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """The dictionary of the samples, and whether it is plain text rather than a built one."""
    if len(samples) >= FEW:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes(), False
        except zstandard.ZstdError:  # samples too few or too alike to build one
            pass
    return b"".join(samples)[-DICTIONARY:], True


class Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, model: Model) -> None:
        self._by = []
        for data, raw in zip((model.bad, model.good), model.raw, strict=True):
            made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
            made.precompute_compress(level=LEVEL)
            self._by.append(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def measures(self, text: memoryview) -> tuple[float, float]:
        """(bad - good) / larger of the compressed sizes, and their mean a byte of text; 0 and 0 without text."""
        if not len(text):
            return 0.0, 0.0
        bad = good = 0
        for piece in pieces(text):
            bad += len(self._by[0].compress(piece))
            good += len(self._by[1].compress(piece))
        return (bad - good) / max(bad, good), (bad + good) / (2 * len(text))


def _texts(column: pa.Array) -> Iterator[memoryview]:
    data, ends = text_bytes(column)
    whole = memoryview(np.ascontiguousarray(data))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield whole[a:b]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """good, mark and piece for each piece of the texts; the mark is a hash of the piece."""
    for batch in batches:
        for part in sliced(batch, "text", 1 << 20):
            found = [(g, bytes(p)) for g, t in zip(part.column("good").to_pylist(), _texts(part.column("text")), strict=True) for p in pieces(t)]
            marks = [int.from_bytes(blake2b(p, digest_size=8).digest(), "little", signed=True) for _, p in found]
            yield pa.record_batch([pa.array([g for g, _ in found], pa.int32()), pa.array(marks, pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["good", "mark", "piece"])


def _measured(model: Model):
    """The two measures in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model)
        for batch in batches:
            found = np.array([sizes.measures(t) for t in _texts(batch.column("text"))]).reshape(-1, 2)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*columns, pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*names, "gap", "rate"])

    return run


def curve(measures: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Constant and weights of the logistic curve by Newton's steps, shrunk a little so that separable labels stay finite."""
    centre, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-9
    rows = np.column_stack([np.ones(len(measures)), (measures - centre) / spread])
    at = np.zeros(3)
    shrink = SHRINK * np.eye(3) * max(weight.sum(), 1.0) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -40, 40)))
        steep = (rows * (weight * p * (1 - p))[:, None]).T @ rows + shrink
        at = at + np.linalg.solve(steep, rows.T @ (weight * (good - p)) - shrink @ at)
    slope = at[1:] / spread
    return float(at[0] - slope @ centre), (float(slope[0]), float(slope[1]))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model:
    """A model of labelled documents that aren't held out, about most of either label, chosen by a hash of the id.

    The driver gets at most PIECES pieces of PIECE bytes of either label, those of smallest hash among all pieces of
    the chosen texts, and at most 2 * most measures. Chosen documents weigh by their label's share, so scores keep the
    labels' rates. A document with several labels is good if all say so; null labels and other values are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    known = known.filter(~held_out("doc_id"))
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    base = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    if len(counts) < 2:
        return Model(base=base)
    total = F.when(F.col("good") == 1, counts[1]).otherwise(counts[0])
    share = F.pmod(mixed("doc_id", 31), F.lit(1_000_000)) / 1_000_000.0
    taken = known.filter(share * total < most).select("doc_id", "good", F.greatest(total / most, F.lit(1.0)).alias("weight"))
    # The chosen labels are bounded by most, so sending them to every task is.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    chosen = stored(chosen.repartition(16), "labelled")
    for_curve = F.pmod(mixed("doc_id", 37), F.lit(2)) == 0
    found = chosen.filter(~for_curve).select("good", "text").mapInArrow(_pieces, "good int, mark long, piece binary").dropDuplicates(["good", "mark"])
    samples = [[bytes(r["piece"]) for r in found.filter(F.col("good") == g).orderBy("mark", "piece").limit(PIECES).collect()] for g in (0, 1)]
    (bad, bad_raw), (good, good_raw) = (dictionary(s) for s in samples)
    if not bad or not good:
        return Model(base=base)
    model = Model(bad, good, (bad_raw, good_raw), base)
    rows = chosen.filter(for_curve).select("doc_id", "good", "weight", "text").mapInArrow(_measured(model), "doc_id long, good int, weight double, gap double, rate double").dropDuplicates()
    kept = [r for g in (0, 1) for r in rows.filter(F.col("good") == g).orderBy(mixed("doc_id", 41), "gap", "rate").limit(most).collect()]
    if len({r["good"] for r in kept}) < 2:
        return Model(base=base)
    model.base, model.weights = curve(*(np.array([r[c] for r in kept], dtype=np.float64) if isinstance(c, str) else np.array([[r[x] for x in c] for r in kept]) for c in (("gap", "rate"), "good", "weight")))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model.bad else None
        for batch in batches:
            found = np.array([sizes.measures(t) if sizes else (0.0, 0.0) for t in _texts(batch.column("text"))]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(model.base + found @ np.array(model.weights), -40, 40)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(found[:, 0])], names=["doc_id", "held_out", "score", "gap"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and gap (the normalised difference of compressed sizes) of every row.

    A null text counts as empty: no difference, and the score of none. Without labels of both kinds every score is the
    labels' rate, one half without any. A null doc_id isn't held out. Repeated rows score alike. An empty table gives
    none. Columns other than doc_id and text are not read. Texts are compressed whole, a piece at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, gap double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "gap")


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    docs = table(spark, folder, "documents")
    return score_documents(docs, train(docs, table(spark, folder, "labels"))).drop("gap")
