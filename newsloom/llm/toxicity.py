"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is a logistic function of the weights of its words and word beginnings; a document is toxic unless
all its sentences are clean, so its score is the noisy-or 1 - prod(1 - sentence). The weights are fitted to document
labels through that product, and the sentence scores then point at what offends. Words are runs of letters, A-Z
lower-cased; sentences end at . ! ? or a line end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import mixed, stored, table, whole_row
from newsloom.llm.language import held_out
from newsloom.llm.words import mix, sliced, text_bytes, word_hashes, word_spans
from newsloom.session import tune

#: Labelled documents of either label that the fit takes, features it keeps, documents a feature must occur in, rounds, shrinkage.
TRAIN, FEATURES, LEAST, ROUNDS, SHRINK = 4000, 8192, 5, 200, 1e-4
#: Bytes of text of either label that the fit reads at most.
SAMPLE_BYTES = 1 << 28
#: Bytes of the word beginnings that are features beside the words themselves.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
THRESHOLD = 0.3
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

_BORDER = np.ones(256, dtype=bool)
_BORDER[65:91] = _BORDER[97:123] = _BORDER[128:] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 63]] = True
_MARK = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Sentences:
    """Sentences of a batch of texts: the text of each, its bytes, and the sentence of each word."""

    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    word: np.ndarray
    data: np.ndarray
    word_begin: np.ndarray
    word_end: np.ndarray

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Feature hashes and the sentence of each: the words, then their beginnings length by length."""
        yield word_hashes(self.data, self.word_begin, self.word_end), self.word
        for size in BEGINNINGS:
            longer = np.flatnonzero(self.word_end - self.word_begin > size)
            start = self.word_begin[longer]
            yield mix(word_hashes(self.data, start, start + size) ^ _MARK), self.word[longer]


def sentences(texts: pa.Array) -> Sentences:
    data, ends = text_bytes(texts)
    begin, end, first = word_spans(data, ends, _BORDER)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    stops = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    passed = stops[begin]
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = (passed[1:] != passed[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(fresh)
    last = np.concatenate((starts[1:], [len(begin)]))[: len(starts)] - 1
    owner = doc[starts]
    return Sentences(owner, begin[starts] - ends[owner], end[last] - ends[owner], np.cumsum(fresh) - 1, data, begin, end)


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.known >> np.uint64(44)] = True

    def found(self, features: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in known and sentence of the features that the model knows."""
        likely = np.flatnonzero(self.filter[features >> np.uint64(44)])
        features, sentence = features[likely], sentence[likely]
        if not len(features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        right = self.known[at] == features
        return at[right], sentence[right]

    def scores(self, rows: Sentences) -> np.ndarray:
        z = np.full(len(rows.owner), self.bias)
        for features, sentence in rows.features():
            at, sentence = self.found(features, sentence)
            z += np.bincount(sentence, weights=self.weights[at], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(p: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Chance that no sentence of a document is toxic."""
    return np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs))


def fit(known: np.ndarray, at: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Adam on the likelihood of the document labels: at and sentence tell which known feature is in which sentence."""
    if not len(owner):
        share = float(np.average(label, weights=weight)) if len(label) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    docs, count = len(label), len(owner)
    x = np.zeros(len(known) + 1)
    x[-1] = -5.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = x[-1] + np.bincount(sentence, weights=x[at], minlength=count)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = noisy_or(p, owner, docs)
        # The slope of a document's log-likelihood by a sentence's logit: p (1 - P) / P if toxic, else -p.
        slope = p * (weight * np.where(label == 1, clean / np.maximum(1 - clean, 1e-9), -1.0))[owner]
        g = np.concatenate([np.bincount(at, weights=slope[sentence], minlength=len(known)), [slope.sum()]]) / weight.sum()
        g[:-1] -= SHRINK * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(known, x[:-1], float(x[-1]))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents of either label hold each feature, slice by slice."""
    for batch in batches:
        for part in sliced(batch, "text"):
            rows = sentences(part.column("text"))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False) == 1
            for features, sentence in rows.features():
                pair = np.unique(np.stack([features, rows.owner[sentence].astype(np.uint64)], axis=1), axis=0) if len(features) else np.zeros((0, 2), np.uint64)
                names, which = np.unique(pair[:, 0], return_inverse=True)
                bad = np.bincount(which, weights=toxic[pair[:, 1].astype(np.int64)], minlength=len(names)).astype(np.int64)
                every = np.bincount(which, minlength=len(names))
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(bad), pa.array(every)], names=["feature", "bad", "every"])


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document: its label, weight, sentences, and the known features with their sentences."""
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                rows = sentences(part.column("text"))
                found = [model.found(*x) for x in rows.features()]
                at, sentence = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                order = np.argsort(sentence, kind="stable")
                at, sentence = at[order], sentence[order]
                cut = np.searchsorted(rows.owner, np.arange(part.num_rows + 1))
                where = np.searchsorted(sentence, cut)
                out = [(at[a:b].astype(np.int32).tobytes(), (sentence[a:b] - s).astype(np.int32).tobytes()) for a, b, s in zip(where[:-1], where[1:], cut[:-1], strict=True)]
                yield pa.record_batch(
                    [part.column("toxic"), part.column("weight"), pa.array(np.diff(cut)), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))],
                    names=["toxic", "weight", "count", "at", "sentences"],
                )

    return run


def docs_of_sample(chosen: DataFrame, most: int) -> DataFrame:
    """The different texts of the chosen ids, about 2 * most and at most SAMPLE_BYTES of either label."""
    spark = chosen.sparkSession
    texts = stored(chosen.distinct().withColumn("lot", F.xxhash64(F.lit(31), "doc_id", "text")).repartition(16), "labelled")
    found = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held = F.when(F.col("toxic") == 1, found.get(1, 0)).otherwise(found.get(0, 0))
    thin = texts.filter(F.pmod("lot", F.lit(1_000_000)) / 1_000_000.0 * held < 2 * most)
    kept = []
    for toxic, n in found.items():
        room, lots = SAMPLE_BYTES, []
        for r in sorted(thin.filter(F.col("toxic") == toxic).select("lot", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()):
            if r["size"] <= room:
                room -= r["size"]
                lots.append(r["lot"])
        kept += [(lot, n / len(lots)) for lot in lots]
    # A few thousand lots of either label, by the bound above.
    lots = F.broadcast(spark.createDataFrame(kept, "lot long, times double").distinct())
    return texts.join(lots, "lot").select("toxic", (F.col("weight") * F.col("times")).alias("weight"), "text")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model:
    """A model of the labelled documents that aren't held out; about most of either label, chosen by a hash of the id.

    The driver fits on the sampled documents' known features, at most FEATURES of them, picked by chi-square over
    counts made in tasks. Sampled labels weigh by their share, so scores keep the labels' rates. A document with several
    labels counts as toxic if one says so; null labels and other values are left out. Equal texts of one doc_id count
    once. Where labelled ids hold several texts, about 2 * most texts of either label are fitted on, by a hash of id
    and text, and of these no more than SAMPLE_BYTES of either label; the weights make up for the others.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out("doc_id"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = F.when(F.col("toxic") == 1, counts.get(1, 0)).otherwise(counts.get(0, 0))
    share = F.pmod(mixed("doc_id", 29), F.lit(1_000_000)) / 1_000_000.0
    taken = known.filter(share * total < most).select("doc_id", "toxic", F.greatest(total / most, F.lit(1.0)).alias("weight"))
    # The chosen labels are bounded by most, so sending them to every task is.
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taken), "doc_id")
    chosen = docs_of_sample(chosen, most)
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    seen = chosen.mapInArrow(_occurrences, "feature long, bad long, every long").groupBy("feature").agg(F.sum("bad").alias("a"), F.sum("every").alias("n")).filter(F.col("n") >= LEAST)
    a, n, every = F.col("a").cast("double"), F.col("n").cast("double"), float(bad + good)
    gap = a * every - n * bad
    chi = gap * gap / (n * F.greatest(every - n, F.lit(1.0)))
    picked = seen.withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(FEATURES).select("feature").collect()
    names = np.sort(np.array([r[0] for r in picked], dtype=np.int64).view(np.uint64))
    rows = chosen.mapInArrow(_features(Model(names, np.zeros(len(names)), 0.0)), "toxic int, weight double, count long, at binary, sentences binary").collect()
    label, weight = np.array([r["toxic"] for r in rows], dtype=np.int64), np.array([r["weight"] for r in rows], dtype=np.float64)
    count = np.array([r["count"] for r in rows], dtype=np.int64)
    base = np.cumsum(count) - count
    joined = lambda c: np.frombuffer(b"".join(r[c] for r in rows), dtype=np.int32).astype(np.int64)
    held = np.array([len(r["at"]) // 4 for r in rows], dtype=np.int64)
    return fit(names, joined("at"), joined("sentences") + np.repeat(base, held), np.repeat(np.arange(len(rows)), count), label, weight)


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = sentences(part.column("text"))
                owner, begin, end = rows.owner, rows.begin, rows.end
                p = model.scores(rows)
                clean = noisy_or(p, owner, part.num_rows)
                bad = np.flatnonzero(p >= threshold)
                where = np.zeros(part.num_rows + 1, dtype=np.int32)
                np.cumsum(np.bincount(owner[bad], minlength=part.num_rows), out=where[1:])
                spans = pa.StructArray.from_arrays([pa.array(begin[bad].astype(np.int64)), pa.array(end[bad].astype(np.int64)), pa.array(p[bad])], ["start", "end", "score"])
                columns = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name != "text"]
                names = [n for n in part.schema.names if n != "text"]
                score = np.clip(1 - clean, 0.0, 1.0)
                yield pa.record_batch([*columns, pa.array(score), pa.ListArray.from_arrays(pa.array(where), spans)], names=[*names, "score", "offending"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (byte spans and scores of sentences at or over the threshold).

    A null text and one without letters hold no sentence and score 0. A null doc_id isn't held out. Repeated rows are
    scored alike. An empty table gives none. Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, offending array<struct<start:long,end:long,score:double>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is under the threshold, all columns as they are; a null text is kept."""
    tune(docs.sparkSession)
    model = train(docs, labels)
    # The text goes through a task once: each row carries its own columns beside the score.
    rows = docs.select(F.col("text").cast("string").alias("text"), whole_row(docs))
    schema = rows.select("_row").schema.add("score", "double").add("offending", T.ArrayType(SPAN))
    return rows.mapInArrow(_score(model, threshold), schema).filter(F.col("score") < threshold).select("_row.*")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    return score_documents(docs, model).drop("offending")
