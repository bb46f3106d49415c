"""Language identification by hyperdimensional profiles.

Each letter has a random +1/-1 vector. A run of three letters is the product of its letters' vectors, each rolled by its
place; a text is the sum of its runs, a language the sum of its training texts scaled to unit length; the language with
the highest cosine wins. Letters are lower-cased, everything else is one word border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import mixed, stored, table
from newsloom.session import tune

#: Dimensions, letters of a run, training texts taken of each language on average, runs kept in a task's table.
DIMENSIONS, RUN, TRAIN, TABLE = 1024, 3, 2000, 32768
UNKNOWN = "und"
#: Languages up to which their table, a short row each, is sent to every task; beyond it Spark picks the join.
SENT_LANGUAGES = 50_000


def held_out(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Profiles:
    """Vectors of texts; letter and run vectors are made when first met."""

    _letters: np.ndarray | None = None

    def __init__(self) -> None:
        if Profiles._letters is None:
            codes = range(0x110000)
            lower = np.zeros(0x110000, dtype=np.int64)
            for c in codes:
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    lower[c] = ord(low) if len(low) == 1 else c
            Profiles._letters = lower
        self.runs: dict[int, int] = {}
        self.vectors = np.empty((1024, DIMENSIONS), dtype=np.float32)
        self.single: dict[int, np.ndarray] = {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.single:
            self.single[code] = np.random.Generator(np.random.PCG64([17, code])).choice(np.array([-1, 1], dtype=np.float32), DIMENSIONS)
        return self.single[code]

    def _rows(self, runs: np.ndarray) -> np.ndarray:
        if len(self.runs) + len(runs) > TABLE:
            self.runs.clear()
        at = [self.runs.get(r, -1) for r in runs.tolist()]
        for k, r in enumerate(runs.tolist()):
            if at[k] < 0:
                at[k] = self.runs[r] = len(self.runs)
                if at[k] >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                bound = np.ones(DIMENSIONS, dtype=np.float32)
                for place in range(RUN):
                    bound = bound * np.roll(self._letter((r >> (21 * place)) & 0x1FFFFF), place)
                self.vectors[at[k]] = bound
        return self.vectors[at]

    def vector(self, text: str) -> np.ndarray | None:
        """The text's vector, None without letters. Any text works: long ones are summed in parts."""
        codes = Profiles._letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        letters = codes > 0
        if not letters.any():
            return None
        codes = codes[letters | np.concatenate(([True], letters[:-1]))]
        codes = np.concatenate(([0] if codes[0] else [], codes, [0] if codes[-1] else [])).astype(np.int64)
        grams = np.zeros(len(codes) - RUN + 1, dtype=np.int64)
        for place in range(RUN):
            grams |= codes[place : len(codes) - RUN + 1 + place] << (21 * place)
        runs, counts = np.unique(grams, return_counts=True)
        total = np.zeros(DIMENSIONS, dtype=np.float64)
        for at in range(0, len(runs), 8192):
            total += counts[at : at + 8192].astype(np.float32) @ self._rows(runs[at : at + 8192])
        return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum of unit vectors for each language of the task's texts."""
    profiles, sums = Profiles(), {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            v = profiles.vector(text or "")
            if v is not None and (length := np.linalg.norm(v)) > 0:
                sums[lang] = sums.get(lang, 0) + v / length
    yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "total"])


def train(docs: DataFrame, per_language: int = TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from rows with doc_id, text and lang that aren't held out.

    Of each language all texts, or about per_language of them chosen by a hash of the id, are summed in tasks; the
    driver gets a few sums for each language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    if counts.count() <= SENT_LANGUAGES:
        counts = F.broadcast(counts)
    share = F.pmod(mixed("doc_id", 23), F.lit(1_000_000)) / 1_000_000.0
    taken = known.join(counts, "lang").filter(share * F.col("_n") < per_language).select("lang", "text").repartition(16)
    sums: dict[str, np.ndarray] = {}
    for row in taken.mapInArrow(_sums, "lang string, total array<double>").collect():
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.array(row["total"])
    names = sorted(sums)
    prototypes = np.array([sums[n] / max(np.linalg.norm(sums[n]), 1e-300) for n in names]).reshape(len(names), DIMENSIONS)
    return names, prototypes


def _predict(names: list[str], prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text").to_pylist():
                v = profiles.vector(text) if text and names else None
                length = np.linalg.norm(v) if v is not None else 0.0
                if length == 0.0:
                    pred.append(names[0] if v is not None else UNKNOWN)
                    score.append(0.0)
                else:
                    near = prototypes @ (v / length)
                    best = int(np.argmax(near))
                    pred.append(names[best])
                    score.append(float(min(1.0, max(0.0, near[best]))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_language: int = TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) for every row of docs.

    A null text, or one without letters, is 'und' with score 0, and so is every row if no language could be learned.
    Equal cosines go to the language that sorts first. A null doc_id isn't held out and isn't learned from. Repeated
    rows are predicted alike. An empty table gives none. Columns other than doc_id, text and lang are not read.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    names, prototypes = train(docs, per_language)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(_predict(names, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))
