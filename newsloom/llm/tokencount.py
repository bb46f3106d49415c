"""Token counts of a unigram vocabulary without making tokens: Viterbi over the matches of an Aho-Corasick automaton.

The text is cut as the tokenizer's pre-tokenizer does: spaces become a mark that begins a word, and the text begins with
one. In a word the automaton lists every vocabulary piece that ends at each place; the best sum of scores to each place
and the number of pieces on its way are carried along, nothing else. A later start wins only with a strictly better sum;
a character that no one-character piece covers costs the lowest score less 10, and a run of such characters is one piece,
or one for each of its bytes if the vocabulary has byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table
from newsloom.session import tune

MARK, PENALTY = "▁", 10.0
#: Words remembered by a task, and characters of a word that is still remembered.
REMEMBERED, WORD = 400_000, 48


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, read as a unigram vocabulary in the order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Pieces of texts under one vocabulary; counts of words are remembered up to a bound."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.known = bool(pieces)
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.automaton for b in range(256)) if pieces else False
        self.seen: dict[str, int] = {}

    def _viterbi(self, word: str) -> int:
        n = len(word)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        run = [0] * (n + 1)  # bytes of the run of unknown characters that ends here, 0 if none does
        # Matches come by their end, the longest and so the earliest start first; an end is settled when the next begins.
        at, best, start, single = 0, None, 0, True
        for end, (length, value) in self.automaton.iter(word) if self.known else ():
            end += 1
            if end != at:
                if single:
                    score[at], pieces[at] = best or 0.0, pieces[start] + 1 if at else 0
                else:
                    self._settle(word, at, best, start, score, pieces, run)
                for skipped in range(at + 1, end):
                    self._settle(word, skipped, None, 0, score, pieces, run)
                at, best, single = end, None, False
            total = score[end - length] + value
            if best is None or total > best:
                best, start = total, end - length
            if length == 1:
                single = True
        if at:
            if single:
                score[at], pieces[at] = best, pieces[start] + 1
            else:
                self._settle(word, at, best, start, score, pieces, run)
        for skipped in range(at + 1, n + 1):
            self._settle(word, skipped, None, 0, score, pieces, run)
        return pieces[n]

    def _settle(self, word: str, end: int, best: float | None, start: int, score: list, pieces: list, run: list) -> None:
        """An end whose last character is no piece by itself: that character may be unknown."""
        total = score[end - 1] + self.unknown
        if best is None or total > best:
            width = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score[end], run[end] = total, run[end - 1] + width
            pieces[end] = pieces[end - 1] + (width if self.bytes else 0 if run[end - 1] else 1)
        else:
            score[end], pieces[end] = best, pieces[start] + 1

    def word(self, word: str) -> int:
        count = self.seen.get(word)
        if count is None:
            count = self._viterbi(word)
            if len(word) <= WORD:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        head, *rest = text.replace(MARK, " ").split(" ")
        total = self.word(MARK + head) if head else 0
        for w in rest:
            total += self.word(MARK + w)
        return total


_held: dict[str | None, Counter] = {}


def counter(path: str | None = None) -> Counter:
    if path not in _held:
        _held[path] = Counter(vocabulary(path))
    return _held[path]


def _count(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            counts = [c.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row of docs.

    A null or empty text has no tokens. Long words without spaces are counted as any other. Repeated rows count alike,
    a null doc_id stays null. An empty table gives none. Columns other than doc_id and text are not read. path names the
    vocabulary.
    """
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(path), "doc_id long, n_tokens long")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))
