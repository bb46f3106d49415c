"""The stages of the pipeline, each against brute force on its own input, and the whole on odd and empty tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from newsloom.llm import mixing

from test_dedup import brute_components
from test_texts import brute_targets, check_packing

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
FOOTER = "All rights of this page stay with the valley press office."


def fixture():
    rng = np.random.default_rng(12)
    words = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran lis tok mer pud".split()]
    text = lambda n: " ".join(words[int(k)] for k in rng.integers(0, len(words), n))
    rows, labels = [], []
    for k in range(360):
        parts = [text(25) + "." for _ in range(4)]
        bad = k % 6 == 1
        if bad:
            parts[2] = "Go away, you wretched snake."
        if k % 5 == 0:
            parts.append(FOOTER)
        rows.append([k, "\n".join(parts), "en", f"s{k % 4}" if k % 3 else "hot", 1])
        labels.append((k, 1, int(bad)))
    copy = rows[2][1].replace("\n", " ")
    rows += [[400, copy, "en", "s1", 1], [401, copy + " end", "en", "s2", 1], [402, copy, "en", "s2", 1]]
    rows += [[500, None, None, None, None], [501, "", "en", "s1", 0], [502, "word", None, None, 4], [None, text(40), "en", None, 1], [503, text(6000), "en", "s3", 1], [503, text(30), "en", "s3", 1]]
    return [tuple(r) for r in rows], labels


def write(folder, rows, labels):
    columns = lambda values, schema: pa.Table.from_arrays([pa.array([v[k] for v in values], f.type) for k, f in enumerate(schema)], schema=schema)
    pq.write_table(columns(rows, SCHEMA), f"{folder}/documents.parquet")
    pq.write_table(columns(labels, LABELS), f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    folder = write(tmp_path_factory.mktemp("corpus"), *fixture())
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, folder).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((docs.collect(), done.collect(), done.columns))
        docs = done
    return out


def test_stages_are_the_named_ones_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "mix_sources", "packing"]
    assert all(columns == SCHEMA.names for _, _, columns in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after, _ = stages[0]
    bad = [r for r in before if r.text and "wretched" in r.text]
    left = Counter(after)
    assert not any(r in left for r in bad) and left == Counter(before) - Counter(bad)


def test_recurring_lines_stay_once(stages):
    before, after, _ = stages[1]
    holders = sorted(r.doc_id for r in before if FOOTER in (r.text or ""))
    assert len(holders) > 4 and [r.doc_id for r in after if FOOTER in (r.text or "")] == holders[:1]
    other = lambda rows: sorted((str(r.doc_id), (r.text or "").replace("\n" + FOOTER, "")) for r in rows)
    assert other(before) == other(after)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages[2]
    texts = {r.doc_id: r.text for r in before if r.doc_id not in (None, 503)}
    _, label = brute_components(texts, 5, 80)
    kept = {i for i, c in label.items() if i == c}
    assert {r.doc_id for r in after} == kept | {None, 503} and 2 in kept and not kept & {400, 401, 402}
    assert len(after) == len(before) - (len(texts) - len(kept))


def test_sources_come_near_their_targets(stages):
    before, after, _ = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += size(r.text)
    for r in after:
        taken[r.source] += size(r.text)
    target = brute_targets(sizes)
    longest = max(size(r.text) for r in before)
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] + longest for s in sizes)
    assert all(n <= 2 * Counter(before)[r] for r, n in Counter(after).items())


def test_packed_pieces_give_the_texts_back(stages):
    before, after, _ = stages[4]
    fills = check_packing([(r.doc_id, r.text) for r in before], after)
    assert sum(r.length for r in after) == sum(fills) and sum(1024 - f for f in fills) < 1024


def test_run_is_the_stages_in_turn(spark, stages, tmp_path):
    rows = corpus_pipeline.run(spark, write(tmp_path, *fixture())).collect()
    assert sorted(map(str, rows)) == sorted(map(str, stages[4][1]))


def test_empty_tables_go_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, [], [])).count() == 0


def test_plan_and_mix_agree(spark):
    docs = spark.createDataFrame(fixture()[0], "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix_plan(docs).collect()
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
