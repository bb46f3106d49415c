"""Packing, mixing, licenses, token counts, languages, toxicity and search: round trips, brute force and edge cases."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import public_tokenizers
from newsloom.llm import bytepair, common, covertree, language, licenses, mixing, packing, tokencount, toxicity

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two  spaces  ", "a \n b", "tab\t\tnew\n\n line ", "日本語 テキスト", "x  y z", "😀😀 a😀", "<|endoftext|> b<|endoftext|>", "don't we'll I'M", "long" * 5000, "a   b \n  c", "\n \n", "1 22 333 4.5"]


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, ids string, score string")


def doc(i, text, lang=None, source=None):
    return (i, text, lang, source, 1, "clash", "clash")


def test_byte_pair_ids_are_the_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = bytepair.BytePair()
    for text in ODD[1:]:
        assert np.frombuffer(e.encode(text), dtype=e.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_cut_between_words(monkeypatch):
    e = bytepair.BytePair()
    text = " ".join(t for t in ODD if t)
    whole = e.encode(text)
    for part in (1, 7, 100):
        monkeypatch.setattr(bytepair, "PART", part)
        assert e.encode(text) == whole


def check_packing(texts, rows, window=1024):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in texts:
        want[(i, tuple(t.encode(text or "", add_special_tokens=False).ids + [0]))] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, n in Counter(i for i, _ in texts).items():
        if n == 1:
            own = sorted(pieces[i], key=lambda r: r.start)
            ids = tuple(x for r in own for x in struct.unpack(f"<{r.length}I", r.ids))
            assert want[(i, ids)] == 1 and [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert all(r.doc_tokens == len(ids) for r in own)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= window
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_packing_round_trip(spark):
    table = common.table(spark, FOLDER, "documents")
    fills = check_packing([(r.doc_id, r.text) for r in table.collect()], packing.pack(table, shard_tokens=1 << 16).collect())
    assert sum(1024 - f for f in fills) < 0.02 * sum(fills)
    assert sum(f < 1024 for f in fills) <= sum(fills) // (1 << 16) + 1


def test_packing_edge_cases(spark):
    rows = [doc(k, t) for k, t in enumerate(ODD)] + [doc(None, "no id"), doc(3, "again"), doc(3, "again")]
    out = packing.pack(docs_frame(spark, rows)).collect()
    check_packing([(r[0], r[1]) for r in rows], out)
    assert sum(r.length for r in out if r.doc_id == 0) == 1
    assert packing.pack(docs_frame(spark, [])).count() == 0


def test_packing_takes_lexical_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * k, 1000 * k + 60, (6, 30)) for k in range(1, 5)]
    docs = [row.astype("<u2") for topic in topics for row in topic]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=6000)
    pieces = packing.pack_shard(docs, np.log1p((len(docs) - held + 0.5) / (held + 0.5)), 30.0, window=90)
    by = defaultdict(set)
    for d, _, _, sequence, _ in pieces:
        by[sequence].add(d // 6)
    assert all(len(t) == 1 for t in by.values()) and len(by) == 8


def test_packing_goes_on_to_the_last_neighbour():
    """A seed of 30 terms finds 40 short rests that share one term each before an unrelated rest is taken."""
    seed = np.arange(100, 200, dtype="<u2")
    alike = [np.array([100 + k, 1000 + k], dtype="<u2") for k in range(40)]
    other = [np.array([3000 + k], dtype="<u2") for k in range(20)]
    docs = [seed, *alike, *other]
    pieces = packing.pack_shard(docs, np.ones(4000), 3.0, window=180)
    assert {d for d, _, _, sequence, _ in pieces if sequence == 0} == set(range(41))


def test_packing_finds_neighbours_across_a_large_table(spark):
    """60 topics in random order over many shards: a topic's documents lie together far more often than a hash puts them."""
    rng = np.random.default_rng(9)
    topics = [[f"{chr(97 + t % 26)}{chr(97 + t // 26)}{w}x" for w in range(40)] for t in range(60)]
    rows = [doc(k, " ".join(rng.choice(topics[k % 60], 25))) for k in rng.permutation(1200).tolist()]
    out = packing.pack(docs_frame(spark, rows), shard_tokens=1 << 12).collect()
    shards = defaultdict(Counter)
    for r in out:
        shards[r.sequence_id >> 32][r.doc_id % 60] += 1
    together = sum(n * n for c in shards.values() for n in c.values()) / len(out)
    assert len(shards) > 10 and together > 5


def brute_targets(sizes, share=1.5, cap=2):
    """Round by round: sources above their cap stop there and the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        w = sum(weight[n] for n in open_)
        target = {n: cap * sizes[n] if n in full else rest * weight[n] / w for n in names}
        more = {n for n in open_ if target[n] > cap * sizes[n] + 1e-9}
        if not more:
            return target
        full |= more


def test_targets_fill_by_weight(spark):
    rng = np.random.default_rng(2)
    for trial in range(4):
        sizes = {f"s{k}": int(rng.integers(0, 10 ** int(rng.integers(1, 5)))) for k in range(trial * 4 + 1)} | {None: 50, "Z": 40, "é": 3}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = brute_targets(sizes)
        assert found == pytest.approx(want)


def test_mix_repeats_documents_by_rate(spark):
    rng = np.random.default_rng(4)
    rows = [doc(k, "word " * int(rng.integers(1, 40)), None, ("a", "b", "c", "big")[min(3, k % 9)]) for k in range(3000)] + [doc(None, None, None, None), doc(7000, "", None, None)]
    frame = docs_frame(spark, rows)
    plan = mixing.mix_plan(frame).collect()
    per = defaultdict(lambda: [0, 0.0])
    for r in plan:
        assert 0 <= r.copies <= 2
        per[r.source][0] += r.copies * r.size
        per[r.source][1] = r.target
    for source, (taken, target) in per.items():
        assert taken == pytest.approx(target, rel=0.06), source
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r.copies for r in plan)
    assert {r.size for r in mixed.select("size").distinct().collect()} == {1}
    assert sorted(map(str, mixing.mix_plan(frame).collect())) == sorted(map(str, plan))
    assert mixing.mix(docs_frame(spark, [])).count() == 0


def brute_align(text, notice):
    """Length of the longest common subsequence."""
    row = [0] * (len(notice) + 1)
    for w in text:
        new = [0]
        for j, v in enumerate(notice):
            new.append(row[j] + 1 if v == w else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_in_order_and_whole_for_edits():
    notice = licenses.words_of(licenses.NOTICES["MIT"])
    rng = np.random.default_rng(6)
    for _ in range(30):
        text = [w for w in notice if rng.random() > 0.08]
        text.insert(int(rng.integers(0, len(text))), "extra")
        pairs = licenses.align(text, notice)
        assert all(text[a] == notice[b] for a, b in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs[:-1], pairs[1:]))
        assert len(pairs) >= 0.9 * brute_align(text, notice)


def test_notices_are_found_in_whole_texts(spark):
    filler = "the work is under a general version of this and that " * 400
    rows = [doc(k, f"{filler}\n{text}\n{filler}") for k, text in enumerate(licenses.NOTICES.values())]
    rows += [doc(90, filler), doc(91, None), doc(92, ""), doc(93, "Licensed under CC BY-NC 4.0. Words. LICENSED UNDER CC BY-NC 4.0."), doc(None, "nothing")]
    found = {r.doc_id: r.found for r in licenses.scan_licenses(docs_frame(spark, rows)).collect()}
    for k, name in enumerate(licenses.NOTICES):
        assert [f.license for f in found[k]] == [name]
        assert rows[k][1].encode()[found[k][0].start : found[k][0].end].decode().startswith(licenses.NOTICES[name][:8])
    assert not found[90] and not found[91] and not found[92] and not found[None] and len(found[93]) == 2
    assert licenses.scan_licenses(docs_frame(spark, [])).count() == 0


def test_license_lines_of_the_table_are_all_found(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = {r.doc_id: {f.license for f in r.found} for r in licenses.scan_licenses(table).collect()}
    lines = {n: licenses.NOTICES[n] for n in ("Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    for r in table.collect():
        assert {n for n, line in lines.items() if line in r.text} <= found[r.doc_id]


def test_every_license_line_of_the_table_is_found(spark):
    """Whole lines or sentences that say under what license a text stands, whatever they name."""
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = {r.doc_id: {f.license for f in r.found} for r in licenses.scan_licenses(table).collect()}
    stated = {r.doc_id: re.findall(r"(?i)(?:licensed|released) under[^\n]*", r.text or "") for r in table.collect()}
    assert all(found[i] for i, lines in stated.items() if lines)
    mit = {i for i, lines in stated.items() if any("Released under the MIT License." in x for x in lines)}
    assert len(mit) == 10 and all("MIT-line" in found[i] for i in mit)


def test_lines_of_one_license_are_not_anothers(spark):
    lines = ["Licensed under the MIT license", "Released under the Foo License.", "Licensed under CC BY-ND 4.0.", "Licensed under the GPL, version 2.", "This project is licensed under the terms of the MIT License"]
    found = {r.doc_id: [f.license for f in r.found] for r in licenses.scan_licenses(docs_frame(spark, [doc(k, t) for k, t in enumerate(lines)])).collect()}
    assert found == {0: ["MIT-line"], 1: [], 2: ["CC-BY-ND-4.0"], 3: [], 4: ["MIT-terms"]}


@pytest.mark.parametrize("bytes_too", [True, False])
def test_token_counts_are_the_unigram_tokenizers(spark, bytes_too):
    pieces = [p for p in tokencount.vocabulary() if bytes_too or not p[0].startswith("<0x")]
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=bytes_too))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokencount.Counter(pieces)
    texts = [t for t in ODD if t] + ["▁x ▁", "<0x0A> <unk>", "aaaaaaaaaa"] + [r.text for r in common.table(spark, FOLDER, "documents").limit(60).collect()]
    assert [counter.count(t) for t in texts] == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_count_ties_keep_the_earlier_start():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0)]
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokencount.Counter(pieces)
    for text in ("a", "aa", "aaa", "aaaa aaa", "aZa", "ZZ", "aZZZa a"):
        assert counter.count(text) == len(reference.encode(text, add_special_tokens=False).ids)


def test_token_counts_edge_cases(spark):
    rows = [doc(None, "no id"), doc(1, None), doc(2, ""), doc(3, "same"), doc(3, "same")]
    found = sorted(((r.doc_id or 0, r.n_tokens > 0) for r in tokencount.token_counts(docs_frame(spark, rows)).collect()))
    assert found == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert tokencount.token_counts(docs_frame(spark, [])).count() == 0


def test_language_of_held_out_texts(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 150
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    english, german = "the quick brown fox and the lazy dog", "der schnelle braune fuchs und der faule hund"
    rows = [doc(k, (english, german)[k % 2], ("en", "de")[k % 2]) for k in range(40)]
    rows += [doc(100, None, "en"), doc(101, "", "en"), doc(102, "123 !?", "de"), doc(103, "the dog", None), doc(None, "der hund", "en"), doc(104, "日本", None), doc(105, "der hund " * 20000, None)]
    found = {r.doc_id: r for r in language.identify(docs_frame(spark, rows)).collect()}
    assert [found[k].lang_pred for k in (100, 101, 102, 103, None, 105)] == ["und", "und", "und", "en", "de", "de"]
    assert found[104].lang_pred in ("de", "en") and found[100].score == 0 and not found[None].held_out
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items() if i is not None)
    assert {r.lang_pred for r in language.identify(docs_frame(spark, [doc(1, "text")])).collect()} == {"und"}
    assert language.identify(docs_frame(spark, [])).count() == 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in bad) > 0.8 * len(bad) and sum(r.predicted for r in good) < 0.03 * len(good)


def test_toxic_sentences_are_located(spark):
    rng = np.random.default_rng(8)
    plain = lambda: " ".join(f"word{'abcdefgh'[int(k)]}" for k in rng.integers(0, 8, 12)) + "."
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        parts = [plain(), "You vile creature, begone!" if bad else plain(), plain()]
        rows.append(doc(k, " ".join(parts)))
        labels.append((k, 1 if bad else 0, 1 if bad else 0))
    labels += [(0, 1, None), (None, 1, 1), (5, 0, 7), (4, 1, 0)]
    frame, marks = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    extra = [doc(1000, None), doc(1001, ""), doc(1002, "?!"), doc(None, "You vile creature, begone!")]
    found = {r.doc_id: r for r in toxicity.score_documents(frame.unionByName(docs_frame(spark, extra)), model).collect()}
    for k in range(400):
        assert found[k].predicted == (k % 4 == 0)
        spans = [rows[k][1][s.start : s.end] for s in found[k].offending]
        assert all("vile" in s for s in spans) and bool(spans) == (k % 4 == 0)
    assert [found[k].score for k in (1000, 1001, 1002)] == [0, 0, 0] and found[None].predicted == 1 and not found[None].held_out
    left = toxicity.without_toxic(frame, marks)
    assert left.columns == frame.columns and left.count() == 300
    assert toxicity.score_documents(docs_frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    frame, none = docs_frame(spark, [doc(1, "some text")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(frame, toxicity.train(frame, none)).first().predicted == 0


def brute_products(rows, k):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = min(whole.get(i, v), v)
    whole = {i: np.floor(np.array(v) * 64).astype(np.int64) for i, v in whole.items()}
    return {q: sorted(((-int(a @ b), j) for j, b in whole.items() if j != q))[:k] for q, a in whole.items() if q % 20 == 0}


def test_products_match_brute_force(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(9, 8))
    rows = [(k, (centres[k % 9] + rng.normal(size=8) * 0.2).tolist()) for k in range(5000)]
    rows += [(5000 + k, rows[0][1]) for k in range(300)]
    found = defaultdict(list)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    for r in covertree.top_products(frame, F.col("vec_id") % 20 == 0, 20).collect():
        found[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = brute_products(rows, 20)
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in found.items()} == want
    assert all([x[0] for x in sorted(v)] == list(range(1, 21)) for v in found.values())


def test_products_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 5.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (20, [0.0, 0.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, whole int")
    found = sorted(tuple(r) for r in covertree.top_products(frame, F.col("vec_id") % 20 == 0, 2).collect())
    assert found == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert covertree.top_products(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_leaves_cover_their_rows():
    rng = np.random.default_rng(10)
    rows = np.concatenate([rng.normal(size=(300, 3)) * 0.01 + c for c in rng.normal(size=(8, 3)) * 10])
    found = covertree.leaves(rows, 32)
    assert sorted(np.concatenate([f[0] for f in found]).tolist()) == list(range(len(rows))) and len(found) >= 8
    assert all(np.sqrt(((rows[m] - c) ** 2).sum(axis=1)).max() <= r + 1e-9 for m, c, r in found)


def test_products_take_every_row(spark):
    """Rows that share a vec_id, vectors of several lengths, and scores that doubles don't hold."""
    rng = np.random.default_rng(12)
    rows = [(k % 300, rng.integers(-3, 4, size=2 + k % 3).astype(float).tolist()) for k in range(1200)]
    rows += [(1000, [float(2**24 + 1), 1.0, 1.0, 1.0, 1.0])] + [(1001 + k, [float(2**24 + k), float(k), 0.0, 1.0, 0.0]) for k in range(40)] + [(20, [7.0] * 9)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, whole int")
    found = defaultdict(list)
    for r in covertree.top_products(frame, F.col("vec_id") % 20 == 0, 7).collect():
        found[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = defaultdict(set)
    for i, v in rows:
        for j, w in rows:
            if i % 20 == 0 and i != j and len(v) == len(w):
                want[i].add((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), j))
    assert {q: [x[1:] for x in sorted(v)] for q, v in found.items()} == {q: sorted(v)[:7] for q, v in want.items()}


def test_plan_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "a b", "s", 5, "x", "y")], "doc_id long, text string, source string, _source int, _row string, weight string")
    row = mixing.mix_plan(frame).first()
    assert row.asDict() == {"doc_id": 1, "text": "a b", "source": "s", "_source": 5, "_row": "x", "weight": "y", "size": 2, "source_size": 2, "target": row.target, "copies": row.copies}


def test_toxicity_fit_is_bounded_where_one_id_repeats(spark, monkeypatch):
    words = "sun rain wind snow hail fog".split()
    rows = [doc(k, f"you {'vile scum' if k % 2 else 'good friend'} {words[k % 6]} {words[k % 5]}.") for k in range(0, 400)]
    rows += [doc(1, f"vile scum {k} {words[k % 6]}.") for k in range(3000)] + [doc(1, "the same vile text.")] * 500 + [doc(3, "vile scum " * 60000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda names, at, sentence, owner, label, weight: seen.append(label) or fit(names, at, sentence, owner, label, weight))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 500_000)
    model = toxicity.train(docs_frame(spark, rows), labels, most=300)
    assert len(seen[0]) < 1200
    told = {r.doc_id: r.predicted for r in toxicity.score_documents(docs_frame(spark, rows[:400]), model).collect()}
    assert sum(told[k] == k % 2 for k in told) >= 390
