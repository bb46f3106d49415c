"""The filter audit and vector codes against brute force, the quality classifier by held-out labels, and edge cases."""

import os
import re
import zlib
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.llm import compression, filteraudit, vectorcodes

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, shard long, words int, failed string"
LABELS = "doc_id long, quality int, toxic int, part string"
VECTORS = "vec_id long, embedding array<float>, label int, code long, width string"


def fails(text, doc_id, texts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if any(t == text and doc_id is not None and i is not None and i < doc_id for i, t in texts) else "")


def brute_audit(docs, labels):
    texts = [(d[0], d[1] or "") for d in docs]
    rows = [(d[2] or "", set(fails(d[1] or "", d[0], texts)), d[0]) for d in docs]
    good = {r[0] for r in labels if r[1] == 1}
    toxic = {r[0] for r in labels if r[2] == 1}
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                all_fail = [r for r in mine if letter in r[1]]
                total[letter] += len(gone)
                lost = [sum(r[2] is not None and r[2] in s for r in gone) for s in (good, toxic)]
                steps.append((part, "".join(order), step, len(left), len(gone), len(all_fail) - len(gone), sum(r[1] == {letter} for r in mine), *lost, letter))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_equals_brute_force_on_every_kind_of_row(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "é", "ß|", "#x", "plain", *[f"w{k}" for k in range(200)]]
    docs = []
    for i in range(60):
        n = int(rng.choice([0, 3, 49, 50, 51, 90]))
        docs.append((i, " ".join(rng.choice(vocabulary[: int(rng.choice([5, 30, 207]))], n)), ["s", None, "", "t"][i % 4], 1, 1, "x"))
    docs += [(100 + k, docs[k][1], "s", 1, 1, "x") for k in range(20)]
    docs += [(3, docs[3][1], "t", 1, 1, "x"), (3, "other text", "t", 1, 1, "x"), (None, docs[5][1], "s", 1, 1, "x"), (500, None, None, 1, 1, "x"), (501, "", "t", 1, 1, "x")]
    docs += [(600, "long\t\x0bword " * 30000 + "É" * 70000, "s", 1, 1, "x")]
    labels = [(k, [1, 0, None][k % 3], [0, 1, None, 7][k % 4], "clash") for k in range(0, 110, 2)] + [(4, 1, 1, "again"), (None, 1, 1, "n")]
    got = filteraudit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), size=5000).collect()
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.audit(none, labels).collect() == []
    one = filteraudit.audit(spark.createDataFrame([(1, None, None, 1, 1, "x")], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.good_lost == r.toxic_lost == 0 for r in one)
    assert {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_matrix_over_the_global_dictionary(spark):
    texts = ["b a b", None, "", "a c  a\na", "C c"] * 40
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    terms, shards = filteraudit.document_terms(docs.repartition(5), size=40)
    codes = {r["word"]: r["code"] for r in filteraudit.dictionary(shards).collect()}
    assert set(codes) == {"a", "b", "c", "C"} and len(set(codes.values())) == 4
    seen = 0
    for row in terms.collect():
        starts, columns, counts = (np.frombuffer(row[c], dtype=t) for c, t in (("starts", np.int64), ("columns", np.int64), ("counts", np.int32)))
        for k, d in enumerate(row["docs"]):
            found = dict(zip(columns[starts[k] : starts[k + 1]].tolist(), counts[starts[k] : starts[k + 1]].tolist(), strict=True))
            words = (texts[d["doc_id"]] or "").split()
            assert found == {codes[w]: words.count(w) for w in set(words)}
            seen += 1
    assert seen == len(texts)


def brute_codes(rows, rounds=6):
    """code, error and digest by comparing every part with every entry; rows of one length that 8 divides."""
    whole = [(i, np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 4096).astype(int)) for i, v in rows]
    width = len(whole[0][1]) // 8
    parts = np.array([[v[p * width : (p + 1) * width] for p in range(8)] for _, v in whole])
    least = {}
    for (i, v), q in zip(whole, parts, strict=True):
        if i not in least or tuple(v) < least[i][0]:
            least[i] = (tuple(v), q)
    books = np.array([least[i][1] for i in sorted(least)[:16]]).transpose(1, 0, 2)

    def pick(p):
        return [min(range(books.shape[1]), key=lambda e: (int(((q[p] - books[p][e]) ** 2).sum()), e)) for q in parts]

    for _ in range(rounds):
        for p, picks in enumerate([pick(p) for p in range(8)]):
            for e in set(picks):
                mine = [parts[k][p] for k in range(len(parts)) if picks[k] == e]
                books[p][e] = [int(sum(int(m[c]) for m in mine)) // len(mine) for c in range(width)]
    picks = [pick(p) for p in range(8)]
    codes = ["".join(f"{picks[p][k]:02x}" for p in range(8)) for k in range(len(parts))]
    errors = [sum(int(((parts[k][p] - books[p][picks[p][k]]) ** 2).sum()) for p in range(8)) for k in range(len(parts))]
    return codes, errors, sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["random", "grid", "few"])
def test_codes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "random":
        rows = [(int(i), rng.normal(size=16).tolist()) for i in rng.permutation(300) - 20]
    elif kind == "grid":  # many ties and equal parts
        rows = [(i // 2, (rng.integers(0, 2, 24) / 4096).tolist()) for i in range(200)] + [(7, [0.0] * 24)] * 40
    else:
        rows = [(i, rng.normal(size=8).tolist()) for i in range(5)]
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], VECTORS)
    coded, books = vectorcodes.product_codes(df.repartition(3))
    codes, errors, digest = brute_codes(rows)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == sorted(zip([i for i, _ in rows], codes, errors, strict=True))
    assert {w: vectorcodes.book_digest(b) for w, b in books.items()} == {len(rows[0][1]): digest}


def test_subtrees_go_whole_and_only_when_sure():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(3000, 4)) * 100 + rng.integers(0, 6, (3000, 1)) * 3000).astype(np.int64)  # six groups far apart
    order, nodes = vectorcodes.cover_tree(points)
    assert sorted(order.tolist()) == list(range(3000))
    mine = points[order]
    for centre, start, end, child, last, radius in nodes.tolist():
        gap = np.sqrt(((mine[int(start) : int(end)] - mine[int(centre)]) ** 2).sum(axis=1))
        assert gap.max() <= radius
        inner = nodes[int(child) : int(last)]
        assert not child or (inner[0, 1] == start and inner[-1, 2] == end and all(inner[1:, 1] == inner[:-1, 2]))
    book = np.arange(0, 18001, 3000)[:6, None] + np.zeros((6, 4), dtype=np.int64)
    whole, places, picks = vectorcodes.assign(mine, nodes, book)
    got = np.full(3000, -1)
    got[places] = picks
    for starts, ends, entries in whole:
        for s, e, x in zip(starts, ends, entries, strict=True):
            assert (got[s:e] == -1).all()
            got[s:e] = x
    assert (got == vectorcodes.squares(mine, book).argmin(axis=1)).all()
    assert len(places) < 300


def test_codes_of_odd_rows(spark, tmp_path):
    rows = [(1, [0.5] * 8, None), (2, None, 1), (3, [float("nan")] * 8, 1), (4, [0.1, None] * 4, 1), (5, [float("inf")] + [0.0] * 7, 1), (None, [0.25] * 8, None)]
    rows += [(6, [1.0, 2.0, 3.0], 2), (7, [-1.0, 2.0, 3.0], 2), (8, [], 3), (9, [1e30] * 8, 3), (1, [0.5] * 8, 4), (10, [-0.0001] * 8, 4)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vectorcodes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(["1", "None", "6", "7", "8", "9", "1", "10"])
    by = {r.vec_id: r for r in out}
    assert by[6].codebooks_sha256 == by[7].codebooks_sha256 != by[1].codebooks_sha256 and by[8].error == 0
    assert all(r.error == 0 for r in out) and {r.label_error for r in out} == {0}
    none = spark.createDataFrame([], VECTORS)
    none.write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vectorcodes.op12_vector_codes(spark, f"{tmp_path}/none").collect() == []


def test_label_errors_are_summed_nulls_together(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), [None, 1, 2][i % 3], 1, "x") for i in range(90)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vectorcodes.op12_vector_codes(spark, str(tmp_path)).collect()
    for kind in range(3):
        mine = [r for r in out if r.vec_id % 3 == kind]
        assert {r.label_error for r in mine} == {sum(r.error for r in mine)}


def test_quality_of_held_out_documents(spark):
    out = {r.doc_id: r for r in entry.queries()["op13_quality"](spark, "/root/testdata/sf0.1").collect()}
    known = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.1/labels.parquet'").fetchall()
    assert len(out) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(out[i].predicted, q) for i, q in known if out[i].held_out]
    bad, good = [p for p, q in held if q == 0], [p for p, q in held if q == 1]
    assert len(bad) > 100 and sum(p == 0 for p in bad) >= 0.88 * len(bad) and sum(p == 1 for p in good) >= 0.99 * len(good)


def test_quality_learns_from_labels_outside_the_held_out_rows_only(spark):
    texts = [("good words of calm prose about things " if k % 2 else "$$$ ### &&& junk||| ") * (3 + k % 5) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    right = spark.createDataFrame([(k, k % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    wrong = spark.createDataFrame([(k, (k % 2) ^ (k in held), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    first, second = ({r.doc_id: (r.score, r.predicted) for r in compression.score_documents(docs, compression.train(docs, x)).collect()} for x in (right, wrong))
    assert first == second and all(p == k % 2 for k, (_, p) in first.items())


def test_quality_without_texts_or_labels(spark):
    schema = "doc_id long, text string, quality int, score double, gap string"
    rows = [(1, None, 0, 0.5, "x"), (2, "", 0, 0.5, "x"), (None, "some text", 0, 0.5, "x"), (3, "a" * 3_000_000, 0, 0.5, "x"), (1, None, 0, 0.5, "x"), (4, "\n", 0, 0.5, "x")]
    docs = spark.createDataFrame(rows, schema)
    labels = "doc_id long, quality int, toxic int"
    for given, score in (([], 0.5), ([(k, 1, 0) for k in range(98)], None), ([(None, 1, 0), (5, None, 0), (6, 9, 1)], 0.5)):
        model = compression.train(docs, spark.createDataFrame(given, labels))
        out = compression.score_documents(docs, model).collect()
        assert len(out) == 6 and len({r.score for r in out}) == 1 and (score is None or out[0].score == score)
    # Labelled rows of either kind, but without any text to learn from.
    model = compression.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (77, 0, 0)], labels))
    assert len(compression.score_documents(docs, model).collect()) == 6
    assert compression.score_documents(docs.filter(F.lit(False)), model).collect() == []


def test_pieces_cover_whole_texts():
    text = memoryview(os.urandom(5000))
    assert b"".join(compression.pieces(text)) == bytes(text) and max(map(len, compression.pieces(text))) == compression.PIECE
    assert pa.array(["é"])[0].as_py() == "é"
