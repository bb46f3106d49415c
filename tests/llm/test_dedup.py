"""Near duplicates, line templates and embeddings against brute force, and their edge cases."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.llm import common, components, linededup, neardup, vectordup, words

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(texts, size, percent):
    """Smallest id reachable by links, by comparing every two documents."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return sets, label


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, id long").withColumn("n_lines", F.lit(-5))


def doc(i, text):
    return (i, text, None, None, None, "clash", 7)


def test_shingles_are_sets_of_whole_texts():
    texts = ["a b c d", "A  b\tc\nd", None, "", "one two", "one", "x y z x y z", "é ü " * 3]
    values, where = words.shingles(pa.array(texts), 3)
    sets = [set(values[a:b].tolist()) for a, b in zip(where[:-1], where[1:])]
    assert [len(s) for s in sets] == [len(shingle_set(t, 3)) for t in texts]
    assert sets[0] == sets[1] and not sets[0] & sets[4]


def test_words_longer_than_a_piece_and_text_borders():
    long = "w" * (words._PIECE + 5)
    values, where = words.shingles(pa.array([long, "w" * (words._PIECE + 6), long + " a", "ab", "c"]), 1)
    sets = [set(values[a:b].tolist()) for a, b in zip(where[:-1], where[1:])]
    assert sets[0] != sets[1] and len(sets[2]) == 2 and sets[0] < sets[2] and len(sets[3]) == len(sets[4]) == 1


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, size, percent):
    table = common.table(spark, FOLDER, "documents")
    sets, label = brute_components({r.doc_id: r.text for r in table.collect()}, size, percent)
    rows = neardup.near_duplicates(table, size, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == label
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_and_large_groups_lose_no_link(spark):
    """A drifting chain of edits links only neighbours; blocks of four rows force every path."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts, current = {}, list(base)
    for i in range(40):
        texts[i] = " ".join(current)
        current = list(current)
        current[int(rng.integers(0, 120))] = f"edit{i}"
    for i in range(40, 60):
        texts[i] = " ".join(base)
    texts[60] = " ".join(f"other{k}" for k in range(50))
    _, label = brute_components(texts, 3, 85)
    found = neardup.near_duplicates(docs_frame(spark, [doc(i, t) for i, t in texts.items()]), 3, 85, block=4).collect()
    assert {r.doc_id: r.component_id for r in found} == label


def test_near_duplicates_edge_cases(spark):
    same = "the same few words in a row"
    rows = [doc(5, same), doc(3, same), doc(3, same), doc(9, None), doc(8, ""), doc(7, " \n"), doc(None, same), doc(10, "short"), doc(11, "Short"), doc(12, "word " * 30000)]
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_frame(spark, rows), 3, 85).collect()}
    assert found == {(5, 5, 3, False), (3, 5, 3, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (None, 5, None, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True)}
    kept = neardup.one_of_each(docs_frame(spark, rows), 3, 85)
    assert kept.columns == docs_frame(spark, rows).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3, 7, 8, 9, 10, 12]
    assert neardup.near_duplicates(docs_frame(spark, []), 3, 85).count() == 0


def test_rows_of_one_id_share_links(spark):
    a, b = "alpha beta gamma delta", "one two three four five"
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_frame(spark, [doc(4, a), doc(4, b), doc(2, a), doc(6, b)]), 3, 85).collect()}
    assert found == {2: 2, 4: 2, 6: 2}


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.root, set()).add(r.id)
    assert sorted(map(min, groups.values())) == [1, 100, 200] and sorted(map(len, groups.values())) == [2, 40, 60]
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_recurring_templates_go_from_all_but_the_first(spark):
    note = "Posted by the news desk on day {} at hour {} in the city"
    own = ["", "apple pie", "river bank far", "stone", "cloud cover is low", "tiger", "piano keys"]
    rows = [doc(k, f"{own[k]} alone\n{note.format(k, 24 - k)}\n\nThe same line.") for k in range(1, 7)]
    found = {r.doc_id: r for r in linededup.dedup_lines(docs_frame(spark, rows)).collect()}
    assert found[1].n_dropped == 0 and found[1].text.endswith("The same line.")
    assert [found[k].n_dropped for k in range(2, 7)] == [2] * 5 and all(found[k].n_lines == 4 for k in found)
    assert all("Posted" not in found[k].text and found[k].text.endswith("\n") for k in range(2, 7))
    assert found[1].key == "clash" and found[1].id == 7


@pytest.mark.parametrize("count", [40, 1500])
def test_templates_of_variable_words_go_at_every_size(spark, count):
    words = [a + b for a in "abcdefghij" for b in ("lon", "ber")]
    note = "Thanks for reading our newsletter from {} by {}"
    rows = [doc(k, f"{'own' + chr(97 + k % 26) * (k // 26 + 1)}\n{note.format(words[k % 20] + 'city', words[(k + k // 20) % 20] + 'son')}") for k in range(count)]
    left = [r.doc_id for r in linededup.cleaned(docs_frame(spark, rows)).collect() if "Thanks" in r.text]
    assert left == [0]


def test_long_lines_of_two_texts_stay_once(spark):
    passage = "This passage of some length stands word for word in two texts that have nothing else in common"
    rows = [doc(1, f"one\n{passage}"), doc(2, f"{passage}\ntwo"), doc(3, "short\nthree"), doc(4, "short\nfour"), doc(5, "a whole text of more than forty bytes that is here twice"), doc(6, "a whole text of more than forty bytes that is here twice")]
    found = {r.doc_id: r.text for r in linededup.cleaned(docs_frame(spark, rows)).collect()}
    assert found == {r[0]: r[1] for r in rows} | {2: "two"}


def test_different_lines_of_one_leaf_stay(spark):
    nouns = "apple river stone cloud tiger piano".split()
    rows = [doc(k, f"It was the {n} of {m} again") for k, (n, m) in enumerate(zip(nouns, reversed(nouns)))]
    assert all(r.n_dropped == 0 for r in linededup.dedup_lines(docs_frame(spark, rows)).collect())


def test_line_dedup_edge_cases(spark):
    line = "a line that many hold"
    rows = [doc(None, line), doc(None, line), doc(1, line), doc(1, line), doc(2, line), doc(3, line), doc(4, None), doc(5, ""), doc(6, "\t \n"), doc(7, line + "\nrest " + "x " * 50000)]
    found = linededup.dedup_lines(docs_frame(spark, rows)).collect()
    told = sorted(((r.doc_id or 0, r.n_dropped, r.n_lines, None if r.text is None else r.text[:5]) for r in found), key=str)
    assert told == sorted([(0, 1, 1, ""), (0, 1, 1, ""), (1, 0, 1, "a lin"), (1, 0, 1, "a lin"), (2, 1, 1, ""), (3, 1, 1, ""), (4, 0, 0, None), (5, 0, 1, ""), (6, 0, 2, "\t \n"), (7, 1, 2, "rest ")], key=str)
    left = linededup.cleaned(docs_frame(spark, rows))
    assert left.columns == docs_frame(spark, rows).columns and sorted(r.doc_id for r in left.collect()) == [1, 1, 4, 5, 6, 7]
    assert {r.n_lines for r in left.collect()} == {-5}
    assert linededup.dedup_lines(docs_frame(spark, [])).count() == 0


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid long, n long")


def brute_vectors(rows, threshold=0.95):
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = {i: (0, i) for i, _ in rows}
    for a, (i, _) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[i] = (len(links[a]), min(good[b][0] for b in seen))
    return out


@pytest.mark.parametrize("sure", [None, 4.0])
def test_vectors_match_brute_force_in_small_blocks(spark, sure):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = [(k, (centres[k % 12] * rng.uniform(0.5, 2) + rng.normal(size=6) * rng.choice([0.05, 0.3])).tolist()) for k in range(400)]
    rows += [(400 + k, rows[0][1]) for k in range(30)]
    found = vectordup.near_vectors(vectors_frame(spark, [(i, v, 0, 1, 1) for i, v in rows]), block=16, sure=sure).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


@pytest.mark.parametrize("shape", ["few directions", "dense group"])
def test_border_pairs_of_wide_vectors_are_found(spark, shape):
    """64 columns of rank 2, and one tight group that k-means cuts into many cells."""
    rng = np.random.default_rng(8)
    if shape == "few directions":
        data = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 64))
    else:
        data = rng.normal(size=64) + 0.2 * rng.normal(size=(600, 3)) @ rng.normal(size=(3, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    found = vectordup.near_vectors(vectors_frame(spark, [(i, v, 0, 1, 1) for i, v in rows])).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_vectors(rows)


def test_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (9, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (10, [-1.0, -1.0])]
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectordup.near_vectors(vectors_frame(spark, [(i, v, 0, 1, 1) for i, v in rows])).collect())
    assert found == [(k, 0, k, True) for k in range(1, 8)] + [(8, 2, 8, True), (8, 2, 8, True), (9, 2, 8, False), (10, 0, 10, True)]
    assert vectordup.near_vectors(vectors_frame(spark, [])).count() == 0
    assert vectordup.near_vectors(vectors_frame(spark, [(1, None, 0, 1, 1)])).first().kept


def test_vectors_are_not_written_once_a_visit(spark, monkeypatch, tmp_path):
    """1,500 vectors of 64 columns each visit several cells; two groups of near copies lie over all chunks."""
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    rng = np.random.default_rng(5)
    data = rng.normal(size=(1500, 64)).astype("<f4")
    data[::10] = data[0] + 0.05 * rng.normal(size=(150, 64))
    data[1::500] = data[1]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(8)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectordup.near_vectors(frame, block=64).collect()}
    unit = data / np.linalg.norm(data.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    assert found == {k: (linked[k].sum() - 1, linked[k].argmax()) for k in range(len(data))} and linked.sum() > 20000
    written = 0
    for part in tmp_path.rglob("*.parquet"):
        held = pq.read_table(part)
        written += sum(held.num_rows if c == "vector" else sum(len(v) // 256 for v in held[c].to_pylist()) for c in ("vector", "vectors") if c in held.column_names)
    assert written == 2 * len(data) - 2


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_whole_tables_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = con.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_vectors_of_several_lengths_and_extreme_components(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 4))
    rows = [(k, (base[k % 6] * scale).tolist()) for k, scale in enumerate(np.repeat([1e-300, 1e-200, 1.0, 1e200, 1e300], 6))]
    rows += [(100 + k, v) for k, v in enumerate([[1.0, 0.0], [2.0, 1e-5], [1.0, 0.0, 0.0], [1.0, 1e-5, 0.0], [3.0], [-2.0], [5e-324, 0.0]])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectordup.near_vectors(vectors_frame(spark, [(i, v, 0, 1, 1) for i, v in rows]), block=4).collect()}
    want = {}
    for n in (1, 2, 3, 4):
        want |= brute_vectors([(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows if len(v) == n])
    assert found == want and found[100] == (2, 100) and found[102] == (1, 102)


def test_line_dedup_keeps_columns_of_any_name(spark):
    schema = "doc_id long, text string, _k int, _dropped string, _row string, line string, leaf string"
    frame = spark.createDataFrame([(k, f"{w}\nthe line of all", k, "d", "r", "l", "f") for k, w in enumerate("apple river stone cloud tiger".split())], schema)
    for found in (linededup.dedup_lines(frame), linededup.cleaned(frame)):
        rows = found.collect()
        assert found.columns[:7] == frame.columns and all(tuple(r)[2:7] == (r.doc_id, "d", "r", "l", "f") for r in rows)
        assert sorted(len(r.text.split("\n")) for r in rows) == [1, 1, 1, 1, 2]
