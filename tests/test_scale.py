"""What grows with the input: plans without wide rows, broadcasts or pairs, and few calls of keyed state."""

import hashlib
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.functions import dates, tokens
from newsloom.operators import extract, keywords, rulesets, runs
from newsloom.plans import q_feeds
from newsloom.sources import recipes
from newsloom.streaming import keyed, timers


class Handle:
    """A state handle of one key that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.calls.append("get") or self.value, update=lambda v: self.calls.append("update") or setattr(self, "value", v))

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.remove(at)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_memory_of_a_feed_is_read_and_written_once_a_batch():
    handle, memory = Handle(), timers.ArticleMemory()
    memory.init(handle)
    rows = [Row(key=f"k{k}", version=1, outcome="fault", kept=False, at=day * 86400) for day in range(20) for k in range(5)]
    out = list(memory.handleInputRows(("f",), iter(rows), None))
    assert handle.calls == ["get", "update"]
    assert len(out) == 100 and [r.turn for r in out] == list(range(100)) and {r["count"] for r in out[-5:]} == {20}
    late = list(memory.handleInputRows(("f",), iter([Row(key="k0", version=2, outcome="stored", kept=False, at=30 * 86400), Row(key="k1", version=1, outcome="fault", kept=False, at=31 * 86400)]), None))
    assert [r.event for r in late] == ["forgotten"] * 5 + ["remembered", "late"] and handle.value == (2, [("k0", 30 * 86400, 0, None, True)])


def test_a_quiet_timer_is_set_once_a_batch_without_asking_for_timers():
    handle, quiet = Handle(), timers.QuietFeeds()
    quiet.init(handle)
    rows = [Row(at=n * 100, run_id=n, ok=True, fresh=n == 0, threshold=5000) for n in range(20)]
    assert list(quiet.handleInputRows(("f",), iter(rows), None)) == [] and handle.calls == ["get", "timer", "update"] and handle.timers == {5000000}
    out = list(quiet.handleExpiredTimer(("f",), None, None))
    assert [(r.at, r.event) for r in out] == [(5000, "quiet")]


def test_a_feed_is_read_and_written_once_a_batch_from_one_cell_a_run():
    handle, feed = Handle(), keyed.FeedStates()
    feed.init(handle)
    runs_seen = [(300, 3, 500, 0, "a\tb"), (100, 1, 200, "", ""), (200, 2, 500, 99999, "x")]
    rows = [Row(feed_id="f", run="\t".join(map(str, (at, n, status, retry, 900, error)))) for at, n, status, retry, error in runs_seen]
    out = list(feed.handleInputRows(("f",), iter(rows), None))
    jitter = int(hashlib.sha256(b"f").hexdigest()[:2], 16) % 30
    assert handle.calls == ["get", "update"] and handle.value == tuple(out[0])[1:] == (2, 300, 100, 300 + 240 + jitter, "a\tb")
    # Older than the state, then unchanged after a success.
    late = list(feed.handleInputRows(("f",), iter([Row(feed_id="f", run="250\t9\t200\t\t900\t"), Row(feed_id="f", run="400\t\t304\t\t900\t")]), None))
    assert tuple(late[0])[1:] == (0, 400, 400, 400 + 900 + jitter, "")


def test_runs_without_feed_or_interval_have_no_due_time(spark, tmp_path):
    at = [datetime(1970, 1, 1) + timedelta(seconds=s) for s in (100, 200, 300)]
    rows = [(None, 1, at[0], 304, "", 60, 900), ("f", 2, at[1], 200, "", 60, None), ("f", 3, None, 500, "x", 60, 900), ("g", 4, at[2], None, None, None, 900)]
    runs_seen = spark.createDataFrame(rows, "feed_id string, run_id long, ended timestamp, status int, error string, retry_after int, interval_s int")
    found = keyed.run_slices(spark, [runs_seen], keyed.feed_states, f"{tmp_path}/run").collect()
    jitter = int(hashlib.sha256(b"g").hexdigest()[:2], 16) % 30
    assert sorted((r[:6] for r in map(tuple, found)), key=str) == sorted(
        [(None, 1, 100, 0, None, keyed.FIRST_304), ("f", 0, 200, 200, None, ""), ("g", 0, 300, 300, 1200 + jitter, "")], key=str
    )


def test_a_story_is_read_once_a_batch_and_written_when_it_changed():
    handle, story = Handle(), keyed.StoryChanges()
    story.init(handle)
    listed = lambda *rows: [tuple(r) for r in story.handleInputRows(("f", "k"), iter([Row(feed_id="f", key="k", digest=d, at=at) for d, at in rows]), None)]
    assert listed(("b", 2), ("a", 1)) == [("f", "k", "new")] and handle.value == ("b",)
    assert listed(("b", 3)) == [] and handle.calls == ["get", "update", "get"]
    assert listed(("b", 4), ("c", 4)) == [("f", "k", "changed")] and handle.value == ("c",)


def test_recipe_files_are_dealt_and_their_feeds_parsed_once(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for query in (q_feeds.recipe_contents, q_feeds.recipe_mistakes):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    text = '{"format":"newsloom.recipes","version":1,"feeds":[{"title":"t","recipe":{"type":"css","title":{"foo":"b"}}}]}'
    read = recipes.recipe_feeds(spark.createDataFrame([(text,), ("{",), (None,)], "value string"))
    assert [r.error for r in read.select("error").collect()] == ["unknown field title.foo", "the file is not one JSON document", "the file is not one JSON document"]
    assert plan(read.select("error")).count("$.feeds") == 1 and "_feeds" not in read.columns


def test_stored_details_are_not_ranked(spark):
    rows = [("f", n, "x" * 100 + str(n) if n == 3 else '{"version":%d}' % (1 + n % 2)) for n in range(5)] + [("f", 9, '{"version":1}' + " " * runs.MAX_DETAILS)]
    found = runs.read_runs(spark.createDataFrame(rows, "feed_id string, run_id long, details string").repartition(2), 4)
    got = {r.run_id: (r.n, r.trace is not None, r.details) for r in found.collect()}
    assert got == {9: (1, False, rows[5][2]), 4: (2, True, rows[4][2]), 3: (3, False, rows[3][2]), 2: (4, True, rows[2][2])}
    ranked = plan(found.select("run_id", "trace")).split("Window [")[-1]
    assert "octet_length" in ranked


def test_zone_names_are_looked_up_without_multiplying_dates(spark):
    zones = dates.zone_table(spark, ["America/New_York", "Europe/London"])
    at = lambda *a: datetime(*a)
    cases = [(1, "America/New_York", "EST", at(1994, 7, 1), -18000), (2, "America/New_York", "EDT", at(1994, 1, 1), -14400), (3, "Europe/London", "BST", at(1971, 6, 1), 3600), (4, "Europe/London", "BST", at(1990, 12, 1), 3600),
             (5, "America/New_York", "XYZ", at(1994, 1, 1), None), (6, "America/New_York", "EST", at(1960, 1, 1), None), (7, "America/New_York", "EST", at(2037, 6, 1), -18000), (8, "America/New_York", "EST", None, -18000)]
    df = spark.createDataFrame([c[:4] for c in cases for _ in range(2)], "id long, tz string, zone string, wall timestamp")
    found = dates.zone_lookup(df, zones, ["id"])
    assert sorted((r.id, r.zone_offset) for r in found.collect()) == [(c[0], c[4]) for c in cases]
    assert "min(" not in plan(found).replace("array_min(", "")


def test_rule_sets_are_never_broadcast(spark):
    nodes = spark.createDataFrame([("s", 1, 0, 1, "any", None), ("s", 2, 1, 2, "contains_any", "title"), ("t", 1, 0, 1, "bogus", "x")], "set_id string, node_id int, parent_id int, depth int, op string, field string")
    words = spark.createDataFrame([("s", 2, "w"), ("s", 2, " ")], "set_id string, node_id int, keyword string")
    found = rulesets.lint_rules(nodes, words)
    assert sorted(map(tuple, found.collect())) == [("s", 2, 2, 2, "keyword text"), ("t", 1, 1, 0, "operator")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_first_match_and_first_key_are_found_without_comparing_pairs(spark):
    """Nested and empty cards, fields before, inside and after them, repeated and missing keys."""
    html = "<b>t0</b><div><p>x</p></div><div><b>t1</b><div><b>t2</b></div></div><div><b>t1</b></div><div><b></b></div><b>t9</b><div><b>t2</b></div><div><b>t3</b></div>"
    page = spark.createDataFrame([(1, "f", "https://x.example/", html), (2, "f", "https://x.example/", "<p>none</p>")], "page_id long, feed_id string, url string, html string").withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    recipe = extract.Recipe(items="div", title=extract.Field("b"))
    pages = extract.read_pages(page, recipe)
    got = {r.page_id: [(c.pos, c.title, c.reason is None) for c in r.cards] for r in pages.collect()}
    assert got == {1: [(0, "", False), (1, "t1", True), (2, "t2", True), (4, "", False), (6, "t3", True)], 2: []}
    assert "exists(slice" not in plan(pages)


def test_a_page_of_thousand_cards_takes_no_million_steps(spark):
    cards = [(f"k{n % 900}", None if n % 7 else "no title") for n in range(1000)]
    found = spark.createDataFrame([(cards,)], "found array<struct<key string, reason string>>")
    kept = found.select(extract._first_wins(F.col("found")).alias("k")).first().k
    seen, want = set(), []
    for key, reason in cards:
        if reason is not None or key not in seen:
            want.append((key, reason))
        if reason is None:
            seen.add(key)
    assert [tuple(r) for r in kept] == want


def test_keywords_meet_texts_in_shards_without_grams(spark):
    texts = spark.createDataFrame([(1, "The  cat sat"), (2, "concat enated"), (3, None), (4, "a t"), (None, "cat")], "item_id long, text string")
    words = spark.createDataFrame([(w,) for w in ("cat", "CAT", "t s", "at", "zebra", "a", "", None)], "keyword string")
    found = keywords.keyword_join(texts, words)
    assert sorted(map(tuple, found.collect())) == [(1, "CAT"), (1, "a"), (1, "at"), (1, "cat"), (1, "t s"), (2, "CAT"), (2, "a"), (2, "at"), (2, "cat"), (4, "a")]
    hits = keywords.keyword_hits(texts, words)
    assert {r.keyword: r.hits for r in hits.collect()} == {"cat": 2, "CAT": 2, "t s": 1, "at": 2, "zebra": 0, "a": 3, "": 0, None: 0}
    assert "regexp_extract_all" not in plan(hits)


def test_texts_of_keywords_stay_where_they_are_read(spark):
    texts = [(k, f"{'x' * (k % 5)}cat {k} dog sat" if k % 3 else "none") for k in range(300)] + [(7, "a cat"), (7, "cat sat"), (7, "dog"), (8, None), (-4, "hot dog")]
    words = [f"{k}" for k in range(0, 300, 7)] + ["cat", "xcat", "g sa", "CAT", "dog", "zz", " ", None]
    held = lambda w: [k for k, t in texts if t is not None and w.strip() and w.lower() in t]
    want = {w: sum(held(w).count(k) ** 2 for k in set(held(w))) if w else 0 for w in words}
    items = spark.createDataFrame(texts, "item_id long, text string").repartition(6)
    hits = keywords.keyword_hits(items, spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert {r.keyword: r.hits for r in hits.collect()} == want and want["cat"] > want["xcat"] > 1
    plain = plan(keywords.keyword_hits(items.filter("item_id not in (7, 8)"), spark.createDataFrame([("cat",)], "keyword string")))
    assert "CoGroup" not in plain and "hashpartitioning(item_id" not in plain


def test_words_of_equal_hashes_and_long_texts_are_told_apart(monkeypatch):
    monkeypatch.setattr(keywords, "_mixed", lambda h: h & keywords.np.uint64(3) | keywords.np.uint64(1 << 60))
    monkeypatch.setattr(keywords, "PIECE", 16)
    words = ["cat", "at", "sat on", "mat", "x" * 40]
    hashed = next(keywords._hashed([keywords.pa.table({"word": words}).to_batches()[0]]))
    index = keywords._Index(keywords.np.sort(hashed.column("h").to_numpy().view("u8")), sorted({len(w) for w in words}), {})
    texts = ["the cat sat on the mat " + "y" * 30 + "x" * 41, "", "mats", "c at"]
    names = index.names
    for text, found in zip(texts, index.held(texts), strict=True):
        told = {w for w, n in names.items() if n in found.tolist()}
        assert {w for w in words if w in text} == told & set(words) and all(w in text for w in told)


def test_first_cards_are_sorted_without_a_lambda_and_halved_by_steps_of_the_page(spark):
    page = spark.createDataFrame([(1, "f", "https://x.example/", "<li><b>t</b></li>" * 5 + "<li><b>u</b>")], "page_id long, feed_id string, url string, html string").withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    pages = extract.read_pages(page, extract.Recipe(items="li", title=extract.Field("b")))
    assert [(c.pos, c.title) for c in pages.first().cards] == [(0, "t"), (5, "u")]
    assert "array_sort(" not in plan(pages) and plan(pages).count("filter([1,2,4") <= 5


def test_siblings_of_a_batch_are_numbered_page_by_page():
    rng = random.Random(6)
    htmls = ["".join(rng.choice(["<ul>", "<li>x", "</ul>", "<p>", "<b>y</b>", "</p>", "<br>"]) for _ in range(rng.randint(0, 40))) for _ in range(50)] + [None, "", "z"]
    for nodes in tokens.read_batch(pa.array(htmls, pa.string())).to_pylist():
        for n in nodes:
            assert nodes[n["pre"]] is n
            level = [m["pre"] for m in nodes if m["parent"] == n["parent"] and m["tag"] != "#text"]
            alike = [p for p in level if nodes[p]["tag"] == n["tag"]]
            want = (0, 0, 0, 0) if n["tag"] == "#text" else (level.index(n["pre"]) + 1, len(level) - level.index(n["pre"]), alike.index(n["pre"]) + 1, len(alike) - alike.index(n["pre"]))
            assert tuple(n[c] for c in ("sib", "rsib", "tsib", "rtsib")) == want
