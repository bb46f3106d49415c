"""Structural and keyword joins, card proposals, and streams with timers, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import discovery, dom, extract, history, keywords
from newsloom.operators.extract import Field, Recipe
from newsloom.operators import recipe_table as RT
from newsloom.plans import bindings as B
from newsloom.streaming import composed, keyed, timers

T0 = datetime(2024, 1, 1)


def test_structural_join_equals_node_pairs(spark):
    rng = random.Random(2)
    html = "".join(rng.choice(["<ul>", "<li>", "</li>", "</ul>", "<p>x", "<b>", "</b>"]) for _ in range(400))
    nodes = dom.dom_nodes(spark.createDataFrame([(k, html[k * 30 :]) for k in range(5)], "page_id long, html string")).cache()
    above, below = nodes.filter(F.col("tag").isin("ul", "li")), nodes.filter(F.col("tag").isin("li", "b", "#text"))
    got = sorted((r.page_id, r.a_pre, r.d_pre) for r in dom.contains_join(above, below).collect())
    a, d = above.collect(), below.collect()
    want = sorted((x.page_id, x.pre, y.pre) for x in a for y in d if x.page_id == y.page_id and x.pre < y.pre <= x.last)
    assert got == want and len(got) > 100


def test_keyword_join_equals_every_pair(spark):
    rng = random.Random(3)
    letters = "abcdeé 中"
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(100, None), (101, ""), (102, "ABC  Éa")]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["", " ", None, "AB", "abc", "ABC", "zzz", "c é"]
    got = keywords.keyword_join(spark.createDataFrame(texts, "item_id long, text string"), spark.createDataFrame([(w,) for w in words], "keyword string")).collect()
    fold = lambda s: " ".join(s.split()).lower()
    want = {(k, w) for k, t in texts if t is not None for w in words if w is not None and fold(w) and fold(w) in fold(t)}
    assert sorted((r.item_id, r.keyword) for r in got) == sorted(want) and len(want) > 500


def test_ten_thousand_keywords(spark):
    docs = B.table(spark, "/root/testdata/sf0.001", "documents").select(F.col("doc_id").alias("item_id"), "text")
    rng = random.Random(1)
    texts = {r.item_id: (r.text or "").lower() for r in docs.collect()}
    every = " ".join(texts.values())
    words = {every[at : at + rng.randint(4, 9)].strip() for at in (rng.randrange(len(every) - 20) for _ in range(12000))}
    words = sorted(w for w in words if w and "\n" not in w and "  " not in w and w.isascii())[:10000]
    hits = {r.keyword: r.hits for r in keywords.keyword_hits(docs, spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    assert len(hits) == len(words)
    flat = {k: " ".join(t.split()) for k, t in texts.items()}
    for w in rng.sample(words, 150):
        assert hits[w] == sum(w in t for t in flat.values()), w


def test_card_proposals_are_disjoint_and_ranked(spark):
    page = """<div id="top"><article class="card big"><h2>a</h2><a href="1">x</a></article><article class="card"><h2>b</h2><a href="2">x</a></article></div>
<ul class="more"><li><a href="3">y</a></li><li><a href="4">y</a></li><li><a href="5">y</a></li></ul><li>no link</li>"""
    rows = discovery.propose_cards(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("rank").collect()
    by = {r.selector: r for r in rows}
    assert by["article"]["count"] == by["article.card:has(h2)"]["count"] == by["article.card"]["count"] == 2 and "article.card.big" not in by
    assert by["#top article.card"]["count"] if "#top article.card" in by else True
    assert by["ul.more > li"]["count"] == 3 and "li" not in by
    chosen = [r.selector for r in rows if r.chosen]
    assert chosen[0].startswith("article") and len(chosen) == 2 and chosen[1] == "ul.more > li"
    nested = "<div><div><a href=1>x</a></div><div><a href=2>y</a></div></div><p>z</p>"
    assert "div" not in [r.selector for r in discovery.propose_cards(spark.createDataFrame([(1, nested)], "page_id long, html string")).collect()]


# ----------------------------------------------------------------- streams


def run(spark, tmp_path, slices, transform):
    timers.with_state_store(spark)
    return keyed.run_slices(spark, slices, transform, f"{tmp_path}/run").collect()


def test_outages_close_once_after_silence(spark, tmp_path):
    at = [0, 100, 4000, 5000, 9000, 30000, 30010, 40000]
    rows = [("disk", T0 + timedelta(seconds=s)) for s in at] + [("net", T0 + timedelta(seconds=39000)), ("clock", T0 + timedelta(seconds=60000))]
    df = spark.createDataFrame(rows, "kind string, ts timestamp")
    cut = [(F.col("ts") < T0 + timedelta(seconds=a)) & (F.col("ts") >= T0 + timedelta(seconds=b)) for a, b in ((4500, 0), (30005, 4500), (70000, 30005))]
    out = run(spark, tmp_path, [df.filter(c) for c in cut], lambda d: timers.outages(d, 3600, 2000))
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.kind, r.at - start, r.event) for r in out)
    assert got == sorted(
        [("disk", s, "sent") for s in (0, 4000, 9000, 30000, 40000)] + [("disk", s, "closed") for s in (2100, 7000, 11000, 32010, 42000)] + [("net", 39000, "sent"), ("net", 41000, "closed"), ("clock", 60000, "sent")]
    )


def test_composed_refresh_equals_merging_one_capture_after_the_other(spark, tmp_path):
    """Retention of two stories, a story that returns after it was cut, failures, unchanged pages and an edit."""
    rng = random.Random(5)
    rows = []
    for n in range(14):
        links = "".join(f'<li><a href="/{k}">t{k}{rng.choice("xy")}</a></li>' for k in rng.sample(range(5), 3))
        status = {3: 304, 5: 500, 9: 500, 10: 304}.get(n, 200)
        rows.append((n, f"h{n % 2}", f"https://h{n % 2}.example/", status, 2 if n > 7 and n != 11 else 1, 600, f"<nav>{links}</nav>" if n != 6 else "<p>", T0 + timedelta(minutes=n)))
    schema = "page_id long, feed_id string, url string, status int, version int, interval_s int, html string, captured_at timestamp"
    captured = spark.createDataFrame(rows, schema)
    edits = spark.createDataFrame([(f, 2, T0 + timedelta(minutes=7, seconds=30), 600) for f in ("h0", "h1")], "feed_id string, version int, at timestamp, interval_s int")
    base = Recipe(items="nav li", title=Field("a"), link=Field("a"))
    table = [RT.recipe_row(f, base, v) for f in ("h0", "h1") for v in (1, 2)]
    compiled = RT.compile_recipes(spark.createDataFrame([tuple(r[c] for c in RT.RECIPES.names) for r in table], RT.RECIPES)).cache()
    both = captured.withColumn("row", F.lit("capture")).unionByName(edits.withColumnRenamed("at", "captured_at").withColumn("row", F.lit("edit")), allowMissingColumns=True)
    cut = [F.col("captured_at") < T0 + timedelta(minutes=4), (F.col("captured_at") >= T0 + timedelta(minutes=4)) & (F.col("captured_at") < T0 + timedelta(minutes=9)), F.col("captured_at") >= T0 + timedelta(minutes=9)]

    def changes(d):
        listed = composed.read_listings(d.filter("row = 'capture'"), compiled)
        return composed.refresh_changes(listed.unionByName(composed.edit_rows(d.filter("row = 'edit'").withColumnRenamed("captured_at", "at"))), keep=2, alert_after=1)

    timers.with_state_store(spark)
    log = keyed.run_slices(spark, [both.filter(c) for c in cut], changes, f"{tmp_path}/run").cache()

    pages = RT.read_pages(captured.drop("version"), compiled.filter("version = 1"))
    listed = extract.stories(pages).select("page_id", "feed_id", "key", "title", "url", "html", "image", F.lit("").alias("content_full"), "published").cache()
    feeds = {f: None for f in ("h0", "h1")}
    items = B.empty_items(spark)
    for n, feed, url, status, version, _, html, when in rows:
        if (version == 1 and n > 7) or status != 200 or "<nav>" not in html:
            continue
        batch = listed.filter(F.col("page_id") == n).drop("page_id")
        row = spark.createDataFrame([(feed, feeds[feed])], "feed_id string, last_changed timestamp")
        merged = history.merge_items(items.filter(F.col("feed_id") == feed), batch, row, F.lit(when))
        kept = history.retain_items(merged, 2)
        change = history.change_summary(merged, kept, row.withColumn("last_new", F.lit(None).cast("timestamp")), F.lit(when)).first()
        feeds[feed] = change.last_changed
        new = [tuple(r) for r in kept.select(*items.columns).unionByName(items.filter(F.col("feed_id") != feed)).collect()]
        items = spark.createDataFrame(new, items.schema)
    names = ["feed_id", "key", "title", "url"]
    moments = ["published", "first_seen", "last_seen", "last_changed"]
    want = sorted(map(tuple, items.select(*names, *[F.unix_timestamp(m) for m in moments]).collect()))
    assert sorted(map(tuple, composed.items_after(log).select(*names, *moments).collect())) == want and len(want) == 4
    state = {r.feed_id: r for r in composed.feeds_after(log).collect()}
    assert {f: r.last_changed for f, r in state.items()} == {f: int((m - datetime(1970, 1, 1)).total_seconds()) for f, m in feeds.items()}
    kinds = [r.kind for r in log.collect()]
    assert kinds.count("stale") == 1 and kinds.count("run") == 13 and "removed" in kinds and kinds.count("failing") == 3 and kinds.count("recovered") >= 2


def test_memory_forgets_what_is_no_longer_listed_or_of_an_old_version(spark, tmp_path):
    day = lambda d: T0 + timedelta(days=d)
    rows = [
        ("f", "a", 1, "fault", False, day(0)), ("f", "b", 1, "deferred", False, day(0)), ("f", "c", 1, "stored", False, day(0)),
        ("f", "a", 1, "fault", False, day(1)), ("f", "b", 1, None, False, day(1)),
        ("f", "a", 1, "fault", False, day(2)), ("f", "a", 2, "fault", False, day(3)), ("f", "b", 1, "fault", False, day(3)),
    ]
    df = spark.createDataFrame(rows, "feed_id string, key string, version int, outcome string, kept boolean, at timestamp")
    timers.with_state_store(spark)
    log = keyed.run_slices(spark, [df.filter(F.col("at") < day(2)), df.filter(F.col("at") >= day(2))], timers.article_memory_stream, f"{tmp_path}/run")
    after = {r.key: r for r in timers.memory_after(log).collect()}
    assert set(after) == {"a"} and after["a"].version == 2 and after["a"]["count"] == 1
    assert [r.rows for r in log.filter("event = 'late'").collect()] == [1]
    first = {r.key: r for r in timers.memory_after(log.filter("batch = 0")).collect()}
    assert set(first) == {"a", "b"} and first["a"]["count"] == 2 and first["b"]["count"] == 0


def test_a_feed_turns_quiet_by_itself(spark, tmp_path):
    rows = [("f", n, T0 + timedelta(days=d), e, new, 3600, 1) for n, (d, e, new) in enumerate([(0, "", True), (0.5, "", False), (3, "", False), (4, "x", False), (5, "", False), (6, "", True)])]
    rows += [("g", 100, T0 + timedelta(days=20), "", False, 3600, -1)]
    df = spark.createDataFrame(rows, "feed_id string, run_id long, ended timestamp, error string, new_story boolean, interval_s int, quiet_days int")
    cuts = [F.col("ended") < T0 + timedelta(days=2), (F.col("ended") >= T0 + timedelta(days=2)) & (F.col("ended") < T0 + timedelta(days=5.5)), F.col("ended") >= T0 + timedelta(days=5.5)]
    out = run(spark, tmp_path, [df.filter(c) for c in cuts], timers.quiet_stream)
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    got = sorted(((r.at - start) / 86400, r.event) for r in out if r.feed_id == "f")
    assert got == [(1.0, "quiet"), (4.0, "resumed"), (5.0, "quiet"), (6.0, "resumed"), (7.0, "quiet")]
