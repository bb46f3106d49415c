"""Histories, feeds, rules, runs and streams: sequences and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions.rules import RuleSet, combine, decide, keyword_pattern
from newsloom.functions.text import fold
from newsloom.operators import feeds as FD
from newsloom.operators import groups, history, rulesets, runs
from newsloom.plans import bindings as B
from newsloom.plans import render
from newsloom.plans.refresh import FRONT
from newsloom.streaming.alerts import EdgeStream, MessageStream, ThrottleStream
from newsloom.streaming.refresh import RefreshStream, run_available

T0 = datetime(2024, 1, 1)
BATCH = "feed_id string, key string, title string, url string, html string, image string, content_full string, published timestamp"
FEED = "feed_id string, last_changed timestamp, last_new timestamp"


def listing(key, title, published=None, full=""):
    return ("f", key, title, key, "h", "", full, published)


def merge(spark, items, rows, at, changed=None):
    feeds = spark.createDataFrame([("f", changed, changed)], FEED)
    return history.merge_items(items, spark.createDataFrame(rows, BATCH), feeds, F.lit(at).cast("timestamp"))


def test_merge_sequence(spark):
    one = merge(spark, B.empty_items(spark), [listing("a", "A"), listing("b", "B", T0, "body")], T0)
    items = spark.createDataFrame(one.drop("inserted", "changed").collect(), B.empty_items(spark).schema)
    two = {r.key: r for r in merge(spark, items, [listing("a", "A2", T0 + timedelta(days=9)), listing("b", "B")], T0 + timedelta(hours=1), T0).collect()}
    a, b = two["a"], two["b"]
    assert a.title == "A2" and a.published == T0 and a.first_seen == T0 and a.changed and a.last_changed == T0 + timedelta(hours=1)
    assert b.content_full == "body" and not b.changed and b.last_changed == T0 and b.last_seen == T0 + timedelta(hours=1)
    same_second = {r.key: r for r in merge(spark, items, [listing("a", "A3")], T0, T0).collect()}
    assert same_second["a"].last_changed == T0 + timedelta(seconds=1)


def test_retention_and_change_summary(spark):
    rows = [listing(f"k{i}", "t", T0 + timedelta(days=i)) for i in range(5)]
    merged = merge(spark, B.empty_items(spark), rows, T0)
    kept = history.retain_items(merged, 3)
    assert sorted(r.key for r in kept.collect()) == ["k2", "k3", "k4"]
    feeds = spark.createDataFrame([("f", None, None)], FEED)
    out = history.change_summary(merged, kept, feeds, F.lit(T0).cast("timestamp")).first()
    assert (out.inserted, out.changed, out.removed, out.output_changed, out.last_new) == (3, 0, 2, True, T0)


def test_keys_order_by_bytes(spark):
    rows = [listing(k, "t", T0) for k in ("b", "B", "é", "a")]
    assert sorted(r.key for r in history.retain_items(merge(spark, B.empty_items(spark), rows, T0), 2).collect()) == ["B", "a"]


@pytest.mark.parametrize(
    "changes, quiet",
    [
        ({}, True),
        ({"enabled": False}, False),
        ({"failures": 1}, False),
        ({"quiet_days": -1}, False),
        ({"quiet_days": 30}, False),
        ({"quiet_days": 7, "interval_s": 20 * 86400}, False),
        ({"interval_s": 3 * 86400}, False),
        ({"last_success": T0 - timedelta(days=30)}, False),
        ({"last_new": None, "last_changed": T0}, False),
        ({"last_changed": None}, False),
    ],
)
def test_quiet(spark, changes, quiet):
    row = dict(
        feed_id="f", enabled=True, failures=0, interval_s=3600, quiet_days=0, last_attempt=T0, last_success=T0,
        last_changed=T0 - timedelta(days=20), last_new=T0 - timedelta(days=20),
    )
    row.update(changes)
    schema = "feed_id string, enabled boolean, failures int, interval_s int, quiet_days int, last_attempt timestamp, last_success timestamp, last_changed timestamp, last_new timestamp"
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert FD.quiet_feeds(df, F.lit(T0).cast("timestamp")).count() == int(quiet)


def random_rule(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        return {"op": rng.choice(["all", "any"]), "rules": [random_rule(rng, depth + 1) for _ in range(rng.randint(1, 3))]}
    return {"op": rng.choice(["contains_any", "contains_all"]), "field": rng.choice(["title", "description", "link"]), "keywords": rng.sample(["a", "b", "Ab", "c", "é"], rng.randint(1, 3))}


def expect(rule, item):
    if rule["op"] in ("all", "any"):
        found = [expect(r, item) for r in rule["rules"]]
        return all(found) if rule["op"] == "all" else any(found)
    hits = [k.lower() in item[rule["field"]].lower() for k in rule["keywords"]]
    return all(hits) if rule["op"] == "contains_all" else any(hits)


def test_compiled_and_data_driven_rules_agree_with_brute_force(spark):
    rng = random.Random(5)
    sets = {f"s{i}": RuleSet(random_rule(rng) if i % 3 else None, random_rule(rng) if i % 2 else None) for i in range(6)}
    items = [("".join(rng.choices("abcé ", k=4)), "".join(rng.choices("abc", k=3)), "".join(rng.choices("abc", k=2))) for _ in range(40)]
    rows = [(s, i, *items[i]) for s in sets for i in range(len(items))]
    df = spark.createDataFrame(rows, "set_id string, item_id int, title string, description string, url string")
    nodes, words = rulesets.rule_tables(spark, sets)
    got = {(r.set_id, r.item_id): r.keep for r in rulesets.keep_by_rules(rulesets.evaluate_rules(df, nodes, words)).collect()}
    for name, rules in sets.items():
        compiled = {
            r.item_id: r.reason is None
            for r in df.filter(F.col("set_id") == name).withColumn("reason", decide(rules, F.col("title"), F.col("description"), F.col("url"))).collect()
        }
        for i, (title, description, link) in enumerate(items):
            item = dict(title=title, description=description, link=link)
            want = (rules.include is None or expect(rules.include, item)) and not (rules.exclude is not None and expect(rules.exclude, item))
            assert compiled[i] == want
            if rules:
                assert got[name, i] == want, (name, i)


def test_combine_splices_same_operator():
    leaf = lambda k: {"op": "contains_any", "field": "title", "keywords": [k]}
    both = combine(RuleSet(include={"op": "all", "rules": [leaf("a"), leaf("b")]}), [RuleSet(include=leaf("c"), exclude=leaf("d"))])
    assert both.include == {"op": "all", "rules": [leaf("a"), leaf("b"), leaf("c")]} and both.exclude == leaf("d")
    assert combine(None, []) == RuleSet()


def test_keyword_pattern_matches_like_a_loop(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abc.|é ", k=rng.randint(1, 5))).strip() or "x" for _ in range(60)]
    texts = ["".join(rng.choices("abc.|é x", k=12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = [r.hit for r in df.orderBy("n").select(F.col("t").rlike(keyword_pattern([w.lower() for w in words])).alias("hit")).collect()]
    assert got == [any(w.lower() in t for w in words) for t in texts]


# ---------------------------------------------------------- skewed groups


def skewed_runs(spark, n=3000, seed=1):
    """One feed holds a third of all runs; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        feed = "hot" if rng.random() < 0.34 else f"f{rng.randint(0, 20)}"
        rows.append((feed, i, T0 + timedelta(seconds=rng.randint(0, 5 * 86400)), rng.choice(["failed", "failed", ""])))
    return rows, spark.createDataFrame(rows, "feed_id string, run_id long, ended timestamp, error string")


def folded(rows, n=3):
    """Streaks and edges by a plain loop."""
    streak, edges, last = {}, [], {}
    for feed, run, ended, error in sorted(rows, key=lambda r: (r[2], r[1])):
        before = last.get(feed, 0)
        last[feed] = before + 1 if error else 0
        streak[run] = last[feed]
        if error and last[feed] == n:
            edges.append((run, "failing"))
        if not error and before >= n:
            edges.append((run, "recovered"))
    return streak, sorted(edges)


def test_streaks_and_edges_on_a_hot_feed(spark):
    rows, df = skewed_runs(spark)
    streak, edges = folded(rows)
    assert {r.run_id: r.streak for r in runs.failure_streaks(df).collect()} == streak
    assert sorted((r.run_id, r.kind) for r in runs.alert_edges(df, 3).collect()) == edges


def test_carry_forward_on_a_hot_group(spark):
    rows, df = skewed_runs(spark, 1500, 2)
    got = groups.carry_forward(df, ["feed_id"], "ended", ["run_id"], F.when(F.col("error") == "", F.col("run_id")), "ok", inclusive=False)
    want, last = {}, {}
    for feed, run, ended, error in sorted(rows, key=lambda r: (r[2], r[1])):
        want[run] = last.get(feed)
        if not error:
            last[feed] = run
    assert {r.run_id: r.ok for r in got.collect()} == want


def test_top_n_on_a_hot_group(spark):
    rows, df = skewed_runs(spark)
    got = {}
    for r in groups.first_n_per_group(df, ["feed_id"], [F.col("ended").desc(), F.col("run_id")], 7, ["run_id"]).collect():
        got.setdefault(r.feed_id, {})[r.n] = r.run_id
    by_feed = {}
    for feed, run, ended, _ in rows:
        by_feed.setdefault(feed, []).append((-ended.timestamp(), run))
    assert got == {f: {i + 1: run for i, (_, run) in enumerate(sorted(v)[:7])} for f, v in by_feed.items()}


def anchors(seconds, width):
    out, current = {}, None
    for s in sorted(seconds):
        if current is None or s >= current + width:
            current = s
        out[s] = current
    return out


@pytest.mark.parametrize("width", [60, 3600, 30000])
def test_anchored_windows(spark, width):
    rows, df = skewed_runs(spark, 800, 4)
    got = groups.anchored_windows(df, F.lit("all"), "ended", width)
    want = anchors({int((e - datetime(1970, 1, 1)).total_seconds()) for _, _, e, _ in rows}, width)
    assert {r.second: r.anchor for r in got.select("second", "anchor").collect()} == want


@pytest.mark.parametrize("width", [7, 60, 3600])
def test_anchored_windows_of_a_span_that_never_pauses(spark, width):
    """One event each second over several chunks, and a late pair after a gap."""
    seconds = [*range(1704067200 + 11, 1704067200 + 70000), 1704067200 + 90000, 1704067200 + 90001]
    df = spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").alias("ended"))
    got = {r.second: r.anchor for r in groups.anchored_windows(df, F.lit("all"), "ended", width).collect()}
    assert got == anchors(seconds, width)


# ----------------------------------------------------------------- streams


def in_parts(df, parts, path):
    """The rows as files that arrive one after the other."""
    for part in range(parts):
        df.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def test_edge_stream_equals_batch(spark, tmp_path):
    rows, df = skewed_runs(spark, 900, 7)
    split = df.withColumn("part", F.least(F.floor((F.unix_timestamp("ended") - 1704067200) / 86400), F.lit(4)))
    handler = EdgeStream(spark, f"{tmp_path}/state", 3)
    for part in range(5):
        handler(split.filter(F.col("part") == part).drop("part"), part)
    assert sorted((r.run_id, r.kind) for r in handler.edges().collect()) == folded(rows)[1]
    handler(split.filter(F.col("part") == 4).drop("part"), 4)  # a replayed batch counts once
    assert sorted((r.run_id, r.kind) for r in handler.edges().collect()) == folded(rows)[1]


def test_message_and_throttle_streams_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted((T0 + timedelta(seconds=rng.randint(0, 20000)), rng.choice(["failing", "recovered", "not_saved"])) for _ in range(400))
    rows = [(i, ts, kind, "F", 3, "") for i, (ts, kind) in enumerate(rows)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, feed string, failures long, error string")
    messages, throttled = MessageStream(spark, f"{tmp_path}/m"), ThrottleStream(spark, f"{tmp_path}/t")
    for part in range(3):
        piece = df.filter((F.col("event_id") >= part * 140) & (F.col("event_id") < (part + 1) * 140))
        messages(piece, part)
        throttled(piece, part)
    messages.flush(spark, 3)
    want = {(r.opened, r.events, r.listed, r.urgent) for r in runs.alert_batches(df).collect()}
    assert {(r.opened, r.events, r.listed, r.urgent) for r in messages.messages().collect()} == want
    assert {r.event_id for r in throttled.sent().collect()} == {r.event_id for r in runs.alert_throttle(df).collect()}


def test_message_bounds(spark):
    rows = [(i, T0 + timedelta(seconds=i % 50), "failing", f"F{i}", 3, "e") for i in range(300)]
    rows += [(300 + i, T0 + timedelta(seconds=55), "not_saved", "G", 0, "") for i in range(10)]
    out = runs.alert_batches(spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, feed string, failures long, error string")).collect()
    assert len(out) == 1 and out[0].events == 310 and out[0].listed == 20 and out[0].more == 290
    lines = out[0].message.split("\n")
    assert lines[:8] == ["not_saved"] * 8 and lines[8].startswith("Failing: F0 - 3 refreshes") and lines[-1] == "...and 290 more."


@pytest.mark.parametrize("keep", [1000, 2], ids=["folded", "in order"])
def test_refresh_stream_equals_one_capture_at_a_time(spark, tmp_path, keep):
    """Several captures of a feed per batch give what refreshing one by one gives."""
    rng = random.Random(11)
    rows = []
    for n in range(5):
        links = "".join(f'<li><a href="/{k}">t{k}{rng.choice("xy")}</a></li>' for k in rng.sample(range(6), 3))
        rows.append((n, f"h{n % 2}", f"https://h{n % 2}.example/", 200, f"<nav>{links}</nav>", T0 + timedelta(minutes=n)))
    schema = "page_id long, feed_id string, url string, status int, html string, captured_at timestamp"
    df = spark.createDataFrame(rows, schema)
    single, grouped = RefreshStream(spark, f"{tmp_path}/one", FRONT, keep), RefreshStream(spark, f"{tmp_path}/many", FRONT, keep)
    for n in range(5):
        single(df.filter(F.col("page_id") == n), n)
    grouped(df.filter("page_id < 3"), 0)
    grouped(df.filter("page_id >= 3"), 1)
    columns = ["feed_id", "key", "title", "published", "first_seen", "last_seen", "last_changed"]
    shape = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    assert shape(single.items()) == shape(grouped.items())
    feed = lambda d: sorted(map(tuple, d.select("feed_id", "last_attempt", "last_success", "failures", "last_changed", "last_new").collect()))
    assert feed(single.feeds()) == feed(grouped.feeds())


def test_failed_pages_back_off_and_keep_stories(spark, tmp_path):
    schema = "page_id long, feed_id string, url string, status int, html string, captured_at timestamp"
    good = '<nav><li><a href="/a">A</a></li></nav>'
    rows = [(n, "h", "https://h.example/", 200, good if n == 0 else "<p>", T0 + timedelta(hours=n)) for n in range(3)]
    handler = RefreshStream(spark, f"{tmp_path}/s", FRONT)
    handler(spark.createDataFrame(rows[:1], schema), 0)
    handler(spark.createDataFrame(rows[1:], schema), 1)
    feed = handler.feeds().first()
    assert feed.failures == 2 and feed.last_success == T0 and feed.last_attempt == T0 + timedelta(hours=2)
    assert 240 <= (feed.next_run - feed.last_attempt).total_seconds() < 270 and feed.error.startswith("none of")
    assert handler.items().count() == 1 and handler.runs().count() == 3


def test_file_stream_drives_the_handler(spark, tmp_path):
    pages = B.table(spark, "/root/testdata/sf0.001", "pages").withColumn("part", F.col("page_id") % 2)
    path = in_parts(pages, 2, f"{tmp_path}/in")
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 1).parquet(path)
    seen = []
    run_available(stream, lambda d, i: seen.append((i, d.count())), f"{tmp_path}/ck")
    assert [i for i, _ in seen] == [0, 1] and sum(n for _, n in seen) == 50


def test_documents_do_not_change_without_a_change(spark):
    folder = "/root/testdata/sf0.001"
    first = render.render_rss(B.host_feeds(spark, folder), B.kept_items(spark, folder))
    again = render.render_rss(B.host_feeds(spark, folder).repartition(5), B.kept_items(spark, folder).repartition(7))
    assert render.changed_only(again, first).count() == 0


def test_fold_is_idempotent(values):
    assert values(["A  b", "ΣΑΣ"], lambda c: fold(fold(c))) == values(["A  b", "ΣΑΣ"], fold)
