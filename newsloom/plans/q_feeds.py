"""Queries over feed state, runs, alerts, recipes and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import feeds as FD
from newsloom.operators import history as H
from newsloom.operators import runs as RN
from newsloom.plans import bindings as B
from newsloom.plans import render
from newsloom.plans.registry import query
from newsloom.sources import recipes as RC

NOW = B.NOW_S
SQL_STREAK = B.SQL_RUNS + """, isl AS (SELECT *, sum(CASE WHEN error='' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING) AS island FROM runs),
streaks AS (SELECT *, sum(CASE WHEN error<>'' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, island ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM isl)"""


# --------------------------------------------------------------------- runs


@query("W4_failure_streaks", f"WITH {SQL_STREAK} SELECT feed_id, run_id, streak FROM streaks")
def failure_streaks(spark, folder):
    return RN.failure_streaks(B.runs(spark, folder)).select("feed_id", "run_id", "streak")


@query("W2_retain_runs", f"WITH {B.SQL_RUNS} SELECT feed_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY run_id DESC) AS n FROM runs) WHERE n<=50")
def retain_runs(spark, folder):
    return RN.retain_runs(B.runs(spark, folder)).select("feed_id", "run_id")


@query("W5_latest_reading_run", f"WITH {B.SQL_RUNS} SELECT feed_id, max(run_id) AS run_id, arg_max(count,run_id) AS count, arg_max(ended,run_id) AS ended FROM runs WHERE status<>304 AND error='' GROUP BY feed_id")
def latest_reading(spark, folder):
    return RN.latest_reading_run(B.runs(spark, folder))


@query(
    "A4_run_rollup",
    f"""WITH {B.SQL_RUNS} SELECT feed_id, count(*) AS attempts, count(*) FILTER (WHERE error='') AS successes, count(*) FILTER (WHERE error<>'') AS failures, count(*) FILTER (WHERE status=304) AS not_modified,
 arg_max(status,run_id) AS last_status, max(count) AS max_count, sum(count)::BIGINT / count(*) AS mean_count, sum(count)::BIGINT AS stories, max(run_id%3600*1000) AS max_duration_ms, sum(run_id%3600*1000)::BIGINT / count(*) AS mean_duration_ms FROM runs GROUP BY feed_id""",
)
def run_rollup(spark, folder):
    return RN.run_rollup(B.runs(spark, folder).withColumn("duration_ms", F.col("run_id") % 3600 * 1000))


def traced(spark, folder):
    """Run details as stored text: most are good, some malformed, of another version, or too long."""
    k = F.col("run_id") % 5
    attempt = F.concat(F.lit('{"mode":"'), F.when(F.col("run_id") % 2 == 0, "auto").otherwise("magic"), F.lit('","outcome":"success","stage":"fetch","status":'), (F.col("run_id") % 700).cast("string"),
                       F.lit(',"duration_ms":'), (F.col("run_id") * 1000).cast("string"), F.lit(',"matches":'), F.col("count").cast("string"), F.lit(',"error":"at https://x.example/y","warnings":["w"]}'))
    good = F.concat(F.lit('{"version":'), F.when(k == 1, "2").otherwise("1"), F.lit(',"recipe_version":-3,"requested_mode":"","selector_type":"css","duration_ms":9999999,"attempts":['), attempt, F.lit(","), attempt, F.lit(","), attempt, F.lit("]}"))
    details = F.when(k == 2, "{broken").when(k == 3, F.concat(good, F.repeat(F.lit(" "), 65536))).otherwise(good)
    return B.by_rows(B.runs(spark, folder).drop("props"), 100000, "run_id").withColumn("details", details)


@query("S8_runs_scan", f"WITH {B.SQL_RUNS} SELECT feed_id, run_id, n, run_id%5 IN (0,4) AS has_trace FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY run_id DESC) AS n FROM runs) WHERE n<=50")
def runs_scan(spark, folder):
    return RN.read_runs(traced(spark, folder)).select("feed_id", "run_id", "n", F.col("trace").isNotNull().alias("has_trace"))


@query(
    "D2_sanitize_runs",
    f"""WITH {B.SQL_RUNS} SELECT run_id, 0 AS recipe_version, 'static' AS requested_mode, 3600000 AS duration_ms, 2 AS attempts, CASE WHEN run_id%2=0 THEN 'auto' ELSE 'unknown' END AS mode,
 CASE WHEN run_id%700 BETWEEN 100 AND 599 THEN run_id%700 ELSE 0 END AS status, least(run_id*1000,3600000) AS attempt_ms, 'at [URL omitted]' AS error FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY run_id DESC) AS n FROM runs) WHERE n<=50 AND run_id%5 IN (0,4)""",
)
def sanitize_runs(spark, folder):
    clean = RN.sanitize_runs(RN.read_runs(traced(spark, folder))).filter(F.col("trace").isNotNull())
    a = F.col("trace.attempts")[0]
    return clean.select(
        "run_id", "trace.recipe_version", "trace.requested_mode", "trace.duration_ms", F.size("trace.attempts").alias("attempts"),
        a["mode"].alias("mode"), a["status"].alias("status"), a["duration_ms"].alias("attempt_ms"), a["error"].alias("error"),
    )


# ------------------------------------------------------------------- alerts

SQL_EDGES = SQL_STREAK + """, b AS (SELECT *, lag(streak) OVER (PARTITION BY feed_id ORDER BY ended, run_id) AS before FROM streaks),
edges AS (SELECT feed_id, run_id, ended, CASE WHEN error<>'' THEN 'failing' ELSE 'recovered' END AS kind, CASE WHEN error<>'' THEN streak ELSE before END AS failures, error FROM b WHERE (error<>'' AND streak=2) OR (error='' AND before>=2))"""


@query("ST3_alert_edges", f"WITH {SQL_EDGES} SELECT feed_id, run_id, kind, failures FROM edges")
def alert_edges(spark, folder):
    return RN.alert_edges(B.runs(spark, folder), 2).select("feed_id", "run_id", "kind", "failures")


def alert_events(spark, folder):
    """Alert edges as notifier events, their times compressed so that windows fill up."""
    e = RN.alert_edges(B.runs(spark, folder), 1)
    zero = 1704067200
    return e.select(
        F.col("run_id").alias("event_id"),
        F.timestamp_seconds(F.lit(zero) + F.floor((F.unix_timestamp("ended") - zero) / 97)).alias("ts"),
        "kind",
        F.concat(F.lit("Feed "), F.col("feed_id")).alias("feed"),
        "failures",
        "error",
    )


SQL_EVENTS = SQL_STREAK + """, b AS (SELECT *, lag(streak) OVER (PARTITION BY feed_id ORDER BY ended, run_id) AS before FROM streaks),
ev AS (SELECT run_id AS event_id, 1704067200 + (ended-1704067200)//97 AS s, CASE WHEN error<>'' THEN 'failing' ELSE 'recovered' END AS kind, 'Feed ' || feed_id AS feed, CASE WHEN error<>'' THEN streak ELSE before END AS failures, error
 FROM b WHERE (error<>'' AND streak=1) OR (error='' AND before>=1))"""


def anchored_sql(source: str, width: int, partition: str) -> str:
    """First-event windows in SQL: each anchor is the first second past the previous window."""
    return f"""sec AS (SELECT DISTINCT {partition} AS g, s FROM {source}),
anc(g, s) AS (SELECT g, min(s) FROM sec GROUP BY g UNION ALL SELECT n.g, n.s FROM (SELECT a.g, (SELECT min(x.s) FROM sec x WHERE x.g=a.g AND x.s>=a.s+{width}) AS s FROM anc a) n WHERE n.s IS NOT NULL),
placed AS (SELECT e.*, (SELECT max(a.s) FROM anc a WHERE a.g=e.g AND a.s<=e.s) AS anchor FROM (SELECT *, {partition} AS g FROM {source}) e)"""


LINE = """CASE WHEN kind='failing' THEN 'Failing: ' || feed || ' - ' || CASE WHEN failures=1 THEN '1 refresh' ELSE failures || ' refreshes' END || ' in a row failed.' || CASE WHEN error<>'' THEN ' Error: ' || error ELSE '' END
 ELSE 'Recovered: ' || feed || ' - refreshed successfully after ' || CASE WHEN failures=1 THEN '1 refresh' ELSE failures || ' refreshes' END || ' in a row failed.' END"""


@query(
    "ST4_alert_batches",
    "WITH RECURSIVE " + SQL_EVENTS + ", " + anchored_sql("ev", 60, "1") + f""", p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY s, event_id) AS place FROM placed)
 SELECT anchor AS opened, count(*) AS events, least(count(*),20) AS listed, greatest(count(*)-20,0) AS more, bool_or(kind='failing') AS urgent,
 string_agg(CASE WHEN place<=20 THEN {LINE} END, chr(10) ORDER BY place) || CASE WHEN count(*)>20 THEN chr(10) || '...and ' || (count(*)-20) || ' more.' ELSE '' END AS message FROM p GROUP BY anchor""",
)
def alert_batches(spark, folder):
    return RN.alert_batches(alert_events(spark, folder))


@query("ST4_alert_batches_tumbling", f"WITH {SQL_EVENTS} SELECT s//60*60 AS opened_s, count(*) AS events, bool_or(kind='failing') AS urgent FROM ev GROUP BY 1")
def tumbling(spark, folder):
    return RN.tumbling_batches(alert_events(spark, folder))


@query(
    "ST5_alert_throttle",
    "WITH RECURSIVE " + SQL_EVENTS + ", " + anchored_sql("ev", 3600, "kind") + " SELECT kind, anchor, min(event_id) AS event_id FROM placed WHERE s=anchor GROUP BY kind, anchor",
)
def throttle(spark, folder):
    return RN.alert_throttle(alert_events(spark, folder))


# -------------------------------------------------------------------- feeds

JITTER = "('0x' || sha256(feed_id)[1:2])::BIGINT % 30"
SQL_STATUS = f"CASE WHEN NOT enabled THEN 'paused' WHEN u%13=0 THEN 'held' WHEN failures>0 THEN 'failing' WHEN last_success IS NULL THEN 'pending' WHEN {B.SQL_QUIET} THEN 'quiet' ELSE 'active' END"


def one_run_each(spark, folder):
    """The newest run of every feed."""
    newest = B.runs(spark, folder).groupBy("feed_id").agg(F.max_by(F.struct("ended", "status", "error", "run_id"), F.struct("ended", "run_id")).alias("r"))
    return newest.select("feed_id", "r.ended", "r.status", "r.error", (F.col("r.run_id") % 7 * 3000).alias("retry_after"))


@query(
    "M1_feed_state_update",
    f"""WITH {B.SQL_FEEDS}, r AS (SELECT feed_id, arg_max(run_id, (ended, run_id)) AS run_id FROM runs GROUP BY feed_id), n AS (SELECT f.*, x.ended, x.status, x.error AS run_error, x.run_id%7*3000 AS retry FROM feeds f JOIN r USING (feed_id) JOIN runs x ON x.run_id=r.run_id),
 s AS (SELECT *, run_error<>'' OR (status=304 AND last_success IS NULL) AS failed FROM n)
 SELECT feed_id, CASE WHEN failed THEN failures+1 ELSE 0 END AS failures, ended AS last_attempt, coalesce(CASE WHEN failed THEN last_success ELSE ended END,0) AS last_success,
  (ended + CASE WHEN failed THEN greatest(least((1<<least(failures+1,10)::INT)*60,86400), retry) ELSE interval_s END + {JITTER})::BIGINT AS next_run, CASE WHEN run_error<>'' THEN run_error WHEN failed THEN 'unchanged (304) before any success' ELSE '' END AS error FROM s""",
)
def feed_state(spark, folder):
    out = FD.apply_runs(B.event_feeds(spark, folder), one_run_each(spark, folder))
    return out.select("feed_id", "failures", "last_attempt", "last_success", "next_run", "error")


@query(
    "ST2_feed_state_machine",
    f"WITH {SQL_STREAK} SELECT feed_id, arg_max(streak,(ended,run_id)) AS failures, max(ended) AS last_attempt, max(CASE WHEN error='' THEN ended END) AS last_success FROM streaks GROUP BY feed_id",
)
def state_machine(spark, folder):
    """The state after replaying every run, as a batch fold."""
    return RN.current_streaks(B.runs(spark, folder))


@query("M2_quiet_feeds", f"WITH {B.SQL_FEEDS} SELECT feed_id FROM feeds WHERE {B.SQL_QUIET}")
def quiet(spark, folder):
    return FD.quiet_feeds(B.event_feeds(spark, folder), B.at(B.NOW)).select("feed_id")


@query("M3_feed_status", f"WITH {B.SQL_FEEDS} SELECT feed_id, {SQL_STATUS} AS status FROM feeds")
def status(spark, folder):
    held = F.col("feed_id").cast("long") % 13 == 0
    return B.event_feeds(spark, folder).select("feed_id", FD.feed_status(B.at(B.NOW), held).alias("status"))


@query(
    "ST8_quiet_transitions",
    f"WITH {B.SQL_FEEDS}, q AS (SELECT feed_id, {B.SQL_QUIET} AS later, {B.SQL_QUIET.replace(str(B.NOW_S), str(B.NOW_S - 3 * 86400))} AS earlier FROM feeds) SELECT feed_id, CASE WHEN later THEN 'quiet' ELSE 'resumed' END AS kind FROM q WHERE later<>earlier",
)
def quiet_transitions(spark, folder):
    return FD.quiet_transitions(B.event_feeds(spark, folder), B.at("2024-02-05 00:00:00"), B.at(B.NOW))


@query(
    "A1_library_gauges",
    f"""WITH {B.SQL_FEEDS}, {B.SQL_EVENT_ITEMS} SELECT count(*) AS feeds, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE enabled AND next_run<={NOW}) AS due, count(*) FILTER (WHERE {B.SQL_QUIET}) AS quiet, count(*) FILTER (WHERE failures>0) AS failing,
 count(*) FILTER (WHERE enabled AND failures=0 AND last_success IS NOT NULL AND NOT {B.SQL_QUIET}) AS active, (SELECT count(*) FROM eitems) AS items FROM feeds""",
)
def gauges(spark, folder):
    return FD.library_gauges(B.event_feeds(spark, folder), B.event_items(spark, folder), B.at(B.NOW))


SQL_SAMPLES = f"""SELECT feed_id, title, s.metric, s.value FROM (SELECT f.*, coalesce(i.n,0) AS items FROM feeds f LEFT JOIN (SELECT feed_id, count(*) AS n FROM eitems GROUP BY feed_id) i USING (feed_id)) f,
 LATERAL (VALUES ('feed_items', f.items), ('feed_failures', f.failures), ('feed_enabled', f.enabled::INT), ('feed_last_success_timestamp_seconds', coalesce(f.last_success,0)), ('feed_last_changed_timestamp_seconds', coalesce(f.last_changed,0)), ('feed_last_new_story_timestamp_seconds', coalesce(f.last_new,0))) s(metric, value)"""


@query(
    "K5_metrics_exposition",
    f"""WITH {B.SQL_FEEDS}, {B.SQL_EVENT_ITEMS}, smp AS ({SQL_SAMPLES}) SELECT 'newsloom_' || metric AS metric, 'newsloom_' || metric || '{{feed="' || title || '",id="' || feed_id || '"}} ' || value AS line FROM smp
 UNION ALL SELECT 'newsloom_' || m, 'newsloom_' || m || ' ' || v FROM (SELECT unnest(['feeds','feeds_enabled','feeds_due','feeds_quiet','feeds_failing','items']) AS m, unnest([count(*), count(*) FILTER (WHERE enabled), count(*) FILTER (WHERE enabled AND next_run<={NOW}), count(*) FILTER (WHERE {B.SQL_QUIET}), count(*) FILTER (WHERE failures>0), (SELECT count(*) FROM eitems)]) AS v FROM feeds)""",
)
def metrics(spark, folder):
    counts = H.items_per_feed(B.event_feeds(spark, folder), B.event_items(spark, folder))
    return render.render_metrics(B.event_feeds(spark, folder).join(counts, "feed_id"), B.at(B.NOW))


@query("T1_due_queue", f"WITH {B.SQL_FEEDS} SELECT feed_id, next_run FROM feeds WHERE enabled AND next_run<={NOW} ORDER BY next_run")
def due(spark, folder):
    return FD.due_queue(B.event_feeds(spark, folder), B.at(B.NOW)).select("feed_id", "next_run")


@query("T2_library_search_sort", f"WITH {B.SQL_FEEDS} SELECT feed_id, title FROM feeds WHERE (contains(lower(title),'d 1') OR contains('f' || feed_id || '.example.org','d 1')) AND {SQL_STATUS.replace('u%13=0', 'false')}='quiet'")
def search(spark, folder):
    return FD.library_search_sort(B.event_feeds(spark, folder), "D  1", "quiet", "failures", B.at(B.NOW)).select("feed_id", "title")


@query("T2_natural_order", f"WITH {B.SQL_FEEDS} SELECT feed_id, 'feed ' || lpad(feed_id,20,'0') AS sort_key FROM feeds")
def natural_order(spark, folder):
    """The key by which titles sort with their numbers in numeric order."""
    return B.event_feeds(spark, folder).select("feed_id", FD.natural_key(F.col("title")).alias("sort_key"))


@query(
    "S6_state_scan",
    f"WITH {B.SQL_FEEDS}, {B.SQL_EVENT_ITEMS} SELECT f.feed_id, f.title, count(i.key) AS items, CASE WHEN u%3=0 THEN '2,1' WHEN u%3=1 THEN '3' ELSE '' END AS filters FROM feeds f LEFT JOIN eitems i USING (feed_id) GROUP BY f.feed_id, f.title, u",
)
def state_scan(spark, folder):
    f = B.event_feeds(spark, folder)
    u = F.col("feed_id").cast("long")
    links = f.select("feed_id", F.posexplode(F.when(u % 3 == 0, F.array(F.lit(2), F.lit(1))).when(u % 3 == 1, F.array(F.lit(3)))).alias("position", "filter_id"))
    return FD.read_feeds(f, B.event_items(spark, folder), links).select("feed_id", "title", "items", F.array_join(F.col("filter_ids").cast("array<string>"), ",").alias("filters"))


# -------------------------------------------------------------- maintenance


@query("J6_orphans", f"WITH {B.SQL_RUNS} SELECT feed_id, count(*) AS orphans FROM runs WHERE cast(feed_id AS BIGINT)%4=0 GROUP BY feed_id")
def orphans(spark, folder):
    feeds = B.event_feeds(spark, folder).filter(F.col("feed_id").cast("long") % 4 != 0)
    return FD.drop_orphans(B.runs(spark, folder), feeds)[1].groupBy("feed_id").agg(F.count("*").alias("orphans"))


@query("M4_set_enabled", f"WITH {B.SQL_FEEDS} SELECT feed_id, CASE WHEN u%3=0 THEN u%6=0 ELSE enabled END AS enabled, CASE WHEN u%6=0 AND NOT enabled THEN {NOW} ELSE next_run END AS next_run FROM feeds")
def set_enabled(spark, folder):
    f = B.event_feeds(spark, folder)
    u = F.col("feed_id").cast("long")
    changes = f.filter(u % 3 == 0).select("feed_id", (u % 6 == 0).alias("enable"))
    return FD.set_enabled(f, changes, B.at(B.NOW)).select("feed_id", "enabled", "next_run")


def edits(spark, folder):
    f = B.event_feeds(spark, folder)
    u = F.col("feed_id").cast("long")
    e = f.filter(u % 2 == 0).select(
        "feed_id",
        F.when(u % 4 == 0, F.concat(F.col("title"), F.lit("!"))).otherwise(F.col("title")).alias("new_title"),
        F.col("url").alias("new_url"),
        (F.col("interval_s") + F.when(u % 6 == 0, 90).otherwise(30)).alias("new_interval_s"),
        F.when(u % 10 == 8, "feed").otherwise(F.col("kind")).alias("new_kind"),
    )
    return FD.apply_edits(f, e, B.at(B.NOW))


@query(
    "M5_apply_recipe_edit",
    f"""WITH {B.SQL_FEEDS}, e AS (SELECT *, u%2=0 AND u%10<>8 AS edited FROM feeds) SELECT feed_id, CASE WHEN edited AND u%4=0 THEN title || '!' ELSE title END AS title, CASE WHEN edited THEN version+1 ELSE version END AS version,
 CASE WHEN edited THEN 0 ELSE failures END AS failures, CASE WHEN edited THEN {NOW} ELSE next_run END AS next_run, coalesce(CASE WHEN edited AND (u%4=0 OR u%6=0) THEN {NOW} ELSE last_changed END,0) AS last_changed FROM e""",
)
def recipe_edit(spark, folder):
    return edits(spark, folder)[0].select("feed_id", "title", "version", "failures", "next_run", "last_changed")


@query("M5_refused_edits", f"WITH {B.SQL_FEEDS} SELECT feed_id, 'pages and feed documents are different kinds of source' AS violation FROM feeds WHERE u%2=0 AND u%10=8")
def refused_edits(spark, folder):
    return edits(spark, folder)[1]


@query("M7_filter_edit_fanout", f"WITH {B.SQL_FEEDS} SELECT feed_id, CASE WHEN u%3=1 THEN version+1 ELSE version END AS version, CASE WHEN u%3=1 THEN {NOW} ELSE next_run END AS next_run FROM feeds")
def filter_edit(spark, folder):
    f = B.event_feeds(spark, folder)
    u = F.col("feed_id").cast("long")
    links = f.select("feed_id", F.explode(F.when(u % 3 == 0, F.array(F.lit(2), F.lit(1))).when(u % 3 == 1, F.array(F.lit(3), F.lit(2)))).alias("filter_id"))
    return FD.filter_edit(f, links, [3, 9], B.at(B.NOW)).select("feed_id", "version", "next_run")


@query(
    "M8_upgrade_backfills",
    f"WITH {B.SQL_FEEDS}, {B.SQL_EVENT_ITEMS} SELECT f.feed_id, coalesce(CASE WHEN u%2=0 THEN last_changed END, last_success, 0) AS last_changed, coalesce(last_new, max(i.first_seen), 0) AS last_new FROM feeds f LEFT JOIN eitems i USING (feed_id) GROUP BY f.feed_id, u, last_changed, last_success, last_new",
)
def backfills(spark, folder):
    f = B.event_feeds(spark, folder).withColumn("last_changed", F.when(F.col("feed_id").cast("long") % 2 == 0, F.col("last_changed")))
    return FD.upgrade_backfills(f, B.event_items(spark, folder)).select("feed_id", "last_changed", "last_new")


@query(
    "M11_snapshot_audit",
    f"""WITH {B.SQL_FEEDS}, {B.SQL_EVENT_ITEMS} SELECT 'feeds' AS name, count(*) AS live_rows, count(*) AS copy_rows, 0 AS orphans, true AS ok FROM feeds
 UNION ALL SELECT 'items', count(*), count(*) FILTER (WHERE feed_id<>'3'), 0, count(*)=count(*) FILTER (WHERE feed_id<>'3') FROM eitems UNION ALL SELECT 'runs', count(*), count(*), 0, true FROM runs""",
)
def snapshot_audit(spark, folder):
    live = {"feeds": B.event_feeds(spark, folder), "items": B.event_items(spark, folder), "runs": B.runs(spark, folder)}
    copy = dict(live, items=live["items"].filter(F.col("feed_id") != "3"))
    return FD.audit_snapshot(live, copy)


# ------------------------------------------------------------------ recipes


def recipe_documents(spark, folder):
    """Recipe files of twenty feeds each, made from the customers; some carry mistakes."""
    c = B.table(spark, folder, "customer")
    k = F.col("c_custkey")
    feed = F.concat(
        F.lit('{"title":"'), F.col("c_name"), F.lit('","url":"https://c.example/'), k.cast("string"), F.lit('","interval":'), F.when(k % 17 == 0, "null").otherwise((k % 1000 * 60).cast("string")),
        F.lit(',"recipe":{"type":"'), F.when(k % 7 == 0, "xpath").otherwise("css"), F.lit('","items":"nav li'), F.when(k % 19 == 0, "[").otherwise(""), F.lit('","title":{"selector":"'), F.when(k % 11 == 0, "").otherwise("a"),
        F.lit('"},"timezone":"'), F.when(k % 13 == 0, "Mars/Base").otherwise("Europe/Paris"), F.lit('","quiet_days":'), F.when(k % 5 == 0, "8").otherwise("7"), F.lit("}}"),
    )
    docs = c.groupBy(F.floor(k / 20).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", feed.alias("x")))), lambda s: s["x"]), ",").alias("body"))
    d = F.col("doc_id") % 6
    return docs.select(
        "doc_id",
        F.concat(F.lit('{"format":"'), F.when(d == 1, "other").otherwise(RC.FORMAT), F.lit('","version":'), F.when(d == 2, "2").otherwise("1"), F.when(d == 3, ',"extra":1').otherwise(""), F.lit(',"feeds":['), F.col("body"), F.lit("]}"), F.when(d == 4, " {}").otherwise("")).alias("value"),
    )


@query(
    "S2_recipes_scan",
    """WITH c AS (SELECT c_custkey//20 AS doc_id, row_number() OVER (PARTITION BY c_custkey//20 ORDER BY c_custkey) - 1 AS n, c_name AS title, CASE WHEN c_custkey%17<>0 THEN c_custkey%1000*60 END AS interval_s FROM customer)
 SELECT doc_id, n, title, interval_s, false AS enabled, CAST(NULL AS VARCHAR) AS error FROM c WHERE doc_id%6 IN (0,5)
 UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, false, CASE doc_id%6 WHEN 1 THEN 'another format' WHEN 2 THEN 'another version of the format' WHEN 3 THEN 'unknown field extra' ELSE 'the file is not one JSON document' END FROM c WHERE doc_id%6 NOT IN (0,5)""",
)
def recipes_scan(spark, folder):
    rows = RC.explode_feeds(RC.recipe_feeds(recipe_documents(spark, folder)), ["doc_id"])
    return rows.select("doc_id", "n", "title", "interval_s", "enabled", "error")


def mistaken_documents(spark, folder):
    """One feed a file, from the customers: sound, with an unknown key inside a field, with text for a number, with an unknown side of the filters."""
    k = F.col("c_custkey")
    recipe = (
        F.when(k % 4 == 1, '{"type":"css","items":"li","title":{"selector":"a","foo":"b"}}')
        .when(k % 4 == 2, '{"type":"css","items":"li","title":{"selector":"a"},"settle_ms":"zz"}')
        .when(k % 4 == 3, '{"type":"css","items":"li","title":{"selector":"a"},"filters":{"only":{"op":"any"}}}')
        .otherwise('{"type":"css","items":"li","title":{"selector":"a"},"settle_ms":20}')
    )
    feed = F.concat(F.lit('{"title":"'), F.col("c_name"), F.lit('","url":"https://c.example/","interval":60,"recipe":'), recipe, F.lit("}"))
    customers = B.by_rows(B.table(spark, folder, "customer").select("c_custkey", "c_name"), 5000, "c_custkey")
    return customers.select(k.alias("doc_id"), F.concat(F.lit(f'{{"format":"{RC.FORMAT}","version":1,"feeds":['), feed, F.lit("]}")).alias("value"))


@query(
    "S2_recipe_mistakes",
    """SELECT c_custkey AS doc_id, CASE c_custkey%4 WHEN 1 THEN 'unknown field title.foo' WHEN 2 THEN 'a value of another type than its field''s' WHEN 3 THEN 'unknown field filters.only' END AS error FROM customer""",
)
def recipe_mistakes(spark, folder):
    return RC.recipe_feeds(mistaken_documents(spark, folder)).select("doc_id", "error")


@query(
    "M9_recipe_contents",
    """SELECT 'c' || c_custkey AS feed_id, CASE WHEN c_custkey%8 IN (1,2,3,4) THEN 'selector' ELSE 'filters' END AS rule,
 CASE c_custkey%8 WHEN 5 THEN 'operator' WHEN 6 THEN 'depth' WHEN 7 THEN 'keyword text' ELSE '' END AS message FROM customer WHERE c_custkey%8<>0""",
)
def recipe_contents(spark, folder):
    """Selectors that can't be read and filters that can't be applied, one of each kind by the customer's number."""
    k = F.col("c_custkey")
    deep = '{"op":"all","rules":[' * 9 + '{"op":"contains_any","field":"title","keywords":["x"]}' + "]}" * 9
    items = F.when(k % 8 == 1, "li >").when(k % 8 == 2, "li:nope").when(k % 8 == 3, "//li[@a").when(k % 8 == 4, "li:nth-child(x)").otherwise("li:has(a), ul > li:not(.ad)")
    rule = F.when(k % 8 == 5, '{"op":"bogus"}').when(k % 8 == 6, deep).when(k % 8 == 7, '{"op":"contains_any","field":"link","keywords":[" "]}').otherwise('{"op":"contains_any","field":"link","keywords":["x"]}')
    text = F.concat(
        F.lit(f'{{"format":"{RC.FORMAT}","version":1,"feeds":[{{"title":"t","url":"https://c.example/","interval":60,"recipe":{{"type":"'), F.when(k % 8 == 3, "xpath").otherwise("css"),
        F.lit('","items":"'), items, F.lit('","title":{"selector":"'), F.when(k % 8 == 3, ".//a").otherwise("a"), F.lit('"},"filters":{"include":'), rule, F.lit("}}}]}"),
    )
    customers = B.by_rows(B.table(spark, folder, "customer").select("c_custkey"), 5000, "c_custkey")
    docs = customers.select(F.concat(F.lit("c"), k.cast("string")).alias("doc_id"), text.alias("value"))
    rows = RC.explode_feeds(RC.recipe_feeds(docs), ["doc_id"]).withColumnRenamed("doc_id", "feed_id")
    found = RC.lint_contents(rows)
    return found.select("feed_id", "rule", F.when(F.col("rule") == "filters", F.col("message")).otherwise("").alias("message"))


@query(
    "M9_recipe_lint",
    """WITH c AS (SELECT c_custkey AS k, c_custkey//20 AS doc_id FROM customer), v AS (SELECT k, unnest([CASE WHEN k%17=0 OR k%1000=0 OR k%1000*60>604800 THEN 'interval' END, CASE WHEN k%19=0 THEN 'selector' END, CASE WHEN k%11=0 THEN 'required' END, CASE WHEN k%13=0 THEN 'zone' END, CASE WHEN k%5=0 THEN 'quiet' END, CASE WHEN k%7=0 AND k%11<>0 THEN 'relative' END]) AS rule FROM c WHERE doc_id%6 IN (0,5))
 SELECT 'https://c.example/' || k AS feed_id, rule FROM v WHERE rule IS NOT NULL""",
)
def recipe_lint(spark, folder):
    rows = RC.explode_feeds(RC.recipe_feeds(recipe_documents(spark, folder)), ["doc_id"]).filter(F.col("error").isNull())
    return RC.lint_recipes(rows.withColumn("feed_id", F.col("url")), RC.known_zones(spark)).select("feed_id", "rule")


@query(
    "M10_leftover_selector_lint",
    """SELECT 'f' || c_custkey AS feed_id, 'content' AS field, CASE WHEN c_custkey%8=0 THEN 'warned' ELSE 'refused' END AS action FROM customer WHERE c_custkey%4<3""",
)
def leftover_lint(spark, folder):
    c = B.table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("feed_id"), F.lit("content").alias("field"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("c"), k.cast("string"))
    new = c.withColumn(
        "selector",
        F.when(k % 4 == 0, ".summary").when(k % 4 == 1, F.concat(F.lit(".//h2 "), name)).when(k % 4 == 2, F.concat(F.lit("//div, //"), name)).otherwise(F.concat(F.lit(".//div[@class='a, b c' and "), name, F.lit("] | ./p[1]"))),
    )
    stored = c.withColumn("selector", F.when(k % 8 == 0, " .summary ").otherwise(".//p"))
    return RC.lint_leftovers(new, stored)


def _export_sql() -> str:
    from newsloom.plans.q_history import _combined_sql, _sql_text

    combined = _combined_sql()
    head = _sql_text('{"format":"newsloom.recipes","version":1,"feeds":[')
    return f"""WITH e AS ({combined}), l AS (SELECT e.feed_id, '{{"title":"News & views: ' || e.feed_id || '","url":"https://' || e.feed_id || '/news?a=1&b=2","interval":' || length(e.feed_id)*60 || ',"recipe":{{"mode":"static","type":"css","items":"nav li","filters":{{' || concat_ws(',', '"include":' || include, '"exclude":' || exclude) || '}}}}}}' AS x FROM e)
 SELECT CASE WHEN count(*)<=1000 THEN sha256({head} || string_agg(x, ',' ORDER BY feed_id) || ']}}') END AS digest, CASE WHEN count(*)>1000 THEN 'too many or too large for one file' END AS failure FROM l""".replace("']}}'", "']}'")


@query("K4_recipe_export", _export_sql())
def recipe_export(spark, folder):
    """Feeds with their effective rules as one portable document."""
    from newsloom.operators import rulesets as RS
    from newsloom.plans.q_history import OWN, filter_tables

    feeds, links, filters = filter_tables(spark, folder)
    own = feeds.select("feed_id", F.lit(None).cast("string").alias("own_include"), F.lit(OWN).alias("own_exclude"))
    effective = RS.effective_filters(own, links, filters.drop("name"))
    full = feeds.join(effective, "feed_id").select("feed_id", "title", "url", "interval_s", F.lit("static").alias("mode"), F.lit("css").alias("type"), F.lit("nav li").alias("items"), "include", "exclude")
    return RC.export_recipes(full).select(F.sha2(F.encode("doc", "UTF-8"), 256).alias("digest"), "failure")




@query(
    "K4_export_round_trip",
    """WITH c AS (SELECT c_custkey AS k, c_custkey//20 AS doc_id, c_name FROM customer)
 SELECT c_name AS title, 'https://c.example/' || k AS url, CASE WHEN k%17<>0 THEN k%1000*60 END AS interval_s, CASE WHEN k%7=0 THEN 'xpath' ELSE 'css' END AS type, 'nav li' || CASE WHEN k%19=0 THEN '[' ELSE '' END AS items,
  CASE WHEN k%11=0 THEN '' ELSE 'a' END AS title_selector, CASE WHEN k%13=0 THEN 'Mars/Base' ELSE 'Europe/Paris' END AS timezone, CASE WHEN k%5=0 THEN 8 ELSE 7 END AS quiet_days,
  CASE WHEN k%3=0 THEN '{"field":"title","keywords":["' || c_name || '"],"op":"contains_any"}' END AS exclude FROM c WHERE doc_id%6 IN (0,5)""",
)
def export_round_trip(spark, folder):
    """Imported recipes, with rules added to some, exported to files and read again."""
    rows = RC.explode_feeds(RC.recipe_feeds(recipe_documents(spark, folder)), ["doc_id"]).filter(F.col("error").isNull())
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    rule = F.concat(F.lit('{"op":"contains_any","field":"title","keywords":["'), F.col("title"), F.lit('"]}'))
    feeds = rows.select(F.col("url").alias("feed_id"), "title", "url", "interval_s", "recipe", F.lit(None).cast("string").alias("include"), F.when(k % 3 == 0, rule).alias("exclude"))
    again = RC.explode_feeds(RC.recipe_feeds(RC.export_recipe_files(feeds, 50), "doc"), ["file"])
    r = F.col("recipe")
    return again.select(
        "title", "url", "interval_s", r["type"].alias("type"), r["items"].alias("items"), r["title"]["selector"].alias("title_selector"), r["timezone"].alias("timezone"), r["quiet_days"].alias("quiet_days"),
        F.to_json(r["filters"]["exclude"]).alias("exclude"),
    )
