"""Streaming operators driven over the given tables as files that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import recipe_table as RT
from newsloom.plans import bindings as B
from newsloom.plans.refresh import FRONT
from newsloom.plans.registry import query
from newsloom.session import shared_folder
from newsloom.sources import captures
from newsloom.streaming import composed, keyed, timers
from newsloom.streaming.alerts import EdgeStream
from newsloom.streaming.refresh import RefreshStream, run_available


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run's state and checkpoint."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a file stream; its schema is known, so nothing is inferred while streaming."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "64").parquet(f"{folder}/{name}*.parquet")


def capture_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stream_table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("url", B.HOST, 1).alias("feed_id"),
        "url",
        F.lit(200).alias("status"),
        "html",
        F.timestamp_seconds(F.lit(B.T1) + F.col("page_id") * 60).alias("captured_at"),
    )


SQL_LISTED = f"""WITH {B.SQL_NAV}, l AS (SELECT feed_id, link AS key, {B.T1}+page_id*60 AS t FROM cards WHERE NOT contains(lower(title),'the'))"""


@query("S9_captures_stream", "SELECT page_id, url, sha256(html) AS digest FROM pages")
def captures_stream(spark, folder):
    """Every capture once, by the digest of its body."""
    root = scratch(spark, "captures")
    schema = spark.read.parquet(f"{folder}/pages.parquet").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("page_id", "url", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest")).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    run_available(captures.captures_stream(spark, f"{folder}/pages*.parquet", schema), keep, f"{root}/checkpoint")
    return spark.read.schema("page_id long, url string, digest string").parquet(f"{root}/out").select("page_id", "url", "digest")


@query(
    "ST1_refresh_stream",
    SQL_LISTED + " SELECT feed_id, key, min(t) AS published, min(t) AS first_seen, max(t) AS last_seen, min(t) AS last_changed FROM l GROUP BY feed_id, key",
)
def refresh_stream(spark, folder):
    """All captures of a feed in capture order, through the streaming handler's state."""
    root = scratch(spark, "refresh")
    handler = RefreshStream(spark, f"{root}/state", FRONT, 1000000)
    run_available(capture_stream(spark, folder), lambda d, i: handler(B.spread(d), i), f"{root}/checkpoint")
    return handler.items().select("feed_id", "key", "published", "first_seen", "last_seen", "last_changed")


@query(
    "ST3_alert_edges_stream",
    """WITH runs AS (SELECT cast(user_id AS VARCHAR) AS feed_id, event_id AS run_id, cast(floor(epoch(ts)) AS BIGINT) AS ended, CASE WHEN event_type='error' THEN 'failed' ELSE '' END AS error FROM events),
 isl AS (SELECT *, sum(CASE WHEN error='' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING) AS island FROM runs),
 s AS (SELECT *, sum(CASE WHEN error<>'' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, island ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM isl),
 b AS (SELECT *, lag(streak) OVER (PARTITION BY feed_id ORDER BY ended, run_id) AS before FROM s)
 SELECT feed_id, run_id, CASE WHEN error<>'' THEN 'failing' ELSE 'recovered' END AS kind FROM b WHERE (error<>'' AND streak=3) OR (error='' AND before>=3)""",
)
def edges_stream(spark, folder):
    root = scratch(spark, "edges")
    handler = EdgeStream(spark, f"{root}/state", 3)
    stream = stream_table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("feed_id"),
        F.col("event_id").alias("run_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ended"),
        F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"),
    )
    run_available(stream, handler, f"{root}/checkpoint")
    return handler.edges().select("feed_id", "run_id", "kind")


@query(
    "ST2_feed_state_stream",
    f"""WITH {B.SQL_RUNS}, o AS (SELECT *, run_id%7*3000 AS retry, bool_or(error='' AND status<>304) OVER (PARTITION BY feed_id ORDER BY ended, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM runs),
 f AS (SELECT *, error<>'' OR (status=304 AND NOT coalesce(had,false)) AS failed FROM o),
 i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
 s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, island ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures, max(CASE WHEN NOT failed THEN ended END) OVER (PARTITION BY feed_id) AS ok FROM i)
 SELECT feed_id, failures, ended AS last_attempt, coalesce(ok,0) AS last_success,
  (ended + CASE WHEN failed THEN greatest(least((1<<least(failures,10)::INT)*60,86400), retry) ELSE 900*(1+cast(feed_id AS BIGINT)%4) END + ('0x' || sha256(feed_id)[1:2])::BIGINT % 30)::BIGINT AS next_run,
  CASE WHEN error<>'' THEN error WHEN failed THEN 'unchanged (304) before any success' ELSE '' END AS error
 FROM s QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY ended DESC, run_id DESC)=1""",
)
def feed_state_stream(spark, folder):
    """Every run of the events in three deliveries by time, through the keyed state of its feed."""
    u = F.col("feed_id").cast("long")
    rows = B.runs(spark, folder).select("feed_id", "run_id", "ended", "status", "error", (F.col("run_id") % 7 * 3000).alias("retry_after"), (900 * (1 + u % 4)).alias("interval_s"))
    first, second = rows.select(F.unix_timestamp("ended").alias("s")).approxQuantile("s", [0.33, 0.66], 0.01)
    s = F.unix_timestamp("ended")
    out = keyed.run_slices(spark, [rows.filter(s <= first), rows.filter((s > first) & (s <= second)), rows.filter(s > second)], keyed.feed_states, scratch(spark, "feed-states"))
    latest = out.groupBy("feed_id").agg(F.max_by(F.struct("failures", "last_attempt", "last_success", "next_run", "error"), "batch").alias("x"))
    return latest.select("feed_id", "x.*")


@query(
    "ST10_story_stream",
    f"WITH {B.SQL_MERGED} SELECT feed_id, key, 0 AS batch, 'new' AS kind FROM batch_old UNION ALL SELECT feed_id, key, 1, CASE WHEN inserted THEN 'new' ELSE 'changed' END FROM merged WHERE inserted OR changed",
)
def story_stream(spark, folder):
    """The old listing, the new one and the new one again: what each publishes."""

    def listing(which: str, at: str) -> DataFrame:
        # Bodies fetched apart count only where there is one, as in a merge.
        rows = B.batch(spark, folder, which)
        return rows.select("feed_id", "key", F.sha2(F.encode(F.concat_ws("|", "title", "url", "html", "image"), "UTF-8"), 256).alias("digest"), F.lit(at).cast("timestamp").alias("at"))

    slices = [listing("old", B.FIRST), listing("new", B.SECOND), listing("new", B.NOW)]
    return keyed.run_slices(spark, slices, keyed.story_changes, scratch(spark, "stories")).select("feed_id", "key", "batch", "kind")


def deliveries(rows: DataFrame, moment: str, count: int = 3) -> list[DataFrame]:
    """The rows in so many deliveries by time."""
    s = F.unix_timestamp(moment)
    cuts = rows.select(s.alias("s")).approxQuantile("s", [k / count for k in range(1, count)], 0.01)
    bounds = [None, *cuts, None]
    between = lambda a, b: (F.lit(True) if a is None else s > a) & (F.lit(True) if b is None else s <= b)
    return [rows.filter(between(a, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


GAP, SILENCE = 3600, 1800


@query(
    "ST5_outage_stream",
    f"""WITH RECURSIVE ev AS (SELECT DISTINCT event_type || '-' || user_id%7 AS kind, cast(floor(epoch(ts)) AS BIGINT) AS s FROM events),
 first AS (SELECT kind, min(s) AS s FROM ev GROUP BY kind),
 sent AS (SELECT kind, s FROM first UNION ALL SELECT a.kind, (SELECT min(e.s) FROM ev e WHERE e.kind=a.kind AND e.s>=a.s+{GAP}) AS s FROM sent a WHERE EXISTS (SELECT 1 FROM ev e WHERE e.kind=a.kind AND e.s>=a.s+{GAP})),
 g AS (SELECT kind, s, CASE WHEN s >= lag(s) OVER (PARTITION BY kind ORDER BY s) + {SILENCE} THEN 1 ELSE 0 END AS opens FROM ev),
 i AS (SELECT kind, s, sum(opens) OVER (PARTITION BY kind ORDER BY s) AS island FROM g),
 o AS (SELECT i.kind, island, max(i.s) AS last, count(sent.s) AS announced FROM i LEFT JOIN sent ON sent.kind=i.kind AND sent.s=i.s GROUP BY i.kind, island)
 SELECT kind, s AS at, 'sent' AS event FROM sent UNION ALL
 SELECT kind, last + {SILENCE}, 'closed' FROM o WHERE announced>0 AND (last + {SILENCE})*1000 <= (SELECT max(epoch_ms(ts)) FROM events)""",
)
def outage_stream(spark, folder):
    """Events of 35 kinds in three deliveries: what is sent, and the end of every outage once its kind stays silent."""
    events = B.table(spark, folder, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    timers.with_state_store(spark)
    out = keyed.run_slices(spark, deliveries(events, "ts"), lambda d: timers.outages(d, GAP, SILENCE), scratch(spark, "outages"))
    return out.select("kind", "at", "event")


@query(
    "ST8_quiet_stream",
    f"""WITH {B.SQL_RUNS}, t AS (SELECT *, CASE cast(feed_id AS BIGINT)%4 WHEN 0 THEN 1209600 WHEN 2 THEN greatest(86400, 900*3+3600) WHEN 3 THEN greatest(3*86400, 900*4+3600) END AS thr FROM runs),
 s AS (SELECT *, coalesce(max(CASE WHEN error='' AND kind='purchase' THEN ended END) OVER w, min(CASE WHEN error='' THEN ended END) OVER w) AS started,
  lead(ended) OVER (PARTITION BY feed_id ORDER BY ended, run_id) AS after FROM t WINDOW w AS (PARTITION BY feed_id ORDER BY ended, run_id ROWS UNBOUNDED PRECEDING)),
 q AS (SELECT *, error='' AND coalesce(ended - started >= thr, false) AS quiet FROM s),
 p AS (SELECT feed_id, ended AS "at", run_id, 0 AS turn, quiet FROM q
  UNION ALL SELECT feed_id, started + thr, run_id, 1, true FROM q WHERE error='' AND NOT quiet AND started + thr < after
  UNION ALL SELECT feed_id, started + thr, run_id, 1, true FROM q WHERE error='' AND NOT quiet AND after IS NULL AND (started + thr)*1000 <= (SELECT max(epoch_ms(ts)) FROM events)),
 l AS (SELECT *, lag(quiet, 1, false) OVER (PARTITION BY feed_id ORDER BY run_id_at, turn) AS was FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY first_at, run_id, turn) AS run_id_at FROM
  (SELECT p.*, min("at") OVER (PARTITION BY feed_id, run_id) AS first_at FROM p)))
 SELECT feed_id, "at", CASE WHEN quiet THEN 'quiet' ELSE 'resumed' END AS event FROM l WHERE quiet<>was""",
)
def quiet_stream(spark, folder):
    """All runs in three deliveries; crossings with and without an event are those that M2 gives at every moment."""
    u = F.col("feed_id").cast("long")
    days = F.element_at(F.array(*[F.lit(d) for d in (0, -1, 1, 3)]), (u % 4 + 1).cast("int"))
    exact = B.table(spark, folder, "events").select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("moment"))
    rows = B.runs(spark, folder).join(exact, "run_id").select(
        "feed_id", "run_id", F.col("moment").alias("ended"), "error", (F.col("kind") == "purchase").alias("new_story"), (900 * (1 + u % 4)).cast("int").alias("interval_s"), days.alias("quiet_days")
    )
    timers.with_state_store(spark)
    return keyed.run_slices(spark, deliveries(rows, "ended"), timers.quiet_stream, scratch(spark, "quiet")).select("feed_id", "at", "event")


SQL_TRIES = f"""WITH RECURSIVE {B.SQL_RUNS}, d AS (SELECT feed_id, ended - ended%86400 AS "at", 'k' || run_id%5 AS key, max(run_id) AS run_id FROM runs GROUP BY 1, 2, 3),
 mid AS (SELECT min("at") + (max("at") - min("at"))//2 AS m FROM d),
 tries AS (SELECT d.feed_id, d."at", d.key, d.run_id, CASE WHEN d."at" > m AND d.run_id%9<>0 THEN 2 ELSE 1 END AS version, d.run_id%2=0 AS kept,
  CASE kind WHEN 'error' THEN 'fault' WHEN 'view' THEN 'deferred' WHEN 'purchase' THEN 'stored' END AS outcome FROM d JOIN runs USING (run_id), mid),
 v AS (SELECT *, max(version) OVER (PARTITION BY feed_id ORDER BY "at") AS current FROM tries)"""


def article_tries(spark, folder):
    """A refresh a feed and day lists up to five stories; the recipe changes half way, and some late results still use the old one."""
    r = B.runs(spark, folder).withColumn("at", F.date_trunc("day", "ended")).withColumn("key", F.concat(F.lit("k"), (F.col("run_id") % 5).cast("string")))
    last = r.groupBy("feed_id", "at", "key").agg(F.max_by(F.struct("run_id", "kind"), "run_id").alias("r")).select("feed_id", "at", "key", "r.*")
    first, final = last.agg(F.min(F.unix_timestamp("at")), F.max(F.unix_timestamp("at"))).first()
    half = first + (final - first) // 2
    outcome = F.when(F.col("kind") == "error", "fault").when(F.col("kind") == "view", "deferred").when(F.col("kind") == "purchase", "stored")
    edited = (F.unix_timestamp("at") > half) & (F.col("run_id") % 9 != 0)
    return last.select("feed_id", "key", F.when(edited, 2).otherwise(1).alias("version"), outcome.alias("outcome"), (F.col("run_id") % 2 == 0).alias("kept"), "at")


def memory_changes(spark, folder):
    timers.with_state_store(spark)
    return keyed.run_slices(spark, deliveries(article_tries(spark, folder), "at"), timers.article_memory_stream, scratch(spark, "memory"))


@query(
    "ST6_article_memory_stream",
    SQL_TRIES
    + """, n AS (SELECT *, dense_rank() OVER (PARTITION BY feed_id ORDER BY "at") AS turn FROM v WHERE version=current),
 m AS (SELECT feed_id, key, turn, "at", version, outcome, kept, NULL::BIGINT AS tried, 0 AS count, NULL::BIGINT AS retry, false AS unkept, false AS has FROM n WHERE false
  UNION ALL SELECT feed_id, key, turn, "at", version, outcome, kept, x.tried, x.count, x.retry, x.unkept, x.has FROM (
   SELECT n.feed_id, n.key, n.turn, n."at", n.version, n.outcome, n.kept,
    CASE WHEN n.outcome IS NULL THEN {'tried': NULL, 'count': NULL, 'retry': NULL, 'unkept': NULL, 'has': false}
     WHEN n.outcome='stored' AND n.kept THEN {'tried': NULL, 'count': NULL, 'retry': NULL, 'unkept': NULL, 'has': false}
     WHEN n.outcome='stored' THEN {'tried': n."at", 'count': 0, 'retry': NULL, 'unkept': true, 'has': true}
     WHEN n.outcome='fault' THEN {'tried': n."at", 'count': 1, 'retry': n."at"+3600, 'unkept': false, 'has': true}
     ELSE {'tried': n."at", 'count': 0, 'retry': NULL, 'unkept': false, 'has': true} END AS x
   FROM n ANTI JOIN n p ON p.feed_id=n.feed_id AND p.key=n.key AND p.turn=n.turn-1 AND p.version=n.version)
  UNION ALL SELECT feed_id, key, turn, "at", version, outcome, kept, x.tried, x.count, x.retry, x.unkept, x.has FROM (
   SELECT n.feed_id, n.key, n.turn, n."at", n.version, n.outcome, n.kept,
    CASE WHEN n.outcome IS NULL THEN {'tried': m.tried, 'count': m.count, 'retry': m.retry, 'unkept': m.unkept, 'has': m.has}
     WHEN n.outcome='stored' AND n.kept THEN {'tried': NULL, 'count': NULL, 'retry': NULL, 'unkept': NULL, 'has': false}
     WHEN n.outcome='stored' THEN {'tried': n."at", 'count': 0, 'retry': NULL, 'unkept': true, 'has': true}
     WHEN n.outcome='fault' AND (NOT m.has OR m.retry IS NULL OR m.retry<=n."at") THEN
      {'tried': n."at", 'count': coalesce(m.count,0)+1, 'retry': n."at" + least(3600*(1<<greatest(least(coalesce(m.count,0),5),0)::INT),86400), 'unkept': false, 'has': true}
     ELSE {'tried': n."at", 'count': coalesce(m.count,0), 'retry': m.retry, 'unkept': false, 'has': true} END AS x
   FROM m JOIN n ON n.feed_id=m.feed_id AND n.key=m.key AND n.turn=m.turn+1 AND n.version=m.version)),
 z AS (SELECT feed_id, max(turn) AS turn FROM n GROUP BY feed_id)
 SELECT feed_id, key, version, tried, count, coalesce(retry,0) AS retry, unkept FROM m JOIN z USING (feed_id, turn) WHERE has""",
)
def article_memory_stream(spark, folder):
    """Every day's tries in three deliveries: what is remembered of the stories at the end."""
    after = timers.memory_after(memory_changes(spark, folder))
    return after.withColumn("retry", F.coalesce("retry", F.lit(0)))


@query("ST9_late_results_stream", SQL_TRIES + " SELECT feed_id, count(*) AS late FROM v WHERE version<current GROUP BY feed_id")
def late_results_stream(spark, folder):
    """Results of an old recipe that arrive after a newer one's are dropped and counted."""
    late = memory_changes(spark, folder).filter(F.col("event") == "late")
    return late.groupBy("feed_id").agg(F.sum("rows").alias("late"))


HALF = "(SELECT max(page_id)//2 FROM pages)"
SQL_COMPOSED = f"""WITH {B.SQL_NAV}, c AS (SELECT page_id, regexp_extract(url,'^https?://([^/?#]+)',1) AS feed_id, {B.T1}+page_id*60 AS t,
  CASE WHEN page_id%11=0 THEN 304 WHEN page_id%13=0 THEN 500 ELSE 200 END AS status, CASE WHEN page_id > {HALF} AND page_id%17<>0 THEN 2 ELSE 1 END AS version FROM pages),
 fresh AS (SELECT * FROM c WHERE version = CASE WHEN page_id > {HALF} THEN 2 ELSE 1 END),
 k0 AS (SELECT n.feed_id, n.page_id, n.pos, n.link AS key, f.t, f.version, CASE WHEN f.version=2 THEN n.href ELSE n.title END AS title FROM cards n JOIN fresh f USING (page_id) WHERE f.status=200 AND (f.version=1 OR n.pos>0)),
 k1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY pos) AS nth FROM k0),
 valid AS (SELECT page_id, count(*) AS n FROM k0 GROUP BY page_id),
 l AS (SELECT * FROM k1 WHERE nth=1 AND CASE length(feed_id)%3 WHEN 0 THEN true WHEN 1 THEN NOT contains(lower(title),'the') ELSE contains(lower(key),'a') END),
 r AS (SELECT f.*, CASE WHEN status=500 THEN 1 WHEN status=200 AND n IS NULL THEN 1 WHEN status=304 AND NOT coalesce(bool_or(status=200 AND n IS NOT NULL) OVER (PARTITION BY feed_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 1 ELSE 0 END AS failed
  FROM fresh f LEFT JOIN valid USING (page_id)),
 s AS (SELECT *, lag(title) OVER (PARTITION BY feed_id, key ORDER BY t) AS was, row_number() OVER (PARTITION BY feed_id, key ORDER BY t) AS nth_listing FROM l),
 moved AS (SELECT *, nth_listing=1 AS inserted, nth_listing>1 AND was<>title AS changed FROM s)"""


def composed_captures(spark, folder):
    """All captures, two recipe versions, and the edits between them; a few results still come from the old recipe."""
    c = B.captures(spark, folder).drop("content_type")
    half = c.agg(F.max("page_id")).first()[0] // 2
    version = F.when((F.col("page_id") > half) & (F.col("page_id") % 17 != 0), 2).otherwise(1)
    edits = c.filter(F.col("page_id") > half).select("feed_id").distinct().select("feed_id", F.lit(2).alias("version"), F.timestamp_seconds(F.lit(B.T1 + half * 60 + 30)).alias("at"), F.lit(3600).alias("interval_s"))
    return c.withColumn("version", version).withColumn("interval_s", F.lit(3600)), edits


def composed_recipes(spark, folder):
    """Two recipes a feed, with rules of three kinds by its name."""
    hosts = B.table(spark, folder, "pages").select(F.regexp_extract("url", B.HOST, 1).alias("feed_id")).distinct()
    the = '{"op":"contains_any","field":"title","keywords":["the"]}'
    a = '{"op":"contains_any","field":"link","keywords":["a"]}'
    k = F.length("feed_id") % 3
    rows = hosts.select("feed_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), F.when(k == 1, the).alias("exclude"), F.when(k == 2, a).alias("include"))
    later = F.col("version") == 2
    values = {
        "kind": F.lit("css"), "items": F.when(later, "nav li:not(:first-child)").otherwise("nav li"), "title": F.lit("a"), "title_attr": F.when(later, "href").otherwise(""),
        "link": F.lit("a"), "timezone": F.lit("UTC"), "remove": F.array().cast("array<string>"),
    }
    return RT.compile_recipes(rows.select(*[F.col(f.name) if f.name in rows.columns else values.get(f.name, F.lit("")).alias(f.name) for f in RT.RECIPES]))


def composed_changes(spark, folder):
    """Captures and edits in three deliveries by time."""
    captured, edits = composed_captures(spark, folder)
    timers.with_state_store(spark)
    recipes = composed_recipes(spark, folder).cache()
    asks = RT.used(recipes)
    kinds = captured.select(F.lit("capture").alias("row"), "*").unionByName(edits.select(F.lit("edit").alias("row"), "feed_id", "version", F.col("at").alias("captured_at"), "interval_s"), allowMissingColumns=True)

    def changes(arrived: DataFrame) -> DataFrame:
        listings = composed.read_listings(arrived.filter(F.col("row") == "capture"), recipes, asks)
        edited = composed.edit_rows(arrived.filter(F.col("row") == "edit").withColumnRenamed("captured_at", "at"))
        return composed.refresh_changes(listings.unionByName(edited))

    return keyed.run_slices(spark, deliveries(kinds, "captured_at"), changes, scratch(spark, "composed"))


@query(
    "ST1_composed_items",
    SQL_COMPOSED
    + """ SELECT feed_id, key, arg_max(title, t) AS title, min(t) AS published, min(t) AS first_seen, max(t) AS last_seen, max(CASE WHEN inserted OR changed THEN t END) AS last_changed FROM moved GROUP BY feed_id, key
 QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY min(t) DESC, encode(key)) <= 500""",
)
def composed_items(spark, folder):
    """The histories after three deliveries: recipe versions, rules by feed, failures, unchanged pages, retention."""
    return composed.items_after(composed_changes(spark, folder)).select("feed_id", "key", "title", "published", "first_seen", "last_seen", "last_changed")


@query(
    "ST1_composed_feeds",
    SQL_COMPOSED
    + f""", e AS (SELECT feed_id, {B.T1}+{HALF}*60+30 AS t FROM c WHERE page_id > {HALF} GROUP BY feed_id),
 p AS (SELECT feed_id, t, failed FROM r UNION ALL SELECT feed_id, t, 0 FROM e),
 streak AS (SELECT feed_id, count(*) FILTER (WHERE failed=1 AND t > last_ok)::BIGINT AS failures FROM (SELECT *, coalesce(max(CASE WHEN failed=0 THEN t END) OVER (PARTITION BY feed_id), 0) AS last_ok FROM p) GROUP BY feed_id),
 x AS (SELECT feed_id, max(t) AS last_attempt, max(CASE WHEN failed=0 THEN t END) AS last_success, min(CASE WHEN failed=0 THEN t END) AS first_ok FROM r GROUP BY feed_id),
 y AS (SELECT feed_id, max(CASE WHEN inserted OR changed THEN t END) AS moved, max(CASE WHEN inserted THEN t END) AS last_new FROM moved GROUP BY feed_id),
 feeds AS (SELECT feed_id FROM c UNION SELECT feed_id FROM e),
 first200 AS (SELECT r.feed_id, min(t) AS t FROM r WHERE failed=0 AND status=200 GROUP BY r.feed_id)
 SELECT feed_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.feed_id=feeds.feed_id) THEN 2 ELSE 1 END AS version, coalesce(failures,0) AS failures, coalesce(last_attempt,0) AS last_attempt, coalesce(last_success,0) AS last_success,
  coalesce(greatest(moved, first200.t),0) AS last_changed, coalesce(last_new,0) AS last_new, coalesce(n.stale,0)::BIGINT AS stale
 FROM feeds LEFT JOIN streak USING (feed_id) LEFT JOIN x USING (feed_id) LEFT JOIN y USING (feed_id) LEFT JOIN first200 USING (feed_id)
  LEFT JOIN (SELECT feed_id, count(*) AS stale FROM c ANTI JOIN fresh USING (page_id) GROUP BY feed_id) n USING (feed_id)""",
)
def composed_feeds(spark, folder):
    """The feed rows after three deliveries, and how many results of the old recipe were refused."""
    changes = composed_changes(spark, folder)
    stale = changes.filter(F.col("kind") == "stale").groupBy("feed_id").agg(F.count("*").alias("stale"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return composed.feeds_after(changes).join(stale, "feed_id", "left").select("feed_id", "version", *[zero(c) for c in ("failures", "last_attempt", "last_success", "last_changed", "last_new", "stale")])
