"""The library's tables derived from the given ones, in Spark and in SQL side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import unescape_html
from newsloom.operators.history import MAX_ITEMS, merge_items, retain_items

NOW = "2024-02-08 00:00:00"
FIRST, SECOND = "2024-02-01 00:00:00", "2024-02-02 00:00:00"
HOST = "^https?://([^/?#]+)"
CARD = '<li><a href="([^"]*)">([^<]*)</a></li>'
ARTICLE = "(?s)<article>(.*)</article>"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before page parsing: a single small file would otherwise be one task."""
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism, *keys) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by key to tasks of about ``rows`` each, before a step that widens or multiplies them.

    At most 200 tasks: up to there a shuffle is written without holding rows in memory.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1)
    return df.repartition(min(tasks, 200), *keys)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select(
        "page_id",
        F.regexp_extract("url", HOST, 1).alias("feed_id"),
        "url",
        F.when(F.col("page_id") % 11 == 0, 304).when(F.col("page_id") % 13 == 0, 500).otherwise(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "html",
        F.timestamp_seconds(F.lit(1706745600) + F.col("page_id") * 60).alias("captured_at"),
    )


SQL_CAPTURES = """captures AS (
 SELECT page_id, regexp_extract(url,'^https?://([^/?#]+)',1) AS feed_id, url, html,
  CASE WHEN page_id % 11 = 0 THEN 304 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS status,
  1706745600 + page_id * 60 AS captured_s FROM pages)"""

SQL_NAV = """nav0 AS (
 SELECT page_id, regexp_extract(url,'^https?://([^/?#]+)',1) AS feed_id, url,
  regexp_extract_all(html,'<li><a href="([^"]*)">([^<]*)</a></li>',1) AS hrefs,
  regexp_extract_all(html,'<li><a href="([^"]*)">([^<]*)</a></li>',2) AS titles FROM pages),
nav AS (SELECT page_id, feed_id, url, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(titles) AS title FROM nav0),
cards AS (SELECT *, regexp_extract(url,'^https?://[^/?#]+') || replace(replace(url_encode(href),'%2F','/'),'%2C',',') AS link FROM nav)"""


def unescape_sql(value: str) -> str:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        value = f"replace({value},'{old}','{new}')"
    return value


def escape_sql(value: str) -> str:
    for old, new in (("&", "&amp;"), ("''", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        value = f"replace({value},'{old}','{new}')"
    for code, new in ((9, "&#x9;"), (10, "&#xA;"), (13, "&#xD;")):
        value = f"replace({value},chr({code}),'{new}')"
    return value


H1_SQL = unescape_sql("regexp_extract(html,'<h1>(.*?)</h1>',1)")


def batch(spark: SparkSession, folder: str, which: str) -> DataFrame:
    """Items as one refresh lists them: 'old' or 'new'."""
    p = table(spark, folder, "pages")
    title = unescape_html(F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    n = F.col("page_id")
    address = F.regexp_replace("url", "#.*$", "")
    if which == "new":
        # A third of the pages moved, so the new listing has stories that are new and lacks some that are stored.
        title = F.when(n % 4 == 0, F.concat(title, F.lit(" (updated)"))).otherwise(title)
        address = F.when(n % 3 == 0, F.concat(address, F.lit("-moved"))).otherwise(address)
    listed = p.select(
        "page_id",
        F.regexp_extract("url", HOST, 1).alias("feed_id"),
        address.alias("key"),
        title.alias("title"),
        address.alias("url"),
        F.regexp_extract("html", ARTICLE, 1).alias("html"),
        F.when(n % 4 == 1, F.concat(F.lit("https://img.example.org/"), n.cast("string"), F.lit(".png"))).otherwise("").alias("image"),
        F.when(n % 6 == 0, F.concat(F.lit("<p>Full "), n.cast("string"), F.lit("</p>"))).otherwise("").alias("content_full"),
        F.when(n % 5 != 0, F.timestamp_seconds(F.lit(1704067200) + n * 3600)).alias("published"),
    )
    # Captures that differ only in their fragment are one story; the first page wins.
    rest = [c for c in listed.columns if c not in ("feed_id", "key")]
    first = listed.groupBy("feed_id", "key").agg(F.min_by(F.struct(*rest), "page_id").alias("s"))
    return first.select("feed_id", "key", "s.*")


def _batch_sql(name: str, title: str, address: str) -> str:
    return f"""{name} AS (
 SELECT page_id, regexp_extract(url,'^https?://([^/?#]+)',1) AS feed_id, {address} AS key, {title} AS title,
  {address} AS url, regexp_extract(html,'(?s)<article>(.*)</article>',1) AS html,
  CASE WHEN page_id % 4 = 1 THEN 'https://img.example.org/' || page_id || '.png' ELSE '' END AS image,
  CASE WHEN page_id % 6 = 0 THEN '<p>Full ' || page_id || '</p>' ELSE '' END AS content_full,
  CASE WHEN page_id % 5 <> 0 THEN 1704067200 + page_id * 3600 END AS published FROM (SELECT *, url AS page_url FROM pages)
 QUALIFY row_number() OVER (PARTITION BY regexp_extract(page_url,'^https?://([^/?#]+)',1), {address.replace("url,", "page_url,")} ORDER BY page_id)=1)"""


ADDRESS_SQL = "regexp_replace(url,'#.*$','')"


SQL_BATCHES = (
    _batch_sql("batch_old", H1_SQL, ADDRESS_SQL)
    + ",\n"
    + _batch_sql("batch_new", f"CASE WHEN page_id % 4 = 0 THEN {H1_SQL} || ' (updated)' ELSE {H1_SQL} END", f"{ADDRESS_SQL} || CASE WHEN page_id % 3 = 0 THEN '-moved' ELSE '' END")
)

T1, T2 = 1706745600, 1706832000
SQL_STORED = (
    SQL_BATCHES
    + f""",
stored AS (
 SELECT feed_id, key, 'urn:sha256:' || sha256(feed_id || chr(0) || key) AS guid, title, url, html, image, content_full,
  coalesce(published,{T1}) AS published, {T1} AS first_seen, {T1} AS last_seen, {T1} AS last_changed FROM batch_old)"""
)
SQL_MERGED = (
    SQL_STORED
    + f""",
merged AS (
 SELECT coalesce(o.feed_id,n.feed_id) AS feed_id, coalesce(o.key,n.key) AS key,
  coalesce(o.guid,'urn:sha256:' || sha256(n.feed_id || chr(0) || n.key)) AS guid,
  coalesce(n.title,o.title) AS title, coalesce(n.url,o.url) AS url, coalesce(n.html,o.html) AS html, coalesce(n.image,o.image) AS image,
  CASE WHEN n.key IS NULL THEN o.content_full WHEN o.key IS NOT NULL AND n.content_full = '' THEN o.content_full ELSE n.content_full END AS content_full,
  coalesce(o.published,n.published,{T2}) AS published, coalesce(o.first_seen,{T2}) AS first_seen,
  CASE WHEN n.key IS NULL THEN o.last_seen ELSE {T2} END AS last_seen,
  CASE WHEN n.key IS NULL THEN o.last_changed
   WHEN o.key IS NULL OR o.title<>n.title OR o.url<>n.url OR o.html<>n.html OR o.image<>n.image OR (n.content_full<>'' AND n.content_full<>o.content_full) THEN {T2}
   ELSE o.last_changed END AS last_changed,
  o.key IS NULL AS inserted,
  o.key IS NOT NULL AND n.key IS NOT NULL AND (o.title<>n.title OR o.url<>n.url OR o.html<>n.html OR o.image<>n.image OR (n.content_full<>'' AND n.content_full<>o.content_full)) AS changed
 FROM stored o FULL OUTER JOIN batch_new n ON o.feed_id=n.feed_id AND o.key=n.key)"""
)


def host_feeds(spark: SparkSession, folder: str, changed: str | None = FIRST) -> DataFrame:
    """One feed row per host of the pages."""
    hosts = table(spark, folder, "pages").select(F.regexp_extract("url", HOST, 1).alias("feed_id")).distinct()
    when = at(changed) if changed else F.lit(None).cast("timestamp")
    return hosts.select(
        "feed_id",
        F.concat(F.lit("News & views: "), F.col("feed_id")).alias("title"),
        F.concat(F.lit("https://"), F.col("feed_id"), F.lit("/news?a=1&b=2")).alias("url"),
        F.lit("css").alias("kind"),
        (F.length("feed_id") * 60).alias("interval_s"),
        when.alias("last_changed"),
        when.alias("last_new"),
        at(SECOND).alias("last_success"),
        F.lit(1).alias("version"),
    )


SQL_HOSTS = """hosts AS (SELECT DISTINCT regexp_extract(url,'^https?://([^/?#]+)',1) AS feed_id FROM pages)"""


def empty_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "feed_id string, key string, guid string, title string, url string, html string, image string, content_full string, "
        "published timestamp, first_seen timestamp, last_seen timestamp, last_changed timestamp",
    )


def stored_items(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_items(empty_items(spark), batch(spark, folder, "old"), host_feeds(spark, folder, None), at(FIRST))
    return merged.drop("inserted", "changed")


def merged_items(spark: SparkSession, folder: str) -> DataFrame:
    return merge_items(stored_items(spark, folder), batch(spark, folder, "new"), host_feeds(spark, folder), at(SECOND))


def kept_items(spark: SparkSession, folder: str, n: int = MAX_ITEMS) -> DataFrame:
    return retain_items(merged_items(spark, folder), n)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("feed_id"),
        F.col("event_id").alias("run_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ended"),
        F.when(kind == "error", "failed").otherwise("").alias("error"),
        F.when(kind == "view", 304).when(kind == "error", 500).otherwise(200).alias("status"),
        (F.floor("value") % 7).alias("count"),
        "props",
        kind.alias("kind"),
    )


SQL_RUNS = """runs AS (
 SELECT cast(user_id AS VARCHAR) AS feed_id, event_id AS run_id, cast(floor(epoch(ts)) AS BIGINT) AS ended,
  CASE WHEN event_type='error' THEN 'failed' ELSE '' END AS error,
  CASE WHEN event_type='view' THEN 304 WHEN event_type='error' THEN 500 ELSE 200 END AS status,
  cast(floor(value) AS BIGINT) % 7 AS count, props, event_type AS kind FROM events)"""


def event_feeds(spark: SparkSession, folder: str) -> DataFrame:
    r = runs(spark, folder)
    u = F.col("feed_id").cast("long")
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("ended")))
    grouped = r.groupBy("feed_id").agg(
        F.max("ended").alias("last_attempt"),
        F.max(F.when(F.col("error") == "", F.col("ended"))).alias("last_success"),
        last("purchase", "click").alias("last_changed"),
        last("purchase").alias("last_new"),
    )
    return grouped.select(
        "feed_id",
        F.concat(F.lit("Feed "), F.col("feed_id")).alias("title"),
        F.concat(F.lit("https://f"), F.col("feed_id"), F.lit(".example.org/news")).alias("url"),
        F.when(u % 10 == 3, "feed").otherwise("css").alias("kind"),
        (900 * (1 + u % 4)).cast("int").alias("interval_s"),
        (u % 9 != 0).alias("enabled"),
        F.element_at(F.array(*[F.lit(v) for v in (0, -1, 7, 30)]), (u % 4 + 1).cast("int")).alias("quiet_days"),
        F.when(u % 6 == 0, 2).otherwise(0).alias("failures"),
        F.timestamp_seconds(F.unix_timestamp("last_attempt") + 900 * (1 + u % 4) * (u % 3) * 96).alias("next_run"),
        "last_attempt",
        # Every other feed's newest attempt counts as its success, so health varies.
        F.when(u % 2 == 0, F.col("last_attempt")).otherwise(F.col("last_success")).alias("last_success"),
        "last_changed",
        F.when(u % 7 != 0, F.col("last_new")).alias("last_new"),
        F.lit("").alias("error"),
        (1 + u % 3).cast("int").alias("version"),
    )


SQL_FEEDS = (
    SQL_RUNS
    + """,
feeds0 AS (SELECT feed_id, cast(feed_id AS BIGINT) AS u, max(ended) AS last_attempt, max(CASE WHEN error='' THEN ended END) AS ok,
  max(CASE WHEN kind IN ('purchase','click') THEN ended END) AS last_changed, max(CASE WHEN kind='purchase' THEN ended END) AS bought FROM runs GROUP BY feed_id),
feeds AS (SELECT feed_id, u, 'Feed ' || feed_id AS title, 'https://f' || feed_id || '.example.org/news' AS url,
  CASE WHEN u%10=3 THEN 'feed' ELSE 'css' END AS kind, 900*(1+u%4) AS interval_s, u%9<>0 AS enabled,
  CASE u%4 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 7 ELSE 30 END AS quiet_days, CASE WHEN u%6=0 THEN 2 ELSE 0 END AS failures,
  last_attempt + 900*(1+u%4)*(u%3)*96 AS next_run, last_attempt, CASE WHEN u%2=0 THEN last_attempt ELSE ok END AS last_success,
  last_changed, CASE WHEN u%7<>0 THEN bought END AS last_new, '' AS error, 1+u%3 AS version FROM feeds0)"""
)
NOW_S = 1707350400
SQL_QUIET = f"""(enabled AND failures=0 AND last_success IS NOT NULL AND last_changed IS NOT NULL AND last_success>=last_attempt AND quiet_days<>-1
 AND {NOW_S} - coalesce(last_new,last_changed) >= CASE WHEN quiet_days>0 THEN greatest(quiet_days*86400, interval_s+3600) ELSE greatest(1209600, 10*interval_s) END)"""


def event_items(spark: SparkSession, folder: str) -> DataFrame:
    """Stories of the event feeds: every purchase is a new one."""
    return runs(spark, folder).filter(F.col("kind") == "purchase").select(
        "feed_id",
        F.concat(F.lit("k"), F.col("run_id").cast("string")).alias("key"),
        F.col("ended").alias("first_seen"),
        F.date_trunc("day", "ended").alias("last_seen"),
        F.timestamp_seconds(F.unix_timestamp("ended") - F.unix_timestamp("ended") % 7200).alias("published"),
    )


SQL_EVENT_ITEMS = """eitems AS (SELECT feed_id, 'k' || run_id AS key, ended AS first_seen, ended - ended % 86400 AS last_seen, ended - ended % 7200 AS published FROM runs WHERE kind='purchase')"""


def library_filters(spark: SparkSession) -> dict[int, dict]:
    """Four named library filters; a feed links to some of them by its id."""
    return {
        1: {"include": {"op": "any", "rules": [{"op": "contains_any", "field": "title", "keywords": ["the", "de"]}, {"op": "contains_any", "field": "link", "keywords": ["/en/"]}]}},
        2: {"exclude": {"op": "contains_any", "field": "title", "keywords": ["spam", "que"]}},
        3: {"include": {"op": "contains_all", "field": "description", "keywords": ["of", "on"]}, "exclude": {"op": "any", "rules": [{"op": "contains_any", "field": "link", "keywords": ["/es/"]}]}},
        4: {"exclude": {"op": "all", "rules": [{"op": "contains_any", "field": "title", "keywords": ["un"]}, {"op": "contains_any", "field": "link", "keywords": ["/fr/", "/de/"]}]}},
    }
