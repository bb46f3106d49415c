"""Feed rows: state after runs, health, queues, edits and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import fold, fold_text
from newsloom.functions.urls import url_host
from newsloom.operators.history import change_time

DAY = 86400
# Quiet thresholds, in seconds.
QUIET_FLOOR = 14 * DAY
QUIET_INTERVALS = 10
QUIET_MARGIN = 3600


def seconds(value: Column) -> Column:
    return F.unix_timestamp(value)


def jitter(feed_id: Column) -> Column:
    """0 to 29 seconds, stable per feed."""
    return F.conv(F.substring(F.sha2(F.encode(feed_id, "UTF-8"), 256), 1, 2), 16, 10).cast("int") % 30


def backoff(failures: Column, retry_after: Column) -> Column:
    """Seconds until the next try after ``failures`` in a row."""
    doubled = F.least(F.pow(F.lit(2), F.least(failures, F.lit(10))).cast("long") * 60, F.lit(DAY))
    return F.greatest(doubled, F.coalesce(retry_after, F.lit(0)))


def apply_runs(feeds: DataFrame, runs: DataFrame) -> DataFrame:
    """Feed rows after one run each: runs(feed_id, ended, status, error, retry_after)."""
    never = F.col("last_success").isNull()
    failed = (F.col("run_error") != "") | ((F.col("status") == 304) & never)
    message = F.when(F.col("run_error") != "", F.col("run_error")).otherwise("unchanged (304) before any success")
    joined = feeds.join(
        runs.select("feed_id", "ended", "status", F.col("error").alias("run_error"), "retry_after"), "feed_id", "left"
    )
    ran = F.col("ended").isNotNull()
    failures = F.when(failed, F.col("failures") + 1).otherwise(0)
    delay = F.when(failed, backoff(failures, F.col("retry_after"))).otherwise(F.col("interval_s"))
    due = F.timestamp_seconds(seconds(F.col("ended")) + delay + jitter(F.col("feed_id")))
    new = {
        "last_attempt": F.col("ended"),
        "last_success": F.when(failed, F.col("last_success")).otherwise(F.col("ended")),
        "next_run": due,
        "error": F.when(failed, message).otherwise(""),
        "failures": failures,
    }
    return joined.select(*[F.when(ran, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in feeds.columns])


def quiet_threshold(quiet_days: Column, interval_s: Column) -> Column:
    """Seconds without a new story that make a feed quiet; NULL for never."""
    return (
        F.when(quiet_days == -1, F.lit(None).cast("long"))
        .when(quiet_days > 0, F.greatest(quiet_days.cast("long") * DAY, interval_s.cast("long") + QUIET_MARGIN))
        .otherwise(F.greatest(F.lit(QUIET_FLOOR).cast("long"), interval_s.cast("long") * QUIET_INTERVALS))
    )


def is_quiet(now: Column) -> Column:
    since = F.coalesce("last_new", "last_changed")
    steady = (
        F.col("enabled")
        & (F.col("failures") == 0)
        & F.col("last_success").isNotNull()
        & F.col("last_changed").isNotNull()
        & (F.col("last_attempt").isNull() | (F.col("last_success") >= F.col("last_attempt")))
    )
    waited = seconds(now) - seconds(since) >= quiet_threshold(F.col("quiet_days"), F.col("interval_s"))
    return F.coalesce(steady & waited, F.lit(False))


def quiet_feeds(feeds: DataFrame, now: Column) -> DataFrame:
    return feeds.filter(is_quiet(now))


def feed_status(now: Column, held: Column | None = None) -> Column:
    """First match of paused, held, failing, pending, quiet, active."""
    held = F.lit(False) if held is None else held
    return (
        F.when(~F.col("enabled"), "paused")
        .when(held, "held")
        .when(F.col("failures") > 0, "failing")
        .when(F.col("last_success").isNull(), "pending")
        .when(is_quiet(now), "quiet")
        .otherwise("active")
    )


def is_due(now: Column) -> Column:
    return F.col("enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= now))


def due_queue(feeds: DataFrame, now: Column) -> DataFrame:
    return feeds.filter(is_due(now)).orderBy(F.col("next_run").asc_nulls_first(), "feed_id")


def library_gauges(feeds: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """One row of library counts; both sides are plain aggregates, so nothing is joined by feed."""
    counts = feeds.agg(
        F.count("*").alias("feeds"),
        F.count_if("enabled").alias("enabled"),
        F.count_if(is_due(now)).alias("due"),
        F.count_if(is_quiet(now)).alias("quiet"),
        F.count_if(F.col("failures") > 0).alias("failing"),
        F.count_if(feed_status(now) == "active").alias("active"),
    )
    stored = items.agg(F.count("*").alias("items"))
    both = counts.select(F.lit(1).alias("one"), "*").join(stored.select(F.lit(1).alias("one"), "items"), "one")
    return both.drop("one")


def natural_key(value: Column) -> Column:
    """Case-folded sort key in which digit runs order by number."""
    padded = F.regexp_replace(fold(value), "(\\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "0*(\\d{20})(?!\\d)", "$1")


SORTS = {
    "title": lambda: [],
    "next_run": lambda: [F.when(F.col("enabled"), F.col("next_run")).asc_nulls_last()],
    "last_success": lambda: [F.col("last_success").asc_nulls_first()],
    "last_changed": lambda: [F.col("last_changed").asc_nulls_first()],
    "failures": lambda: [F.col("failures").desc()],
}


def library_search_sort(feeds: DataFrame, query: str = "", status: str | None = None, sort: str = "title", now: Column | None = None) -> DataFrame:
    """Feeds whose folded title or host contains the query, in the chosen order."""
    out = feeds
    if query:
        needle = F.lit(fold_text(query))
        out = out.filter(F.contains(fold("title"), needle) | F.contains(fold(url_host("url")), needle))
    if status is not None:
        out = out.filter(feed_status(now) == status)
    return out.orderBy(*SORTS[sort](), natural_key(F.col("title")), "title", "feed_id")


def set_enabled(feeds: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes(feed_id, enable): resuming a paused feed makes it due; all else stays."""
    joined = feeds.join(changes, "feed_id", "left")
    resumed = F.coalesce(F.col("enable") & ~F.col("enabled"), F.lit(False))
    new = {
        "next_run": F.when(resumed, now).otherwise(F.col("next_run")),
        "enabled": F.coalesce("enable", "enabled"),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in feeds.columns])


def apply_edits(feeds: DataFrame, edits: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(feeds after edits, refused edits). edits(feed_id, new_title, new_url, new_interval_s, new_kind)."""
    joined = feeds.join(edits, "feed_id", "left")
    edited = F.col("new_title").isNotNull()
    switched = edited & ((F.col("kind") == "feed") != (F.col("new_kind") == "feed"))
    refused = joined.filter(switched).select("feed_id", F.lit("pages and feed documents are different kinds of source").alias("violation"))
    applies = edited & ~switched
    published = (
        (F.col("title") != F.col("new_title"))
        | (F.col("url") != F.col("new_url"))
        | (F.floor(F.col("interval_s") / 60) != F.floor(F.col("new_interval_s") / 60))
    )
    new = {
        "title": F.col("new_title"),
        "url": F.col("new_url"),
        "interval_s": F.col("new_interval_s"),
        "kind": F.col("new_kind"),
        "next_run": now,
        "error": F.lit(""),
        "failures": F.lit(0),
        "version": F.col("version") + 1,
        "last_changed": F.when(published, change_time(F.col("last_changed"), now)).otherwise(F.col("last_changed")),
    }
    after = joined.select(*[F.when(applies, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in feeds.columns])
    return after, refused


def filter_edit(feeds: DataFrame, links: DataFrame, filter_ids: list[int], now: Column) -> DataFrame:
    """Feeds using an edited library filter get a new version and are due now."""
    users = links.filter(F.col("filter_id").isin(*filter_ids)).select("feed_id", F.lit(True).alias("_uses")).distinct()
    joined = feeds.join(users, "feed_id", "left")
    uses = F.col("_uses").isNotNull()
    new = {"version": F.col("version") + 1, "next_run": now}
    return joined.select(*[F.when(uses, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in feeds.columns])


def upgrade_backfills(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Older rows: change time from the last success, newest story time from the items."""
    newest = items.groupBy("feed_id").agg(F.max("first_seen").alias("_newest"))
    joined = feeds.join(newest, "feed_id", "left")
    new = {"last_changed": F.coalesce("last_changed", "last_success"), "last_new": F.coalesce("last_new", "_newest")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in feeds.columns])


def drop_orphans(rows: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of live feeds, rows whose feed is gone)."""
    live = feeds.select("feed_id")
    return rows.join(live, "feed_id", "left_semi"), rows.join(live, "feed_id", "left_anti")


def read_feeds(feeds: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """Feeds with their story count and filter ids in link order, by title and id."""
    counts = items.groupBy("feed_id").agg(F.count("*").alias("items"))
    used = links.groupBy("feed_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "filter_id"))), lambda s: s["filter_id"]).alias("filter_ids")
    )
    return (
        feeds.join(counts, "feed_id", "left")
        .join(used, "feed_id", "left")
        .withColumn("items", F.coalesce("items", F.lit(0)))
        .withColumn("filter_ids", F.coalesce("filter_ids", F.array().cast("array<int>")))
        .orderBy("title", "feed_id")
    )


def audit_snapshot(live: dict[str, DataFrame], copy: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows and content digest of both sides, and rows of missing feeds in the copy."""
    parts = []
    for name, frame in live.items():
        other = copy[name]
        sides = [f.select(F.lit(side).alias("side"), F.xxhash64(*sorted(frame.columns)).alias("h")) for side, f in ((0, frame), (1, other))]
        # Equal rows are counted, so that two of a kind can't stand for two of another.
        per_row = sides[0].unionByName(sides[1]).groupBy("h").agg(F.count_if(F.col("side") == 0).alias("live"), F.count_if(F.col("side") == 1).alias("copy"))
        counted = per_row.agg(
            F.coalesce(F.sum("live"), F.lit(0)).alias("live_rows"),
            F.coalesce(F.sum("copy"), F.lit(0)).alias("copy_rows"),
            F.count_if(F.col("live") != F.col("copy")).alias("difference"),
        )
        if name == "feeds":
            orphans = counted.select(F.lit(0).cast("long").alias("orphans"))
        else:
            orphans = other.join(copy["feeds"].select("feed_id"), "feed_id", "left_anti").agg(F.count("*").alias("orphans"))
        row = counted.select(F.lit(name).alias("name"), "*").join(orphans.select(F.lit(name).alias("name"), "orphans"), "name")
        parts.append(
            row.select(
                "name",
                "live_rows",
                "copy_rows",
                "orphans",
                ((F.col("live_rows") == F.col("copy_rows")) & (F.col("difference") == 0) & (F.col("orphans") == 0)).alias("ok"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def quiet_transitions(feeds: DataFrame, before: Column, now: Column) -> DataFrame:
    """Feeds that crossed into or out of quiet between two times."""
    out = feeds.select("feed_id", is_quiet(before).alias("was"), is_quiet(now).alias("is"))
    return out.filter(F.col("was") != F.col("is")).select("feed_id", F.when(F.col("is"), "quiet").otherwise("resumed").alias("kind"))
