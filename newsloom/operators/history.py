"""A feed's stored history: merge, identity, retention, change detection, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.markup import FILTER_BLOCKS, with_visible_text
from newsloom.functions.rules import RuleSet, decide
from newsloom.functions.text import readable
from newsloom.operators.groups import top_n

# Default and largest retained history per feed.
MAX_ITEMS = 500
PRUNE_LIMIT = 10000

ITEM_COLUMNS = (
    "feed_id", "key", "guid", "title", "url", "html", "image", "content_full", "published", "first_seen", "last_seen", "last_changed",
)


def story_guid(feed_id: Column, key: Column) -> Column:
    return F.concat(F.lit("urn:sha256:"), F.sha2(F.concat(F.encode(feed_id, "UTF-8"), F.lit(b"\x00"), F.encode(key, "UTF-8")), 256))


def change_time(last_changed: Column, now: Column) -> Column:
    """Now, or one second past the previous change when that is not earlier."""
    return F.when(last_changed >= now, last_changed + F.expr("interval 1 second")).otherwise(now)


def drop_stale(batch: DataFrame, feeds: DataFrame) -> DataFrame:
    """Results built with the feed's current recipe version; stale and deleted ones are dropped whole."""
    return batch.join(feeds.select("feed_id", "version"), ["feed_id", "version"], "left_semi")


def merge_items(items: DataFrame, batch: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Upsert a batch into the history; every merged row says what happened to it.

    Both sides are hashed by (feed_id, key), which is unique on each, so a feed with
    any number of stories spreads over all tasks.
    """
    # ``now`` may be a column of the feed row, so each feed can be merged at its own time.
    change = feeds.select("feed_id", change_time(F.col("last_changed"), now).alias("_at"), now.alias("_now"))
    now = F.col("_now")
    fresh = batch.select(
        "feed_id",
        "key",
        *[readable(c).alias(f"_{c}") for c in ("title", "url", "html", "image", "content_full")],
        F.date_trunc("second", "published").alias("_published"),
        F.lit(True).alias("_new"),
    ).join(change, "feed_id")
    old = items.withColumn("_old", F.lit(True))
    both = old.join(fresh, ["feed_id", "key"], "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    touched_body = (F.col("_content_full") != "") & (F.col("_content_full") != F.col("content_full"))
    differs = (
        (F.col("title") != F.col("_title"))
        | (F.col("url") != F.col("_url"))
        | (F.col("html") != F.col("_html"))
        | (F.col("image") != F.col("_image"))
        | touched_body
    )

    def replaced(name: str) -> Column:
        return F.when(is_new, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    body = F.when(~is_new, F.col("content_full")).when(is_old & (F.col("_content_full") == ""), F.col("content_full")).otherwise(F.col("_content_full"))
    moved = (
        F.when(~is_new, F.col("last_changed"))
        .when(~is_old | differs, F.col("_at"))
        .otherwise(F.coalesce("last_changed", "last_seen"))
    )
    return both.select(
        "feed_id",
        "key",
        F.when(is_old, F.col("guid")).otherwise(story_guid(F.col("feed_id"), F.col("key"))).alias("guid"),
        replaced("title"),
        replaced("url"),
        replaced("html"),
        replaced("image"),
        body.alias("content_full"),
        F.when(is_old, F.col("published")).otherwise(F.coalesce("_published", now)).alias("published"),
        F.when(is_old, F.col("first_seen")).otherwise(now).alias("first_seen"),
        F.when(is_new, now).otherwise(F.col("last_seen")).alias("last_seen"),
        moved.alias("last_changed"),
        (is_new & ~is_old).alias("inserted"),
        (is_new & is_old & differs).alias("changed"),
    )


def item_order() -> list[Column]:
    """Newest first, then key in byte order."""
    return [F.col("published").desc(), F.col("key").asc()]


def retain_items(items: DataFrame, n: int = MAX_ITEMS) -> DataFrame:
    return top_n(items, ["feed_id"], item_order(), n, ["key"])


def retention_except(items: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored stories that retention removes."""
    return items.join(kept.select("feed_id", "key"), ["feed_id", "key"], "left_anti")


def change_summary(merged: DataFrame, kept: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Per refreshed feed: inserted, changed, removed, whether output moved, and the new times."""
    flags = merged.select("feed_id", "key", "inserted", "changed").join(
        kept.select("feed_id", "key", F.lit(True).alias("kept")), ["feed_id", "key"], "left"
    )
    gone = F.col("kept").isNull()
    per_feed = flags.groupBy("feed_id").agg(
        F.count_if(F.col("inserted") & ~gone).alias("inserted"),
        F.count_if(F.col("changed") & ~gone).alias("changed"),
        F.count_if(gone).alias("removed"),
        F.count_if(gone & ~F.col("inserted")).alias("removed_published"),
    )
    state = feeds.select("feed_id", F.col("last_changed").alias("_was"), F.col("last_new").alias("_new"), now.alias("_now"))
    now = F.col("_now")
    # A first success publishes a document even without stories.
    moved = (F.col("inserted") > 0) | (F.col("changed") > 0) | (F.col("removed_published") > 0) | F.col("_was").isNull()
    return per_feed.join(state, "feed_id").select(
        "feed_id",
        "inserted",
        "changed",
        "removed",
        moved.alias("output_changed"),
        F.when(moved, change_time(F.col("_was"), now)).otherwise(F.col("_was")).alias("last_changed"),
        F.when(F.col("inserted") > 0, now).otherwise(F.col("_new")).alias("last_new"),
    )


def listed_items(items: DataFrame) -> DataFrame:
    """Stories the latest merge listed: last_seen equals the feed's newest."""
    newest = items.groupBy("feed_id").agg(F.max("last_seen").alias("_newest"))
    return items.join(newest, "feed_id").filter(F.col("last_seen") >= F.col("_newest")).drop("_newest")


def items_per_feed(feeds: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("feed_id").agg(F.count("*").alias("items"))
    return feeds.select("feed_id").join(counts, "feed_id", "left").select("feed_id", F.coalesce("items", F.lit(0)).alias("items"))


def last_new_backfill(feeds: DataFrame, items: DataFrame) -> DataFrame:
    newest = items.groupBy("feed_id").agg(F.max("first_seen").alias("last_new"))
    return feeds.select("feed_id").join(newest, "feed_id", "left")


def with_description(items: DataFrame) -> DataFrame:
    """Stored markup's readable text for description rules; parsed once, only where needed."""
    return with_visible_text(items, "html", "description", FILTER_BLOCKS)


def apply_filter(items: DataFrame, rules: RuleSet, description: str = "description") -> DataFrame:
    """Stories with the reason they are dropped, NULL when kept."""
    text = F.col(description) if description in items.columns else F.lit("")
    return items.withColumn("reason", decide(rules, F.col("title"), text, F.col("url")))


def prune_history(items: DataFrame, rules: RuleSet, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) stories under the rules.

    With a limit, feeds with a longer history keep it whole; ``refused_prunes`` lists them.
    """
    judged = apply_filter(items, rules)
    if limit is not None:
        refused = refused_prunes(items, limit).select("feed_id", F.lit(True).alias("_refused"))
        judged = judged.join(refused, "feed_id", "left").withColumn("reason", F.when(F.col("_refused").isNull(), F.col("reason"))).drop("_refused")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def refused_prunes(items: DataFrame, limit: int = PRUNE_LIMIT) -> DataFrame:
    """Feeds whose history is too long to prune in one edit, with its length."""
    return items.groupBy("feed_id").agg(F.count("*").alias("items")).filter(F.col("items") > limit)


def pruned_feeds(feeds: DataFrame, removed: DataFrame, now: Column) -> DataFrame:
    """Feeds whose published stories a prune removed get a new change time."""
    hit = removed.select("feed_id").distinct().withColumn("_hit", F.lit(True))
    moved = F.when(F.col("_hit").isNotNull(), change_time(F.col("last_changed"), now)).otherwise(F.col("last_changed"))
    return feeds.join(hit, "feed_id", "left").withColumn("last_changed", moved).drop("_hit")


def clear_bodies(items: DataFrame, edits: DataFrame, runs: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Items after recipe edits discard article bodies.

    edits(feed_id, scope) with scope 'all' | 'listed'. Listed bodies are kept when the newest
    run that read the page stored nothing.
    """
    reading = latest_reading_counts(runs)
    newest = items.groupBy("feed_id").agg(F.max("last_seen").alias("_newest"))
    state = (
        edits.join(newest, "feed_id", "left")
        .join(reading, "feed_id", "left")
        .join(feeds.select("feed_id", change_time(F.col("last_changed"), now).alias("_at")), "feed_id")
    )
    joined = items.join(state, "feed_id", "left")
    listed = (F.col("scope") == "listed") & ~F.coalesce(F.col("_count") == 0, F.lit(False)) & (F.col("last_seen") >= F.col("_newest"))
    clear = F.coalesce(((F.col("scope") == "all") | listed) & (F.col("content_full") != ""), F.lit(False))
    return joined.select(
        *[c for c in items.columns if c not in ("content_full", "last_changed")],
        F.when(clear, F.lit("")).otherwise(F.col("content_full")).alias("content_full"),
        F.when(clear, F.col("_at")).otherwise(F.col("last_changed")).alias("last_changed"),
        clear.alias("cleared"),
    )


def latest_reading_counts(runs: DataFrame) -> DataFrame:
    """Story count of each feed's newest run that read its page."""
    read = (F.col("status") != 304) & (F.col("error") == "")
    return runs.filter(read).groupBy("feed_id").agg(F.max_by("count", "run_id").alias("_count"))


def body_scope(was: Column, new: Column) -> Column:
    """Which bodies an edit discards: 'all', 'listed' or 'keep', from the two recipe structs
    (full_selector, full_attr, remove, kind; full_selector NULL when the feature is off)."""
    on_was, on_new = was["full_selector"].isNotNull(), new["full_selector"].isNotNull()
    block = (was["full_selector"] != new["full_selector"]) | (was["full_attr"] != new["full_attr"])
    trimmed = (new["full_attr"] == "") & (
        (was["remove"] != new["remove"]) | ((F.size(new["remove"]) > 0) & (was["kind"] != new["kind"]))
    )
    return (
        F.when(on_was != on_new, "all").when(~on_was, "keep").when(block, "all").when(trimmed, "listed").otherwise("keep")
    )
