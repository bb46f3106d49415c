"""Continuous refresh: captures arrive, histories, feed rows and runs follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import extract, history
from newsloom.operators.extract import Recipe
from newsloom.operators.feeds import apply_runs
from newsloom.streaming.state import StateTables

ITEMS = (
    "feed_id string, key string, guid string, title string, url string, html string, image string, content_full string, "
    "published timestamp, first_seen timestamp, last_seen timestamp, last_changed timestamp"
)
FEEDS = (
    "feed_id string, title string, url string, interval_s int, enabled boolean, version int, failures int, error string, "
    "next_run timestamp, last_attempt timestamp, last_success timestamp, last_changed timestamp, last_new timestamp"
)
RUNS = "feed_id string, page_id bigint, ended timestamp, status int, count bigint, error string, retry_after bigint"
LISTED = ("title", "url", "html", "image")


def fold_captures(listings: DataFrame, items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Merge several captures of each feed, in capture order, without a loop.

    listings(feed_id, key, at, page_id, title, url, html, image, published): what each capture lists.
    First listing gives identity times and date, the last gives the text, the newest listing
    that differs from the one before gives the change time. Exact while retention removes
    nothing in between, which ``needs_order`` checks.
    """
    w = Window.partitionBy("feed_id", "key").orderBy("at", "page_id")
    digest = F.xxhash64(*LISTED)
    old = items.select("feed_id", "key", digest.alias("_old"), F.lit(True).alias("_known"))
    seen = (
        listings.withColumn("_digest", digest)
        .join(old, ["feed_id", "key"], "left")
        .withColumn("_prev", F.lag("_digest").over(w))
        .withColumn("_moved", F.coalesce(F.col("_prev"), F.col("_old")) != F.col("_digest"))
    )
    folded = seen.groupBy("feed_id", "key").agg(
        F.max_by(F.struct(*LISTED), F.struct("at", "page_id")).alias("_last"),
        F.min("at").alias("_first_at"),
        F.max("at").alias("_last_at"),
        F.max(F.when(F.col("_moved"), F.col("at"))).alias("_moved_at"),
        F.min_by(F.struct(F.col("published").alias("p")), F.struct("at", "page_id")).alias("_dated"),
    )
    both = items.withColumn("_stored", F.lit(True)).join(folded, ["feed_id", "key"], "full_outer")
    stored, listed = F.col("_stored").isNotNull(), F.col("_last").isNotNull()
    moved = (
        F.when(~listed, F.col("last_changed"))
        .when(~stored, F.coalesce("_moved_at", "_first_at"))
        .otherwise(F.coalesce("_moved_at", "last_changed", "last_seen"))
    )
    return both.select(
        "feed_id",
        "key",
        F.when(stored, F.col("guid")).otherwise(history.story_guid(F.col("feed_id"), F.col("key"))).alias("guid"),
        *[F.when(listed, F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in LISTED],
        F.coalesce("content_full", F.lit("")).alias("content_full"),
        F.when(stored, F.col("published")).otherwise(F.coalesce("_dated.p", "_first_at")).alias("published"),
        F.when(stored, F.col("first_seen")).otherwise(F.col("_first_at")).alias("first_seen"),
        F.when(listed, F.col("_last_at")).otherwise(F.col("last_seen")).alias("last_seen"),
        moved.alias("last_changed"),
        (listed & ~stored).alias("inserted"),
        (listed & stored & F.col("_moved_at").isNotNull()).alias("changed"),
    )


def needs_order(listings: DataFrame, items: DataFrame, feeds: DataFrame, keep: int) -> DataFrame:
    """Feeds whose captures must be merged one after the other: retention would cut in between,
    two captures share a second, or one is not later than the feed's last change."""
    keys = listings.select("feed_id", "key").unionByName(items.select("feed_id", "key")).distinct()
    size = keys.groupBy("feed_id").agg(F.count("*").alias("n"))
    times = listings.select("feed_id", "at", "page_id").distinct().groupBy("feed_id").agg(
        F.count("*").alias("captures"), F.countDistinct("at").alias("seconds"), F.min("at").alias("first")
    )
    joined = times.join(size, "feed_id").join(feeds.select("feed_id", "last_changed"), "feed_id", "left")
    late = F.coalesce(F.col("first") <= F.col("last_changed"), F.lit(False))
    crowded = F.col("n") > keep
    tied = F.col("captures") > F.col("seconds")
    return joined.filter(((F.col("captures") > 1) & (crowded | tied)) | late).select("feed_id")


class RefreshStream:
    """foreachBatch handler: extract, filter, merge, retain, update feeds, append runs."""

    def __init__(self, spark: SparkSession, state_dir: str, recipe: Recipe, keep: int = history.MAX_ITEMS) -> None:
        self.spark, self.recipe, self.keep = spark, recipe, keep
        self.state = StateTables(spark, state_dir)

    def items(self) -> DataFrame:
        return self.state.latest("items", ITEMS)

    def feeds(self) -> DataFrame:
        return self.state.latest("feeds", FEEDS)

    def runs(self) -> DataFrame:
        return self.state.all_batches("runs", RUNS)

    def register(self, captures: DataFrame, feeds: DataFrame) -> DataFrame:
        """Feed rows, adding a first row for hosts never captured before."""
        fresh = captures.select("feed_id").distinct().join(feeds.select("feed_id"), "feed_id", "left_anti")
        never = F.lit(None).cast("timestamp")
        rows = fresh.select(
            "feed_id",
            F.col("feed_id").alias("title"),
            F.concat(F.lit("https://"), F.col("feed_id"), F.lit("/")).alias("url"),
            F.lit(3600).alias("interval_s"),
            F.lit(True).alias("enabled"),
            F.lit(1).alias("version"),
            F.lit(0).alias("failures"),
            F.lit("").alias("error"),
            *[never.alias(c) for c in ("next_run", "last_attempt", "last_success", "last_changed", "last_new")],
        )
        return feeds.unionByName(rows)

    def __call__(self, captures: DataFrame, batch: int) -> None:
        state = self.state
        items = state.read("items", batch, ITEMS)
        feeds = self.register(captures, state.read("feeds", batch, FEEDS))
        pages = extract.read_pages(captures, self.recipe, ("page_id", "feed_id", "url", "status", "captured_at"))
        # Extraction is the costly part: it runs once and everything below reads its result.
        pages = state.write("pages", batch, pages)
        outcomes = extract.page_outcomes(pages, ("page_id", "feed_id", "status", "captured_at"))
        runs = outcomes.select(
            "feed_id",
            "page_id",
            F.col("captured_at").alias("ended"),
            "status",
            F.col("items").cast("long").alias("count"),
            F.when(F.col("status") == 304, "")
            .when(F.col("status") != 200, F.concat(F.lit("http status "), F.col("status").cast("string")))
            .otherwise(F.coalesce("error", F.lit("")))
            .alias("error"),
            F.lit(0).cast("long").alias("retry_after"),
        )
        runs = state.write("runs", batch, runs)
        listings = extract.stories(pages.filter(F.col("status") == 200), ("page_id", "feed_id", "captured_at")).select(
            "feed_id", "key", F.col("captured_at").alias("at"), "page_id", *LISTED, "published"
        )
        ordered = state.write("ordered", batch, needs_order(listings, items, feeds, self.keep))
        merged = fold_captures(listings.join(ordered, "feed_id", "left_anti"), items.join(ordered, "feed_id", "left_anti"), feeds)
        kept = history.retain_items(merged, self.keep)
        folded = state.write("folded", batch, kept)
        summary = state.write("summary", batch, self._summary(merged, kept, feeds, listings))
        stored = folded.drop("inserted", "changed")
        if ordered.limit(1).count():
            stored, summary = self._in_order(batch, listings.join(ordered, "feed_id", "left_semi"), items.join(ordered, "feed_id", "left_semi"), feeds, stored, summary)
        state.write("items", batch, stored)
        state.write("feeds", batch, self._feeds_after(feeds, runs, summary))
        state.commit(batch)

    def _summary(self, merged: DataFrame, kept: DataFrame, feeds: DataFrame, listings: DataFrame) -> DataFrame:
        """Change times of folded feeds: those of the stories themselves, or of the capture that made retention cut."""
        flags = merged.select("feed_id", "key", "inserted", "changed", "first_seen", F.col("last_changed").alias("moved")).join(
            kept.select("feed_id", "key", F.lit(True).alias("kept")), ["feed_id", "key"], "left"
        )
        stays = F.col("kept").isNotNull()
        counts = flags.groupBy("feed_id").agg(
            F.count_if(F.col("inserted") & stays).alias("inserted"),
            F.count_if(F.col("changed") & stays).alias("changed"),
            F.count_if(~stays).alias("removed"),
            F.count_if(~stays & ~F.col("inserted")).alias("cut"),
            F.max(F.when((F.col("inserted") | F.col("changed")) & stays, F.col("moved"))).alias("moved"),
            F.max(F.when(F.col("inserted") & stays, F.col("first_seen"))).alias("newest"),
        )
        times = listings.groupBy("feed_id").agg(F.max("at").alias("now"))
        state = feeds.select("feed_id", F.col("last_changed").alias("_was"), F.col("last_new").alias("_new"))
        joined = counts.join(times, "feed_id").join(state, "feed_id")
        first = F.when(F.col("_was").isNull(), F.coalesce("moved", "now"))
        return joined.select(
            "feed_id",
            "inserted",
            "changed",
            "removed",
            F.greatest("_was", "moved", F.when(F.col("cut") > 0, F.col("now")), first).alias("last_changed"),
            F.coalesce("newest", "_new").alias("last_new"),
        )

    def _in_order(self, batch: int, listings: DataFrame, items: DataFrame, feeds: DataFrame, stored: DataFrame, summary: DataFrame):
        """The exact way for the remaining feeds: one capture of each per round."""
        w = Window.partitionBy("feed_id").orderBy("at", "page_id")
        turns = listings.select("feed_id", "at", "page_id").distinct().withColumn("turn", F.row_number().over(w))
        listings = self.state.write("turns", batch, listings.join(turns, ["feed_id", "at", "page_id"]))
        rounds = listings.agg(F.max("turn")).first()[0] or 0
        state = feeds.join(listings.select("feed_id").distinct(), "feed_id", "left_semi")
        total = None
        for turn in range(1, rounds + 1):
            now = listings.filter(F.col("turn") == turn)
            due = state.join(now.groupBy("feed_id").agg(F.max("at").alias("now")), "feed_id", "left")
            merged = history.merge_items(items, now.withColumn("content_full", F.lit("")), due.filter(F.col("now").isNotNull()), F.col("now"))
            merged = self.state.write(f"round{turn}", batch, merged)
            kept = history.retain_items(merged, self.keep)
            change = history.change_summary(merged, kept, due.filter(F.col("now").isNotNull()), F.col("now"))
            items = self.state.write(f"after{turn}", batch, kept.drop("inserted", "changed"))
            change = self.state.write(f"change{turn}", batch, change.select("feed_id", "inserted", "changed", "removed", "last_changed", "last_new"))
            newer = change.select("feed_id", F.col("last_changed").alias("_c"), F.col("last_new").alias("_n"))
            state = self.state.write(
                f"state{turn}",
                batch,
                state.join(newer, "feed_id", "left").withColumn("last_changed", F.coalesce("_c", "last_changed")).withColumn("last_new", F.coalesce("_n", "last_new")).drop("_c", "_n"),
            )
            total = change if total is None else total.unionByName(change)
        merged_total = total.groupBy("feed_id").agg(
            *[F.sum(c).alias(c) for c in ("inserted", "changed", "removed")], F.max("last_changed").alias("last_changed"), F.max("last_new").alias("last_new")
        )
        return stored.unionByName(items), summary.unionByName(merged_total)

    def _feeds_after(self, feeds: DataFrame, runs: DataFrame, summary: DataFrame) -> DataFrame:
        """The newest run decides health; failures in a row are counted over the batch and what came before."""
        from newsloom.operators.runs import streak_state

        counted = runs.select("feed_id", "ended", F.col("page_id").alias("run_id"), "error")
        before = feeds.select("feed_id", "failures", F.lit(False).alias("reported"))
        streak = streak_state(counted, before).select("feed_id", F.col("failures").alias("_streak"))
        last_ok = runs.filter(F.col("error") == "").groupBy("feed_id").agg(F.max("ended").alias("_ok"))
        newest = runs.groupBy("feed_id").agg(F.max_by(F.struct("ended", "status", "error", "retry_after"), F.struct("ended", "page_id")).alias("r"))
        base = (
            feeds.join(streak, "feed_id", "left")
            .join(last_ok, "feed_id", "left")
            # apply_runs adds the newest failure itself.
            .withColumn("failures", F.greatest(F.coalesce("_streak", F.col("failures").cast("long")) - 1, F.lit(0)).cast("int"))
            .withColumn("last_success", F.greatest("last_success", "_ok"))
            .drop("_streak", "_ok")
        )
        after = apply_runs(base, newest.select("feed_id", "r.ended", "r.status", "r.error", "r.retry_after"))
        newer = summary.select("feed_id", F.col("last_changed").alias("_c"), F.col("last_new").alias("_n"))
        joined = after.join(newer, "feed_id", "left")
        columns = [c.split()[0] for c in FEEDS.split(", ")]
        new = {"last_changed": F.coalesce("_c", "last_changed"), "last_new": F.coalesce("_n", "last_new"), "failures": F.col("failures").cast("int")}
        return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def run_available(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **options: str) -> None:
    """Drive everything available now through a foreachBatch handler."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.start().awaitTermination()
