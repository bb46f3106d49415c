"""Full article bodies: which to fetch, attaching them, and remembering failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.groups import first_n_per_group

# Per-run budget, recency, backoff.
ARTICLES_PER_RUN = 10
PREVIEW_ARTICLES = 3
RECENT_SECONDS = 3600
RETRY_FIRST = 3600
RETRY_MAX = 86400


def article_candidates(listed: DataFrame, stored: DataFrame, memory: DataFrame) -> DataFrame:
    """Listed stories with a link, what is stored of them, and what is remembered of their article.

    listed(feed_id, version, key, url, pos); stored(feed_id, key, has_body, first_seen);
    memory(feed_id, key, version, tried, retry, unkept). Bodies are never read.
    """
    known = stored.select("feed_id", "key", "has_body", "first_seen")
    past = memory.select("feed_id", "key", "version", "tried", "retry", "unkept")
    return (
        listed.filter(F.col("url") != "")
        .join(known, ["feed_id", "key"], "left")
        .join(past, ["feed_id", "key", "version"], "left")
    )


def classify(candidates: DataFrame, now: Column) -> DataFrame:
    """class 0 never tried, 1 retry, 2 recent refetch, NULL not wanted or waiting out a backoff."""
    stored = F.col("has_body").isNotNull()
    recent = stored & (F.col("first_seen").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("first_seen") <= RECENT_SECONDS))
    missing = ~F.coalesce("has_body", F.lit(False))
    tried = F.col("tried").isNotNull()
    due = F.col("retry").isNull() | (F.col("retry") <= now)
    return (
        candidates.withColumn(
            "class",
            F.when(missing & ~tried, 0).when(missing & (due | recent), 1).when(~missing & recent, 2),
        )
        .withColumn("waiting", missing & tried & ~due & ~recent)
        .withColumn("counts", missing & (~tried | due))
    )


def article_queue(classified: DataFrame, budget: int = ARTICLES_PER_RUN) -> DataFrame:
    """The first ``budget`` stories per feed: untried in list order, retries, then recent refetches."""
    retry = F.col("class") == 1
    order = [
        F.col("class"),
        F.when(retry, F.coalesce("unkept", F.lit(False))).otherwise(False),
        F.when(retry, F.col("tried")).asc_nulls_first(),
        F.col("pos"),
    ]
    return first_n_per_group(classified.filter(F.col("class").isNotNull()), ["feed_id"], order, budget, ["key"], "place")


def article_waiting(classified: DataFrame) -> DataFrame:
    return classified.groupBy("feed_id").agg(F.count_if("waiting").alias("waiting"))


def target_union(fresh: DataFrame, again: DataFrame, recent: DataFrame, n: int) -> DataFrame:
    """fresh, again, recent in that order, each by ``pos``, the first n per feed."""
    tagged = [f.select("feed_id", "key", "pos", F.lit(i).alias("class")) for i, f in enumerate((fresh, again, recent))]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return first_n_per_group(union, ["feed_id"], [F.col("class"), F.col("pos")], n, ["key"], "place")


def attach_articles(items: DataFrame, bodies: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Items with the body or failure of their own page; no item is dropped."""
    wanted = items if queue is None else items.join(queue.select("feed_id", "key", F.lit(True).alias("queued")), ["feed_id", "key"], "left")
    page = bodies.select("url", F.col("body").alias("_body"), F.col("failure").alias("_failure"))
    # Stories without a link never match, and must not meet in one task on an empty key.
    key = F.when(F.col("url") != "", F.col("url"))
    joined = wanted.withColumn("_url", key).join(page.withColumnRenamed("url", "_url"), "_url", "left").drop("_url")
    use = F.lit(True) if queue is None else F.col("queued").isNotNull()
    out = joined.withColumn("content_full", F.when(use, F.coalesce("_body", F.lit(""))).otherwise("")).withColumn(
        "failure", F.when(use, F.col("_failure"))
    )
    return out.drop("_body", "_failure", "queued")


def article_progress(listed: DataFrame, before: DataFrame, after: DataFrame, run: DataFrame) -> DataFrame:
    """Per feed, whether the backlog continues.

    listed(feed_id, key); before/after(feed_id, key, has_body); run(feed_id, key, state) with state 'left' | 'fetched'.
    """
    joined = (
        listed.select("feed_id", "key")
        .join(before.select("feed_id", "key", F.col("has_body").alias("had")), ["feed_id", "key"], "left")
        .join(after.select("feed_id", "key", F.col("has_body").alias("has")), ["feed_id", "key"], "left")
        .join(run.select("feed_id", "key", "state"), ["feed_id", "key"], "left")
    )
    counted = joined.groupBy("feed_id").agg(
        F.count_if(F.col("state") == "left").alias("left"),
        F.count_if(F.col("state") == "fetched").alias("fetched"),
        F.count_if(F.coalesce("had", F.lit(False))).alias("had"),
        F.count_if(F.coalesce("has", F.lit(False))).alias("has"),
        F.count_if((F.col("state") == "left") & F.col("has").isNotNull() & ~F.coalesce("has", F.lit(True))).alias("open"),
    )
    going = (F.col("left") > 0) & (F.col("fetched") > 0) & (F.col("has") > F.col("had")) & (F.col("open") > 0)
    return counted.withColumn("backlog", going)


def draining(feeds: DataFrame, progress: DataFrame) -> DataFrame:
    """Whether the next refresh ignores validators: a backlog continues, or nothing is known yet."""
    return feeds.select("feed_id").join(progress.select("feed_id", "backlog"), "feed_id", "left").select(
        "feed_id", F.coalesce("backlog", F.lit(True)).alias("draining")
    )


def retry_delay(count: Column) -> Column:
    doublings = F.greatest(F.least(count - 1, F.lit(5)), F.lit(0))
    return F.least(F.pow(F.lit(2), doublings).cast("long") * RETRY_FIRST, F.lit(RETRY_MAX))


def article_memory(memory: DataFrame, tries: DataFrame, listed: DataFrame, now: Column) -> DataFrame:
    """Memory after one refresh: tries(feed_id, key, version, outcome, kept), outcome 'stored' | 'fault' | 'deferred'.

    Stories no longer listed, or remembered for another recipe version, are forgotten.
    """
    state = memory.join(listed.select("feed_id", "key", "version"), ["feed_id", "key", "version"], "left_semi")
    joined = state.join(
        tries.select("feed_id", "key", "version", "outcome", "kept"), ["feed_id", "key", "version"], "full_outer"
    )
    outcome = F.col("outcome")
    # A try before its time is due to the story's first hour: its failure is put off, not counted.
    due = F.col("tried").isNull() | F.col("retry").isNull() | (F.col("retry") <= now)
    fault = (outcome == "fault") & due
    count = F.coalesce("count", F.lit(0)) + F.when(fault, 1).otherwise(0)
    next_retry = F.timestamp_seconds(F.unix_timestamp(now) + retry_delay(count))
    stored = outcome == "stored"
    return joined.filter(outcome.isNull() | ~stored | ~F.col("kept")).select(
        "feed_id",
        "key",
        "version",
        F.when(outcome.isNull(), F.col("tried")).otherwise(now).alias("tried"),
        F.when(stored, 0).otherwise(count).cast("int").alias("count"),
        F.when(stored, F.lit(None).cast("timestamp")).when(fault, next_retry).otherwise(F.col("retry")).alias("retry"),
        F.when(outcome.isNull(), F.coalesce("unkept", F.lit(False))).otherwise(F.coalesce(stored, F.lit(False))).alias("unkept"),
    )


def memory_intersect(memory: DataFrame, listed: DataFrame) -> DataFrame:
    return memory.join(listed.select("feed_id", "key"), ["feed_id", "key"], "left_semi")
