"""The run log: retention, traces, streaks, alert edges and message batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import one_line, redact
from newsloom.operators.groups import anchored_windows, carry_forward, first_n_per_group, streaks, top_n

# Run log and alert bounds.
MAX_RUNS = 50
MAX_DETAILS = 64 << 10
ALERT_AFTER = 3
WINDOW_SECONDS = 60
THROTTLE_SECONDS = 3600
MAX_FEED_EVENTS = 256
MAX_GLOBAL_EVENTS = 8
MAX_LINES = 20
GLOBAL_KINDS = ("not_saved", "db_unavailable", "db_available", "test")
URGENT_KINDS = ("failing", "not_saved", "db_unavailable")

ATTEMPT = T.StructType(
    [
        T.StructField("mode", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("matches", T.LongType()),
        T.StructField("valid", T.LongType()),
        T.StructField("items", T.LongType()),
        T.StructField("filtered", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("warnings_omitted", T.LongType()),
    ]
)
TRACE = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("recipe_version", T.LongType()),
        T.StructField("requested_mode", T.StringType()),
        T.StructField("selector_type", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("attempts", T.ArrayType(ATTEMPT)),
    ]
)


def retain_runs(runs: DataFrame, n: int = MAX_RUNS) -> DataFrame:
    return top_n(runs, ["feed_id"], [F.col("run_id").desc()], n, ["run_id"])


def read_runs(runs: DataFrame, n: int = MAX_RUNS) -> DataFrame:
    """Latest runs per feed, newest first; unreadable details become NULL, the summary stays."""
    # Only details within bounds go through the ranking, unless the caller asks for the stored text itself.
    bounded = runs.withColumn("_readable", F.when(F.octet_length("details") <= MAX_DETAILS, F.col("details")))
    latest = first_n_per_group(bounded, ["feed_id"], [F.col("run_id").desc()], n, ["run_id"], "n")
    trace = F.from_json("_readable", TRACE, {"mode": "PERMISSIVE"})
    return latest.withColumn("trace", F.when(trace["version"] == 1, trace)).drop("_readable")


def run_rollup(runs: DataFrame) -> DataFrame:
    ok = F.col("error") == ""
    return runs.groupBy("feed_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.count_if(F.col("status") == 304).alias("not_modified"),
        F.max_by("status", "run_id").alias("last_status"),
        F.max("count").alias("max_count"),
        F.avg("count").alias("mean_count"),
        F.sum("count").alias("stories"),
        *([F.max("duration_ms").alias("max_duration_ms"), F.avg("duration_ms").alias("mean_duration_ms")] if "duration_ms" in runs.columns else []),
    )


def failure_streaks(runs: DataFrame) -> DataFrame:
    return streaks(runs, ["feed_id"], "ended", ["run_id"], F.col("error") != "").drop("before", "succeeded")


def current_streaks(runs: DataFrame) -> DataFrame:
    """Failures in a row at each feed's newest run."""
    return failure_streaks(runs).groupBy("feed_id").agg(
        F.max_by("streak", F.struct("ended", "run_id")).alias("failures"),
        F.max("ended").alias("last_attempt"),
        F.max(F.when(F.col("error") == "", F.col("ended"))).alias("last_success"),
    )


def latest_reading_run(runs: DataFrame) -> DataFrame:
    """Newest run per feed that read the page."""
    read = (F.col("status") != 304) & (F.col("error") == "")
    return runs.filter(read).groupBy("feed_id").agg(
        F.max("run_id").alias("run_id"), F.max_by("count", "run_id").alias("count"), F.max_by("ended", "run_id").alias("ended")
    )


def story_gaps(items: DataFrame) -> DataFrame:
    """Seconds between a feed's new stories, at distinct first-seen times."""
    times = items.select("feed_id", "first_seen").distinct()
    previous = carry_forward(times, ["feed_id"], "first_seen", [], F.col("first_seen"), "previous", inclusive=False)
    return previous.withColumn("gap_s", F.unix_timestamp("first_seen") - F.unix_timestamp("previous"))


def alert_edges(runs: DataFrame, n: int = ALERT_AFTER, state: DataFrame | None = None) -> DataFrame:
    """'failing' when a streak reaches n, 'recovered' on the success after one of n or more.

    ``state(feed_id, failures, reported)`` carries streaks over from earlier runs. A feed whose
    failing was reported also recovers when an edit has reset its count since.
    """
    failed = F.col("error") != ""
    if state is None:
        runs = runs.withColumn("_had", F.lit(0)).withColumn("_reported", F.lit(False))
    else:
        carried = state.select("feed_id", F.col("failures").alias("_had"), F.col("reported").alias("_reported"))
        runs = runs.join(carried, "feed_id", "left").na.fill({"_had": 0, "_reported": False})
    counted = streaks(runs, ["feed_id"], "ended", ["run_id"], failed, initial=F.col("_had"))
    answered = F.col("_reported") & ~F.col("succeeded")
    kind = F.when(failed & (F.col("streak") == n), "failing").when(~failed & ((F.col("before") >= n) | answered), "recovered")
    return (
        counted.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            "feed_id",
            "run_id",
            "ended",
            "kind",
            F.when(F.col("kind") == "failing", F.col("streak")).otherwise(F.col("before")).alias("failures"),
            "error",
        )
    )


def streak_state(runs: DataFrame, state: DataFrame, n: int = ALERT_AFTER) -> DataFrame:
    """state(feed_id, failures, reported) after more runs."""
    failed = F.col("error") != ""
    joined = runs.join(state.select("feed_id", F.col("failures").alias("_had")), "feed_id", "left").na.fill({"_had": 0})
    counted = streaks(joined, ["feed_id"], "ended", ["run_id"], failed, initial=F.col("_had"))
    latest = counted.groupBy("feed_id").agg(
        F.max_by("streak", F.struct("ended", "run_id")).alias("_streak"),
        F.bool_or(~failed).alias("_succeeded"),
    )
    both = state.join(latest, "feed_id", "full_outer")
    quiet = F.col("_streak").isNull()
    reported = F.when(quiet, F.col("reported")).otherwise(
        (F.col("_streak") >= n) | (~F.col("_succeeded") & F.coalesce("reported", F.lit(False)))
    )
    return both.select(
        "feed_id", F.coalesce("_streak", "failures").cast("long").alias("failures"), reported.alias("reported")
    )


def describe_event() -> Column:
    count = F.when(F.col("failures") == 1, "1 refresh").otherwise(F.concat(F.col("failures").cast("string"), F.lit(" refreshes")))
    reason = F.when(F.col("error") != "", F.concat(F.lit(" Error: "), F.col("error"))).otherwise("")
    failing = F.concat(F.lit("Failing: "), F.col("feed"), F.lit(" - "), count, F.lit(" in a row failed."), reason)
    recovered = F.when(
        F.col("failures") == 0, F.concat(F.lit("Recovered: "), F.col("feed"), F.lit(" - refreshed successfully."))
    ).otherwise(
        F.concat(F.lit("Recovered: "), F.col("feed"), F.lit(" - refreshed successfully after "), count, F.lit(" in a row failed."))
    )
    return one_line(
        F.when(F.col("kind") == "failing", failing).when(F.col("kind") == "recovered", recovered).otherwise(F.concat(F.col("kind"), reason))
    )


def alert_batches(events: DataFrame, window_s: int = WINDOW_SECONDS) -> DataFrame:
    """events(event_id, ts, kind, feed, failures, error) -> one message per first-event window.

    Bounds are ranks inside a window, taken by two-level top-n, so a burst is never
    collected: a message holds at most 20 lines, the rest is counted.
    """
    placed = anchored_windows(events, F.lit("alerts"), "ts", window_s)
    is_global = F.col("kind").isin(*GLOBAL_KINDS)
    placed = placed.withColumn("rank", F.when(is_global, 0).otherwise(1))
    totals = placed.groupBy("anchor").agg(
        F.count("*").alias("events"),
        F.least(F.count_if(is_global), F.lit(MAX_GLOBAL_EVENTS)).alias("globals_kept"),
        F.least(F.count_if(~is_global), F.lit(MAX_FEED_EVENTS)).alias("feeds_kept"),
        F.bool_or(F.col("kind").isin(*URGENT_KINDS)).alias("urgent"),
    )
    order = [F.col("ts"), F.col("event_id")]
    per_kind = first_n_per_group(placed, ["anchor", "rank"], order, MAX_LINES, ["event_id"], "place")
    kept = per_kind.filter((F.col("rank") == 1) | (F.col("place") <= MAX_GLOBAL_EVENTS))
    lines = kept.groupBy("anchor").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "place", describe_event().alias("line")))), 1, MAX_LINES).alias("lines")
    )
    more = F.col("events") - F.size("lines")
    text = F.array_join(F.transform("lines", lambda l: l["line"]), "\n")
    return totals.join(lines, "anchor").select(
        F.timestamp_seconds("anchor").alias("opened"),
        "events",
        F.size("lines").cast("long").alias("listed"),
        more.alias("more"),
        "urgent",
        F.when(more > 0, F.concat(text, F.lit("\n...and "), more.cast("string"), F.lit(" more."))).otherwise(text).alias("message"),
    )


def tumbling_batches(events: DataFrame, window_s: int = WINDOW_SECONDS) -> DataFrame:
    """The clock-aligned approximation of ``alert_batches``; counts only."""
    start = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / window_s) * window_s
    return events.groupBy(start.cast("long").alias("opened_s")).agg(
        F.count("*").alias("events"), F.bool_or(F.col("kind").isin(*URGENT_KINDS)).alias("urgent")
    )


def alert_throttle(events: DataFrame, gap_s: int = THROTTLE_SECONDS) -> DataFrame:
    """Events sent when a kind goes out at most once per gap since the last one sent."""
    placed = anchored_windows(events, F.col("kind"), "ts", gap_s)
    opening = placed.filter(F.col("second") == F.col("anchor"))
    return opening.groupBy("kind", "anchor").agg(F.min("event_id").alias("event_id"))


def _mode(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "static").when(value.isin("static", "browser", "auto", "flaresolverr"), value).otherwise("unknown")


def _clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(0)), F.lit(low)), F.lit(high))


def sanitize_trace(trace: Column) -> Column:
    """A run trace with every field clamped to its bounds or its known values."""

    def attempt(a: Column) -> Column:
        counted = lambda c, top: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0)), F.lit(top)))
        warnings = F.coalesce(a["warnings"], F.array().cast("array<string>"))
        over = F.greatest(F.size(warnings) - 20, F.lit(0))
        return F.struct(
            _mode(a["mode"]).alias("mode"),
            F.when(a["outcome"].isin("success", "failed", "not_modified"), a["outcome"]).otherwise("unknown").alias("outcome"),
            F.when(a["stage"].isin("fetch", "extract"), a["stage"]).otherwise("unknown").alias("stage"),
            F.when(a["status"].between(100, 599), a["status"]).otherwise(0).alias("status"),
            _clamp(a["duration_ms"], 0, 3600000).alias("duration_ms"),
            _clamp(a["bytes"], 0, 8 << 20).alias("bytes"),
            counted(a["matches"], 1000000).alias("matches"),
            counted(a["valid"], 1000).alias("valid"),
            counted(a["items"], 1000).alias("items"),
            _clamp(a["filtered"], 0, 1000).alias("filtered"),
            redact(F.coalesce(a["error"], F.lit("")), 1000).alias("error"),
            F.transform(F.slice(warnings, 1, 20), lambda w: redact(w, 512)).alias("warnings"),
            F.least(_clamp(a["warnings_omitted"], 0, 1000000) + over, F.lit(1000000)).alias("warnings_omitted"),
        )

    return F.when(
        trace.isNotNull(),
        F.struct(
            F.lit(1).alias("version"),
            F.greatest(F.coalesce(trace["recipe_version"], F.lit(0)), F.lit(0)).alias("recipe_version"),
            _mode(trace["requested_mode"]).alias("requested_mode"),
            F.when(trace["selector_type"].isin("css", "xpath", "feed"), trace["selector_type"]).otherwise("unknown").alias("selector_type"),
            _clamp(trace["duration_ms"], 0, 3600000).alias("duration_ms"),
            F.transform(F.slice(F.coalesce(trace["attempts"], F.array().cast(T.ArrayType(ATTEMPT))), 1, 2), attempt).alias("attempts"),
        ),
    )


def sanitize_runs(runs: DataFrame) -> DataFrame:
    """Traces bounded for storage; one whose encoding is still too long is dropped."""
    bounded = runs.withColumn("trace", sanitize_trace(F.col("trace")))
    return bounded.withColumn("trace", F.when(F.octet_length(F.to_json("trace")) <= MAX_DETAILS, F.col("trace")))


