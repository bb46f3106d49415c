"""Alert edges, message windows, throttling and feed state over a run stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import articles, runs
from newsloom.streaming.state import StateTables

STREAK = "feed_id string, failures bigint, reported boolean"
EDGE = "feed_id string, run_id bigint, ended timestamp, kind string, failures bigint, error string"
EVENT = "event_id bigint, ts timestamp, kind string, feed string, failures bigint, error string"
MESSAGE = "opened timestamp, events bigint, listed bigint, more bigint, urgent boolean, message string"
SENT = "kind string, last_s bigint"
MEMORY = "feed_id string, key string, version int, tried timestamp, count int, retry timestamp, unkept boolean"


class EdgeStream:
    """runs(feed_id, run_id, ended, error) -> failing/recovered edges, once per streak."""

    def __init__(self, spark: SparkSession, state_dir: str, n: int = runs.ALERT_AFTER) -> None:
        self.state, self.n = StateTables(spark, state_dir), n

    def __call__(self, batch_runs: DataFrame, batch: int) -> None:
        rows = self.state.write("runs", batch, batch_runs.select("feed_id", "run_id", "ended", "error"))
        before = self.state.read("streaks", batch, STREAK)
        self.state.write("edges", batch, runs.alert_edges(rows, self.n, before))
        self.state.write("streaks", batch, runs.streak_state(rows, before, self.n))
        self.state.commit(batch)

    def edges(self) -> DataFrame:
        return self.state.all_batches("edges", EDGE)

    def streaks(self) -> DataFrame:
        return self.state.latest("streaks", STREAK)


class MessageStream:
    """Alert events -> messages. A window opens at its first event; it is sent once event time has passed its end."""

    def __init__(self, spark: SparkSession, state_dir: str, window_s: int = runs.WINDOW_SECONDS) -> None:
        self.state, self.window_s = StateTables(spark, state_dir), window_s

    def __call__(self, events: DataFrame, batch: int) -> None:
        self._advance(events, batch, flush=False)

    def flush(self, spark: SparkSession, batch: int) -> None:
        """Send what is still open, as at shutdown."""
        self._advance(spark.createDataFrame([], EVENT), batch, flush=True)

    def _advance(self, events: DataFrame, batch: int, flush: bool) -> None:
        waiting = self.state.read("pending", batch, EVENT)
        columns = [c.split()[0] for c in EVENT.split(", ")]
        queue = self.state.write("queue", batch, waiting.unionByName(events.select(*columns)))
        placed = runs.anchored_windows(queue, F.lit("alerts"), "ts", self.window_s)
        clock = F.broadcast(queue.agg(F.max(F.unix_timestamp("ts")).alias("_clock")))
        over = F.lit(True) if flush else F.col("anchor") + self.window_s <= F.col("_clock")
        tagged = self.state.write("tagged", batch, placed.join(clock).withColumn("_over", over).select(*columns, "_over"))
        self.state.write("messages", batch, runs.alert_batches(tagged.filter("_over").drop("_over"), self.window_s))
        self.state.write("pending", batch, tagged.filter("NOT _over").drop("_over"))
        self.state.commit(batch)

    def messages(self) -> DataFrame:
        return self.state.all_batches("messages", MESSAGE)


class ThrottleStream:
    """Events of a kind at most once per gap since the last one sent, across batches."""

    def __init__(self, spark: SparkSession, state_dir: str, gap_s: int = runs.THROTTLE_SECONDS) -> None:
        self.state, self.gap_s = StateTables(spark, state_dir), gap_s

    def __call__(self, events: DataFrame, batch: int) -> None:
        last = self.state.read("sent", batch, SENT)
        joined = events.join(last, "kind", "left")
        open_again = F.col("last_s").isNull() | (F.unix_timestamp("ts") >= F.col("last_s") + self.gap_s)
        out = self.state.write("out", batch, runs.alert_throttle(joined.filter(open_again).drop("last_s"), self.gap_s))
        newest = out.groupBy("kind").agg(F.max("anchor").alias("_s"))
        merged = last.join(newest, "kind", "full_outer").select("kind", F.greatest("last_s", "_s").alias("last_s"))
        self.state.write("sent", batch, merged)
        self.state.commit(batch)

    def sent(self) -> DataFrame:
        return self.state.all_batches("out", "kind string, anchor bigint, event_id bigint")


class MemoryStream:
    """Article tries per refresh -> what is remembered of each story's article."""

    def __init__(self, spark: SparkSession, state_dir: str) -> None:
        self.state = StateTables(spark, state_dir)

    def __call__(self, tries: DataFrame, batch: int) -> None:
        """tries(feed_id, key, version, outcome, kept, at): one row per listed story, outcome NULL when not tried."""
        memory = self.state.read("memory", batch, MEMORY)
        rows = self.state.write("tries", batch, tries)
        now = rows.agg(F.max("at")).first()[0]
        after = articles.article_memory(memory, rows.filter(F.col("outcome").isNotNull()), rows, F.lit(now).cast("timestamp"))
        self.state.write("memory", batch, after)
        self.state.commit(batch)

    def memory(self) -> DataFrame:
        return self.state.latest("memory", MEMORY)
