"""Streams over Spark's keyed state: a feed's state machine and the new or changed stories of a listing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.streaming.timers import with_state_store

FEED_STATE = "failures long, last_attempt long, last_success long, next_run long, error string"
FEED_OUT = f"feed_id string, {FEED_STATE}"
STORY_OUT = "feed_id string, key string, kind string"
FIRST_304 = "unchanged (304) before any success"


def _delay(failures: int, retry_after: int) -> int:
    return max(min(2 ** min(failures, 10) * 60, 86400), retry_after)


def _number(text: str) -> int | None:
    return int(text) if text else None


class FeedStates(StatefulProcessor):
    """A feed's runs of one batch in time order on top of its state; times are Unix seconds, 0 for never."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("feed", FEED_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failures, attempt, success, due, error = self.state.get() or (0, 0, 0, 0, "")
        # A run of no known feed has no due time.
        jitter = None if key[0] is None else int(hashlib.sha256(key[0].encode()).hexdigest()[:2], 16) % 30
        runs = [run.split("\t", 5) for _, run in rows]
        for ended, _, status, retry_after, interval_s, text in sorted(runs, key=lambda r: (int(r[0]), not r[1], _number(r[1]) or 0)):
            at = int(ended)
            if at < attempt:
                continue  # older than what the state has seen
            error = text or (FIRST_304 if status == "304" and not success else "")
            failures = failures + 1 if error else 0
            attempt = at
            success = success if error else at
            wait = _delay(failures, _number(retry_after) or 0) if error else _number(interval_s)
            due = None if wait is None or jitter is None else at + wait + jitter
        self.state.update((failures, attempt, success, due, error))
        yield Row(feed_id=key[0], failures=failures, last_attempt=attempt, last_success=success, next_run=due, error=error)

    def close(self) -> None:
        pass


def feed_states(runs: DataFrame) -> DataFrame:
    """runs(feed_id, run_id, ended, status, error, retry_after, interval_s) -> each feed's state after every batch.

    A run without a time is left out.
    """
    with_state_store(runs.sparkSession)
    numbers = [F.unix_timestamp("ended"), *[F.col(c).cast("long") for c in ("run_id", "status", "retry_after", "interval_s")]]
    # One text a run: each cell of a row is read by itself in Python, which costs more than the fold.
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (*numbers, F.col("error"))]
    packed = runs.filter(F.col("ended").isNotNull()).select("feed_id", F.concat_ws("\t", *fields).alias("run"))
    return packed.groupBy("feed_id").transformWithState(FeedStates(), FEED_OUT, "update", "None")


class StoryChanges(StatefulProcessor):
    """What was last listed of a story, by its digest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("story", "digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        digest = max(((at, n, digest) for n, (_, _, digest, at) in enumerate(rows)), key=lambda r: r[:2])[2]
        known = (self.state.get() or (None,))[0]
        if digest != known:
            self.state.update((digest,))
            yield Row(feed_id=key[0], key=key[1], kind="new" if known is None else "changed")

    def close(self) -> None:
        pass


def story_changes(listings: DataFrame) -> DataFrame:
    """listings(feed_id, key, digest, at) -> stories that are new or differ from what was last listed."""
    with_state_store(listings.sparkSession)
    # Plain numbers are cheaper than times in Python; a listing without a time comes last.
    at = F.coalesce(F.unix_micros("at"), F.lit(2**63 - 1))
    return listings.select("feed_id", "key", "digest", at.alias("at")).groupBy("feed_id", "key").transformWithState(StoryChanges(), STORY_OUT, "update", "None")


def run_slices(spark: SparkSession, slices: list[DataFrame], transform: Callable[[DataFrame], DataFrame], root: str) -> DataFrame:
    """Deliver the slices one after the other through one stream; rows of all batches with their batch number.

    Every slice is written to the arrival folder and taken up by the stream from its checkpoint. A batch overwrites its
    own output, so one that is run again counts once.
    """
    arrivals, out = f"{root}/arrivals", f"{root}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = None
    for piece in slices:
        piece.write.mode("append").parquet(arrivals)
        source = spark.readStream.schema(piece.schema).parquet(arrivals)
        result = transform(source)
        schema = result.schema
        query = result.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(out)
