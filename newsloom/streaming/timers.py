"""Streams whose results also come from silence: outages that end, feeds that turn quiet, memory that lapses.

Each key's rows update its state in time order, and an event-time timer stands for what happens if nothing more comes.
Rows of a batch are first brought down to one a second and key, so the rows of a busy key are bounded by the time that
the batch spans. State lives in the state store of the stream and survives lost executors with its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators import articles, runs
from newsloom.operators.feeds import quiet_threshold

#: The store that keeps state by key with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTAGE_OUT = "kind string, at long, event string"
QUIET_OUT = "feed_id string, at long, event string"
MEMORY_OUT = "feed_id string, key string, version int, tried long, count int, retry long, unkept boolean, event string, rows long, turn long"
DELAY = "0 seconds"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _rearm(handle: StatefulProcessorHandle, at: int | None) -> None:
    """One timer a key, in seconds."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
    if at is not None:
        handle.registerTimer(at * 1000)


class Outages(StatefulProcessor):
    """Announces a kind's trouble at most once per gap and closes the outage once the kind stays silent."""

    def __init__(self, gap_s: int, silence_s: int) -> None:
        self.gap_s, self.silence_s = gap_s, silence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("outage", "sent long, seen long, announced boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, seen, announced = self.state.get() if self.state.exists() else (None, None, False)
        out = []
        for at in sorted({int(x) for frame in rows for x in frame["at"]}):
            if seen is not None and announced and at >= seen + self.silence_s:
                out.append((key[0], seen + self.silence_s, "closed"))
                announced = False
            if sent is None or at >= sent + self.gap_s:
                out.append((key[0], at, "sent"))
                sent, announced = at, True
            seen = at if seen is None else max(seen, at)
        self.state.update((sent, seen, announced))
        _rearm(self.handle, seen + self.silence_s if announced else None)
        yield pd.DataFrame(out, columns=["kind", "at", "event"]).astype({"kind": object, "event": object})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sent, seen, announced = self.state.get()
        out = [(key[0], seen + self.silence_s, "closed")] if announced else []
        self.state.update((sent, seen, False))
        yield pd.DataFrame(out, columns=["kind", "at", "event"]).astype({"kind": object, "event": object})

    def close(self) -> None:
        pass


def outages(events: DataFrame, gap_s: int = runs.THROTTLE_SECONDS, silence_s: int = runs.THROTTLE_SECONDS) -> DataFrame:
    """events(kind, ts) -> kind, at (Unix seconds) and event: 'sent', or 'closed' after silence_s without one.

    A closing event is given once, and only for an outage of which something was sent.
    """
    seconds = events.withWatermark("ts", DELAY).select("kind", F.unix_timestamp("ts").alias("at"), "ts")
    return seconds.groupBy("kind").transformWithStateInPandas(Outages(gap_s, silence_s), OUTAGE_OUT, "update", "EventTime")


class QuietFeeds(StatefulProcessor):
    """Whether a feed is quiet after each of its runs, and when it turns quiet between them; ``due`` is its timer's time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "since long, story long, healthy boolean, quiet boolean, threshold long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        since, story, healthy, quiet, threshold, due = self.state.get() or (None, None, False, False, None, None)
        for run in sorted(rows, key=lambda r: (r.at, r.run_id)):
            at = run.at
            started = story if story is not None else since
            if healthy and not quiet and threshold is not None and started is not None and started + threshold < at:
                yield Row(feed_id=key[0], at=started + threshold, event="quiet")
                quiet = True
            threshold = run.threshold
            healthy = bool(run.ok)
            if healthy and since is None:
                since = at
            if healthy and run.fresh:
                story = at
            started = story if story is not None else since
            now = healthy and threshold is not None and started is not None and at - started >= threshold
            if now != quiet:
                yield Row(feed_id=key[0], at=at, event="quiet" if now else "resumed")
            quiet = now
        waits = healthy and not quiet and threshold is not None and started is not None
        armed = started + threshold if waits else None
        if armed != due:
            if due is not None:
                self.handle.deleteTimer(due * 1000)
            if armed is not None:
                self.handle.registerTimer(armed * 1000)
        self.state.update((since, story, healthy, quiet, threshold, armed))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        since, story, healthy, quiet, threshold, due = self.state.get()
        self.state.update((since, story, healthy, True, threshold, None))
        if not quiet:
            yield Row(feed_id=key[0], at=due, event="quiet")

    def close(self) -> None:
        pass


def quiet_stream(runs_seen: DataFrame) -> DataFrame:
    """runs_seen(feed_id, run_id, ended, error, new_story, interval_s, quiet_days) -> crossings into and out of quiet.

    A feed is quiet while its newest run succeeded and its newest story, or else its first success, is older than its
    threshold. It turns quiet by itself, when the threshold passes, and resumes with a story or a failed run.
    """
    rows = runs_seen.withWatermark("ended", DELAY).select(
        "feed_id",
        "ended",
        F.unix_timestamp("ended").alias("at"),
        F.col("run_id").cast("long").alias("run_id"),
        (F.col("error") == "").alias("ok"),
        F.col("new_story").alias("fresh"),
        quiet_threshold(F.col("quiet_days"), F.col("interval_s")).alias("threshold"),
    )
    return rows.groupBy("feed_id").transformWithState(QuietFeeds(), QUIET_OUT, "update", "EventTime")


class ArticleMemory(StatefulProcessor):
    """What is remembered of the articles of a feed's stories, under the feed's current recipe version.

    A feed remembers at most what its newest listing holds, so its memory is one value: read and written once a batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "version int, stories array<struct<key string, tried long, count int, retry long, unkept boolean>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        current, known = self.memory.get() or (None, [])
        stories = {k: tuple(entry) for k, *entry in known}
        out, late = [], 0
        for at, refresh in groupby(sorted(rows, key=lambda r: (r.at, r.version)), key=lambda r: r.at):
            listed = list(refresh)
            newest = listed[-1].version
            if current is None or newest > current:
                # An edited recipe finds other articles: what was learned under the old one is forgotten.
                out += [(k, current, None, "forgotten") for k in sorted(stories)]
                stories.clear()
                current = newest
            fresh = [r for r in listed if r.version >= current]
            late += len(listed) - len(fresh)
            out += self._refresh(stories, at, current, fresh)
        if current is not None:
            self.memory.update((current, [(k, *stories[k]) for k in sorted(stories)]))
        for turn, (story, version, entry, event) in enumerate(out):
            yield self._row(turn, key[0], story, version, entry or (None, None, None, None), event, 1)
        if late:
            yield self._row(len(out), key[0], None, current, (None, None, None, None), "late", late)

    def _row(self, turn: int, feed: str, story: str | None, version: int | None, entry: tuple, event: str, rows: int) -> Row:
        tried, count, retry, unkept = entry
        return Row(feed_id=feed, key=story, version=version, tried=tried, count=count, retry=retry, unkept=unkept, event=event, rows=rows, turn=turn)

    def _refresh(self, memory: dict, now: int, version: int, listed: list[Row]) -> list[tuple]:
        out = []
        stories = [r for r in listed if r.key is not None]
        if not stories:
            return out
        for gone in sorted(memory.keys() - {r.key for r in stories}):
            del memory[gone]
            out.append((gone, version, None, "forgotten"))
        for story in stories:
            entry = memory.get(story.key)
            if story.outcome is None:
                continue
            tried, count, retry, _ = entry or (None, 0, None, False)
            # A try before its time is due to the story's first hour: its failure is put off, not counted.
            due = tried is None or retry is None or retry <= now
            fault = story.outcome == "fault" and due
            count += 1 if fault else 0
            if story.outcome == "stored" and story.kept:
                if entry:
                    del memory[story.key]
                    out.append((story.key, version, None, "forgotten"))
                continue
            if story.outcome == "stored":
                new = (now, 0, None, True)
            else:
                wait = min(2 ** max(min(count - 1, 5), 0) * articles.RETRY_FIRST, articles.RETRY_MAX)
                new = (now, count, now + wait if fault else retry, False)
            memory[story.key] = new
            out.append((story.key, version, new, "remembered"))
        return out

    def close(self) -> None:
        pass


def article_memory_stream(tries: DataFrame) -> DataFrame:
    """tries(feed_id, key, version, outcome, kept, at) -> changes of what is remembered, in the order of ``at``.

    Every refresh lists its stories, outcome NULL for one not tried, and a row without key tells of a new version alone.
    Rows of a version older than the feed's are dropped, and a row 'late' counts them. event 'remembered' gives a
    story's entry, 'forgotten' says it has none any more.
    """
    rows = tries.select("feed_id", "key", F.col("version").cast("int"), "outcome", "kept", F.unix_timestamp("at").alias("at"))
    return rows.groupBy("feed_id").transformWithState(ArticleMemory(), MEMORY_OUT, "update", "None")


def memory_after(changes: DataFrame) -> DataFrame:
    """The entries that stand after all changes; changes(..., batch) with rows in the order given within a batch."""
    newest = changes.filter(F.col("key").isNotNull()).groupBy("feed_id", "key").agg(F.max_by(F.struct("version", "tried", "count", "retry", "unkept", "event"), F.struct("batch", "turn")).alias("e"))
    return newest.filter(F.col("e.event") == "remembered").select("feed_id", "key", "e.version", "e.tried", "e.count", "e.retry", "e.unkept")
