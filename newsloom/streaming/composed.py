"""The whole refresh as one stream: captures in, histories, feed rows, runs and alerts out.

Each capture is read by its feed's recipe and rules where it arrives. What it lists then goes to the feed's keyed state,
which holds the feed's row and its retained stories: it refuses results of an older recipe, merges listings in capture
order, cuts to the newest stories, and counts failures. A batch touches the state of captured feeds alone, and what it
changed leaves as rows of a change log. A feed's retained stories are bounded by retention, and the captures of a feed
within one batch by what a batch admits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators import recipe_table as RT
from newsloom.operators.history import MAX_ITEMS
from newsloom.operators.runs import ALERT_AFTER
from newsloom.sources.captures import MAX_BODY
from newsloom.streaming.keyed import FIRST_304, _delay

#: Status of a row that tells of an edited recipe instead of a capture.
EDITED = -1
STORY = "title string, url string, html string, image string, published long, first_seen long, last_seen long, last_changed long"
FEED = "version int, failures long, last_attempt long, last_success long, last_changed long, last_new long, next_run long, error string, reported boolean"
CHANGES = f"feed_id string, turn long, kind string, key string, {STORY}, {FEED.replace('last_changed long', 'feed_changed long')}, at long, status int, stories long"
NAMES = [c.split()[0] for c in CHANGES.split(", ")]
STORY_NAMES = [c.split()[0] for c in STORY.split(", ")]
FEED_NAMES = [c.split()[0] for c in FEED.split(", ")]
TEXTS = ("title", "url", "html", "image")


def read_listings(captures: DataFrame, compiled: DataFrame, asks: dict[str, bool] | None = None) -> DataFrame:
    """captures(page_id, feed_id, url, status, version, interval_s, html, captured_at) -> one row per capture with the stories it lists.

    Only bodies of successful fetches within the size limit are read; captures whose recipe is unknown are left out.
    """
    whole = (F.col("status") == 200) & (F.octet_length("html") <= MAX_BODY)
    rows = captures.withColumn("html", F.when(whole, F.col("html")).otherwise("")).withColumnRenamed("version", "asked")
    known = compiled.withColumnRenamed("feed_id", "of").withColumn("feed_id", F.concat_ws("\n", "of", F.col("version").cast("string")))
    # The recipe of the version that the capture was made for, whatever the feed uses by now.
    rows = rows.withColumn("source", F.col("feed_id")).withColumn("feed_id", F.concat_ws("\n", "source", F.col("asked").cast("string")))
    read = RT.read_pages(rows, known.drop("of"), ("page_id", "feed_id", "source", "asked", "status", "interval_s", "url", "captured_at"), asks or RT.used(compiled))
    kept = F.filter("cards", lambda s: s["reason"].isNull() & s["drop_reason"].isNull())
    stories = F.transform(kept, lambda s: F.struct(s["key"].alias("key"), *[s[c].alias(c) for c in TEXTS], F.unix_timestamp(s["published"]).alias("published")))
    error = F.when(F.col("status") == 200, F.coalesce("error", F.lit(""))).when(F.col("status") == 304, "").otherwise(F.concat(F.lit("http status "), F.col("status").cast("string")))
    return read.select(
        F.col("source").alias("feed_id"), "page_id", F.unix_timestamp("captured_at").alias("at"), F.col("status").cast("int").alias("status"), F.col("asked").cast("int").alias("version"),
        F.col("interval_s").cast("long").alias("interval_s"), error.alias("error"), F.when((F.col("status") == 200) & F.col("error").isNull(), stories).alias("stories"),
    )


def edit_rows(edits: DataFrame) -> DataFrame:
    """edits(feed_id, version, at, interval_s) in the shape of listings."""
    none = F.lit(None).cast("array<struct<key:string,title:string,url:string,html:string,image:string,published:bigint>>")
    return edits.select(
        "feed_id", F.lit(-1).cast("long").alias("page_id"), F.unix_timestamp("at").alias("at"), F.lit(EDITED).alias("status"), F.col("version").cast("int"), F.col("interval_s").cast("long"), F.lit("").alias("error"), none.alias("stories")
    )


class FeedHistory(StatefulProcessor):
    def __init__(self, keep: int = MAX_ITEMS, alert_after: int = ALERT_AFTER) -> None:
        self.keep, self.alert_after = keep, alert_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.feed_state = handle.getValueState("feed", FEED)
        self.story_state = handle.getMapState("stories", "key string", STORY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        feed_id = key[0]
        feed = dict(zip(FEED_NAMES, self.feed_state.get() if self.feed_state.exists() else (None, 0, None, None, None, None, None, "", False), strict=True))
        stories = {k[0]: dict(zip(STORY_NAMES, v, strict=True)) for k, v in self.story_state.iterator()}
        before, touched, out = set(stories), set(), []
        captures = pd.concat(list(rows)).sort_values(["at", "page_id"])
        for capture in captures.itertuples(index=False):
            version = int(capture.version)
            if feed["version"] is None or (capture.status == EDITED and version > feed["version"]):
                feed["version"] = version
            if capture.status == EDITED:
                # An edit makes the feed due and forgets its failures.
                feed |= {"failures": 0, "error": "", "next_run": int(capture.at)}
                continue
            if version != feed["version"]:
                out.append({"kind": "stale", "at": int(capture.at), "status": capture.status, "version": version})
                continue
            out += self._run(feed_id, feed, stories, touched, capture)
        for name in sorted(touched & set(stories)):
            self.story_state.updateValue((name,), tuple(stories[name][c] for c in STORY_NAMES))
            out.append({"kind": "story", "key": name, **stories[name]})
        for name in sorted(before - set(stories)):
            self.story_state.removeKey((name,))
            out.append({"kind": "removed", "key": name})
        self.feed_state.update(tuple(feed[c] for c in FEED_NAMES))
        out.append({"kind": "feed", **{("feed_changed" if c == "last_changed" else c): v for c, v in feed.items()}})
        frame = pd.DataFrame([{**r, "feed_id": feed_id, "turn": turn} for turn, r in enumerate(out)], columns=NAMES)
        # Plain objects for texts: columns of several Arrow chunks can't leave the worker.
        kinds = {"long": "Int64", "int": "Int64", "boolean": "boolean", "string": object}
        yield frame.astype({name: kinds[kind] for name, kind in (c.split() for c in CHANGES.split(", "))})

    def _run(self, feed_id: str, feed: dict, stories: dict, touched: set, capture) -> list[dict]:
        now, out = int(capture.at), []
        error = capture.error or (FIRST_304 if capture.status == 304 and feed["last_success"] is None else "")
        count = 0
        if not error and capture.stories is not None:
            count = len(capture.stories)
            self._merge(feed, stories, touched, capture.stories, now)
        jitter = int(hashlib.sha256(feed_id.encode()).hexdigest()[:2], 16) % 30
        failures = feed["failures"] + 1 if error else 0
        if error and failures == self.alert_after:
            out.append({"kind": "failing", "at": now, "failures": failures, "error": error})
            feed["reported"] = True
        if not error and (feed["failures"] >= self.alert_after or feed["reported"]):
            out.append({"kind": "recovered", "at": now, "failures": feed["failures"]})
            feed["reported"] = False
        wait = _delay(failures, 0) if error else int(capture.interval_s)
        feed |= {"failures": failures, "error": error, "last_attempt": now, "next_run": now + wait + jitter}
        if not error:
            feed["last_success"] = now
        out.append({"kind": "run", "at": now, "status": capture.status, "stories": count, "error": error, "version": feed["version"]})
        return out

    def _merge(self, feed: dict, stories: dict, touched: set, listed, now: int) -> None:
        """What the capture lists on top of the history, then retention; the feed's change times follow."""
        was = feed["last_changed"]
        at = was + 1 if was is not None and was >= now else now
        inserted, changed = set(), set()
        for story in listed:
            name, known = story["key"], stories.get(story["key"])
            texts = {c: story[c] for c in TEXTS}
            touched.add(name)
            if known is None:
                published = story["published"]
                stories[name] = {**texts, "published": now if published is None or pd.isna(published) else int(published), "first_seen": now, "last_seen": now, "last_changed": at}
                inserted.add(name)
            else:
                if any(known[c] != texts[c] for c in TEXTS):
                    changed.add(name)
                    known["last_changed"] = at
                known |= {**texts, "last_seen": now}
        ranked = sorted(stories, key=lambda k: (-stories[k]["published"], k.encode()))
        gone = ranked[self.keep :]
        for name in gone:
            del stories[name]
        fresh = inserted - set(gone)
        if fresh or changed - set(gone) or set(gone) - inserted or was is None:
            feed["last_changed"] = at
        if fresh:
            feed["last_new"] = now

    def close(self) -> None:
        pass


def refresh_changes(listings: DataFrame, keep: int = MAX_ITEMS, alert_after: int = ALERT_AFTER) -> DataFrame:
    """Listings and edits -> the change log of every batch.

    kind 'story' gives a story as it stands, 'removed' one that retention took, 'feed' the feed's row, 'run' a refresh,
    'failing' and 'recovered' alert edges, 'stale' a result of another recipe version, which leaves no other trace.
    """
    return listings.groupBy("feed_id").transformWithStateInPandas(FeedHistory(keep, alert_after), CHANGES, "update", "None")


def _latest(changes: DataFrame, kinds: tuple[str, ...], keys: list[str], columns: list[str]) -> DataFrame:
    rows = changes.filter(F.col("kind").isin(*kinds))
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct("kind", *columns), F.struct("batch", "turn")).alias("x"))
    return newest.filter(F.col("x.kind") == kinds[0]).select(*keys, *[f"x.{c}" for c in columns])


def items_after(changes: DataFrame) -> DataFrame:
    """The retained stories after all batches of the log."""
    return _latest(changes, ("story", "removed"), ["feed_id", "key"], STORY_NAMES)


def feeds_after(changes: DataFrame) -> DataFrame:
    names = [c if c != "last_changed" else "feed_changed" for c in FEED_NAMES]
    return _latest(changes, ("feed",), ["feed_id"], names).withColumnRenamed("feed_changed", "last_changed")
