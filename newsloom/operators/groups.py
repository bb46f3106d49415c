"""Grouped ordering that holds when one group has a third of all rows.

Nothing here brings a whole group into one task. Top-n runs in two levels over a
salted group; running values are computed per (group, time chunk) and the chunk
summaries, whose number is bounded by elapsed time, carry state across chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
CHUNK_SECONDS = 6 * 3600


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, spread: list[str]) -> DataFrame:
    """The first ``n`` rows per group by a total order; ``spread`` columns split hot groups."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    partial = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n).drop("_n", "_salt")
    return ranked(partial, group, order, "_n").filter(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers; for groups already bounded (a page's cards, a retained history)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, spread: list[str], name: str = "n") -> DataFrame:
    """``top_n`` with the row's place in its group."""
    return ranked(top_n(df, group, order, n, spread), group, order, name)


def _chunk(ts: str) -> Column:
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / CHUNK_SECONDS)


def carry_forward(df: DataFrame, group: list[str], ts: str, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """The last non-null ``value`` at or (not inclusive) strictly before each row of its group."""
    frame = df.withColumn("_chunk", _chunk(ts)).withColumn("_value", value)
    inner = Window.partitionBy(*group, "_chunk").orderBy(ts, *order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = frame.withColumn("_local", F.last("_value", ignorenulls=True).over(inner))
    summary = frame.groupBy(*group, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(ts, *order))).alias("_tail")
    )
    across = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*group, "_chunk", F.last("_tail", ignorenulls=True).over(across).alias("_carry"))
    joined = local.join(carried, [*group, "_chunk"])
    return joined.withColumn(name, F.coalesce("_local", "_carry")).drop("_chunk", "_value", "_local", "_carry")


def streaks(
    df: DataFrame, group: list[str], ts: str, order: list[str], failed: Column, initial: Column | None = None
) -> DataFrame:
    """Adds ``streak`` (failures in a row up to and including a row; a success resets to 0),
    ``before`` (the streak just before the row) and ``succeeded`` (a success came earlier).

    ``initial`` is the streak each group starts with, as carried over from earlier rows.
    One pass gives all three, because every pass reads its input twice: rows and chunk summary.
    """
    inner = Window.partitionBy(*group, "_chunk").orderBy(ts, *order)
    last_ok = F.max(F.when(~F.col("_failed"), F.col("_rn")))
    local = (
        df.withColumn("_chunk", _chunk(ts))
        .withColumn("_failed", failed)
        .withColumn("_rn", F.row_number().over(inner))
        .withColumn("_ok", last_ok.over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_ok_before", last_ok.over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    )
    summary = local.groupBy(*group, "_chunk").agg(
        (F.max("_rn") - F.coalesce(F.max(F.when(~F.col("_failed"), F.col("_rn"))), F.lit(0))).alias("_tail"),
        F.bool_or(~F.col("_failed")).alias("_reset"),
    )
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Failures before the last chunk that saw a success do not count.
    carried = summary.withColumn("_sum", F.coalesce(F.sum("_tail").over(before), F.lit(0)))
    carried = carried.withColumn("_base", F.last(F.when(F.col("_reset"), F.col("_sum")), ignorenulls=True).over(before))
    carried = carried.select(
        *group, "_chunk", (F.col("_sum") - F.coalesce("_base", F.lit(0))).alias("_carry"), F.col("_base").isNull().alias("_fresh")
    )
    joined = local.join(carried, [*group, "_chunk"])
    start = F.lit(0) if initial is None else F.when(F.col("_fresh"), F.coalesce(initial, F.lit(0))).otherwise(0)
    reach = F.col("_carry") + start

    def count(last_ok: str, rows: Column) -> Column:
        return (rows - F.coalesce(F.col(last_ok), -reach)).cast("long")

    return (
        joined.withColumn("streak", count("_ok", F.col("_rn")))
        .withColumn("before", count("_ok_before", F.col("_rn") - 1))
        .withColumn("succeeded", F.col("_ok_before").isNotNull() | ~F.col("_fresh"))
        .drop("_chunk", "_failed", "_rn", "_ok", "_ok_before", "_carry", "_fresh")
    )


def _chunk_exits(pdf: pd.DataFrame, width: int, length: int) -> pd.DataFrame:
    """What a chunk makes of any window that was open before: the last window it opens, by the first second free to open one.

    Only seconds that can be the first one matter, and of neighbours with the same last window only the later.
    """
    seconds = np.sort(pdf["second"].to_numpy())
    following = np.searchsorted(seconds, seconds + width)
    last = np.arange(len(seconds))
    for i in range(len(seconds) - 1, -1, -1):
        if following[i] < len(seconds):
            last[i] = last[following[i]]
    chunk = int(pdf["chunk"].iloc[0])
    first = np.concatenate(([True], seconds[:-1] < chunk * length + width))
    seconds, last = seconds[first], seconds[last[first]]
    kept = np.concatenate((last[1:] != last[:-1], [True]))
    return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "chunk": [chunk], "seconds": [seconds[kept]], "lasts": [last[kept]]})


def _chain(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Chunk after chunk, from when on a window may open in it."""
    free, out = None, []
    for row in pdf.sort_values("chunk").itertuples(index=False):
        out.append((row.stream, row.chunk, free))
        at = 0 if free is None else int(np.searchsorted(row.seconds, free))
        if at < len(row.seconds):
            free = int(row.lasts[at]) + width
    return pd.DataFrame(out, columns=["stream", "chunk", "free"]).astype({"free": "Int64"})


def _anchor_fold(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    free = pdf["free"].iloc[0]
    current = None if pd.isna(free) else int(free) - width
    anchors = []
    for second in pdf["second"].sort_values():
        if current is None or second >= current + width:
            current = second
        anchors.append((second, current))
    out = pd.DataFrame(anchors, columns=["second", "anchor"])
    out["stream"] = pdf["stream"].iloc[0]
    return out[["stream", "second", "anchor"]]


def anchored_windows(events: DataFrame, stream: Column, ts: str, width: int) -> DataFrame:
    """Each event with the second that opened its window; a window opens at the first event it holds.

    Equal seconds are merged first. A chunk of time tells, for every moment at which a window may open again, which
    window it ends with; these tables, whose number follows elapsed time alone, are chained, and every chunk then places
    its own seconds. So no task holds more than one chunk, however long events come without a pause.
    """
    length = max(CHUNK_SECONDS, width)
    keyed = events.withColumn("stream", stream).withColumn("second", F.unix_timestamp(F.col(ts).cast("timestamp")))
    seconds = keyed.select("stream", "second").distinct().withColumn("chunk", F.floor(F.col("second") / length))
    tables = seconds.groupBy("stream", "chunk").applyInPandas(
        lambda pdf: _chunk_exits(pdf, width, length), "stream string, chunk long, seconds array<long>, lasts array<long>"
    )
    opened = tables.groupBy("stream").applyInPandas(lambda pdf: _chain(pdf, width), "stream string, chunk long, free long")
    placed = seconds.join(opened, ["stream", "chunk"]).groupBy("stream", "chunk")
    anchors = placed.applyInPandas(lambda pdf: _anchor_fold(pdf, width), "stream string, second long, anchor long")
    return keyed.join(anchors, ["stream", "second"])
