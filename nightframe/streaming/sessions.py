"""Event clusters and nightly counts over a stream of events, with a watermark for late ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nightframe.functions.exprs import finite
from nightframe.operators.events import seconds


def read_events(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder; the query's checkpoint remembers which have been read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def stream_clusters(events: DataFrame, ts: str, duration: str, by: list[str], gap: float, late: str = "1 hour") -> DataFrame:
    """``by, cluster, start, end, count, total_sec``: the clusters of ``events.gap_clusters``, each as soon as no event can
    join it any more.

    Events of a subject wait in its state until the watermark has passed them and are then taken in order, so the gap runs
    from the end of the event before, as in the batch form. A timer closes a cluster whose subject has gone quiet. Events
    that come later than ``late`` are dropped by Spark, which counts them (``late_events``).
    """
    x = events.select(*by, F.col(ts).cast("timestamp").alias("_ts"), seconds(ts).alias("t"), F.coalesce(finite(duration), F.lit(0.0)).alias("dur")).filter("t is not null").withWatermark("_ts", late)
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name in by]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, number, begun, end, last, count, total = [], 0, None, None, None, 0, 0.0
        if state.exists:
            t, dur, number, begun, end, last, count, total = state.get
            waiting = list(zip(t, dur, strict=True))
        for pdf in frames:
            waiting += zip(pdf["t"].tolist(), pdf["dur"].tolist(), strict=True)
        passed, closed = state.getCurrentWatermarkMs() / 1000, []
        close = lambda: closed.append((*key, number, begun, end, count, total))
        for t, dur in sorted(w for w in waiting if w[0] <= passed):
            if last is None or t - last > gap:
                if count:
                    close()
                number, begun, end, count, total = number + 1, t, t + dur, 0, 0.0
            last, end, count, total = t + dur, max(end, t + dur), count + 1, total + dur
        waiting = sorted(w for w in waiting if w[0] > passed)
        if count and last + gap < passed:
            close()
            count, total = 0, 0.0
        state.update(([w[0] for w in waiting], [w[1] for w in waiting], number, begun, end, last, count, total))
        due = [w[0] for w in waiting[:1]] + ([last + gap] if count else [])
        if due:
            state.setTimeoutTimestamp(int(max(min(due), passed) * 1000) + 1)
        if closed:
            yield pd.DataFrame(closed, columns=[*by, "cluster", "start", "end", "count", "total_sec"])

    out = ", ".join([*keys, "cluster bigint, start double, end double, count bigint, total_sec double"])
    held = "t array<double>, dur array<double>, number bigint, begun double, end double, last double, count bigint, total double"
    return x.groupBy(*by).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def late_events(query: StreamingQuery) -> int:
    """How many events a query has dropped as too late, over the progress it still has."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def run_through(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream gives for all that is there now to the Parquet files of a folder."""
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def stream_nightly(events: DataFrame, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """Counts and means by calendar day."""
    days = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.to_date("w.start").alias("day"), "n", "mean")
