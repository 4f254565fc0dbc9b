"""Event time: sessions of a stream behind a watermark, and how many rows came too late for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour", values: dict[str, str] | None = None) -> DataFrame:
    """(key, started, ended, events, and sums of ``values``): sessions of each key, parted by pauses of at least ``gap``.

    Of a stream they come in append mode, each once, when the watermark (the latest time seen less ``delay``) has passed their end; rows behind the
    watermark are dropped. Of a table all sessions come. ``ended`` is the last event plus ``gap``. Partial sessions are merged in the tasks
    before the shuffle if spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is on.
    """
    sums = [F.sum(c).alias(n) for n, c in (values or {}).items()]
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, delay)
    # Borders are aggregates: a filter or join on the window itself would be pushed below the merging of sessions, and part them.
    borders = [F.min(at).alias("started"), (F.max(at) + F.expr(f"INTERVAL {gap}")).alias("ended")]
    grouped = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(*borders, F.count(F.lit(1)).alias("events"), *sums)
    return grouped.select(key, "started", "ended", "events", *(values or {}))


def closed(found: DataFrame, events: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Of the sessions of a table those that a stream of the same rows has put out once it has seen them all in time."""
    seen = events.agg(F.date_trunc("MILLISECOND", F.max(at) - F.expr(f"INTERVAL {delay}"))).first()[0]
    return found.where(F.col("ended") <= F.lit(seen))


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the query's state operators dropped behind the watermark, over the batches whose progress it still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
