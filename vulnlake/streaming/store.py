"""The latest content of every path as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..staging import free_names

#: The state store that keyed state with expiry needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """One value for each key: when its newest row was saved, the row's tie-breaker, how many rows came, how many of them too late."""

    def __init__(self, at: str, tie: str, columns: list[str], ttl_ms: int | None):
        self.at, self.tie, self.columns, self.ttl_ms = at, tie, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "saved_at long, tie string, saves long, late long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, saves, late, best = None, 0, 0, None
        if self.state.exists():
            at, tie, saves, late = self.state.get()
            newest = (at, tie)
        for frame in rows:
            order = list(zip(frame[self.at].tolist(), frame[self.tie].tolist(), strict=True))
            saves += len(order)
            late += sum(newest is not None and x <= newest for x in order)
            top = max(range(len(order)), key=order.__getitem__, default=None)
            if top is not None and (newest is None or order[top] > newest):
                newest, best = order[top], frame.iloc[[top]]
        if newest is not None:
            self.state.update((*newest, saves, late))
        if best is not None:
            yield best[self.columns].assign(saves=saves, late=late)

    def close(self) -> None:
        pass


def latest_contents(stream: DataFrame, key: str = "file", order: tuple[str, ...] = ("saved_at",), ttl_ms: int | None = None) -> DataFrame:
    """A stream of the rows that became the latest of their key, with saves (rows of the key so far) and late (those older than what was known).

    A row is newer by ``order``: a timestamp or integer first, then text or numbers. Only the order is kept as state, not the content, so a store of
    any number of paths stays small; rows go out in update mode, and whoever keeps the last one of each key has the latest contents. A row that comes
    late doesn't win, also after a restart from the checkpoint. With ``ttl_ms`` a key that is
    not seen for so long (processing time) is forgotten. Null keys and null times are left out.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``.
    """
    columns, names = stream.columns, free_names(stream.columns, "at", "tie", "of")
    first = order[0]
    at = F.unix_micros(F.col(first).cast("timestamp")) if dict(stream.dtypes)[first].startswith(("timestamp", "date")) else F.col(first).cast("long")
    padded = [F.when(F.lit(t in ("int", "bigint", "smallint", "tinyint")), F.lpad(F.col(c).cast("string"), 20, "0")).otherwise(F.col(c).cast("string")) for c, t in ((c, dict(stream.dtypes)[c]) for c in order[1:])]
    tie = F.concat_ws("\u0001", *padded) if padded else F.lit("")
    rows = stream.where(F.col(key).isNotNull() & F.col(first).isNotNull()).select(*columns, at.alias(names[0]), tie.alias(names[1]), F.col(key).alias(names[2]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields] + ["saves long", "late long"])
    processor = _Latest(names[0], names[1], columns, ttl_ms)
    return rows.groupBy(names[2]).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")
