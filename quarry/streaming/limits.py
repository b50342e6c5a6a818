"""The sliding-window limiter on a stream, with state that ends by itself."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.operators.limits import SlidingWindow


class Limiter(StatefulProcessor):
    """Per key the times admitted within the window; where `expire` is set, idle keys' state ends by itself."""

    def __init__(self, limit: int, window: float, expire: bool):
        self.limit, self.window, self.expire = limit, window, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.window * 10_000) if self.expire else None
        self.times = handle.getListState("times", StructType([StructField("t", DoubleType())]), ttlDurationMs=ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        window = SlidingWindow(self.limit, self.window, sorted(r[0] for r in self.times.get()))
        # A key's rows come in several Arrow batches in no order; the micro-batch, whose size the trigger bounds, is ordered whole.
        events = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        yield pd.DataFrame({"key": str(key[0]), "event_id": events.event_id, "allowed": [window.allow(t) for t in events.t]})
        self.times.put([(t,) for t in window.ring])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, limit: int = 10, window: float = 60.0, expire: bool = True) -> DataFrame:
    """A stream of (`key`, `event_id`, `t` in seconds) as (`key`, `event_id`, `allowed`), in order within each micro-batch.

    With `expire` state of idle keys ends after ten windows, which keeps an open-ended stream's
    state small. It makes Spark run batches without data, so a run over what is available now
    never ends by itself: leave it off there.
    """
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, window, expire),
        outputStructType="key string, event_id long, allowed boolean",
        outputMode="Append",
        timeMode="ProcessingTime" if expire else "None",
    )
