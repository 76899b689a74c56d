"""EWMA variance over a stream of returns: rows wait for the watermark, so late ones take their place in time.

Each series keeps its variance and the rows that the watermark has not passed. A timer at the earliest of them emits what
has become final in order of time, a step of the batch recursion each. State is as large as the lateness is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType, TimestampType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = StructType([StructField("t", TimestampType()), StructField("r", DoubleType())])


class _Ewma(StatefulProcessor):
    def __init__(self, decay: float, seed: float) -> None:
        self.decay, self.seed = decay, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.variance = handle.getValueState("variance", StructType([StructField("v", DoubleType())]))
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            part = part[part["t"].notna() & part["r"].notna()]
            if len(part):
                self.waiting.appendList([(t.to_pydatetime(), float(r)) for t, r in zip(part["t"], part["r"], strict=True)])
            for t in part["t"]:
                self.handle.registerTimer(_ms(t))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((pd.Timestamp(t), r) for t, r in self.waiting.get()), key=lambda x: x)
        final = [x for x in rows if _ms(x[0]) <= passed]
        if not final:
            return  # an earlier timer of the same trigger took them
        v = self.variance.get()[0] if self.variance.exists() else self.seed
        out = []
        for t, r in final:
            out.append((key[0], t, r, v**0.5))
            v = self.decay * v + (1 - self.decay) * r * r
        self.variance.update((v,))
        if len(final) < len(rows):
            self.waiting.put([(t.to_pydatetime(), r) for t, r in rows[len(final) :]])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["series", "t", "r", "volatility"])

    def close(self) -> None:
        pass


def _ms(t: pd.Timestamp) -> int:
    return -(-int(t.value) // 1_000_000) if t.tzinfo is not None else -(-int(t.tz_localize("UTC").value) // 1_000_000)


def ewma_stream(returns: DataFrame, decay: float = 0.94, seed: float = 1e-4, lateness: str = "1 day") -> DataFrame:
    """(series, t, r, volatility): the forecast before each return of a streaming panel whose t is a timestamp.

    Rows come out once the watermark, ``lateness`` behind the newest t, has passed them; equal times are taken by r. Rows
    that come later than that are dropped, and rows with a null t or r are passed over. The session's time zone has to be
    UTC, and state is kept in RocksDB, which this function chooses for the session.
    """
    spark = returns.sparkSession
    if spark.conf.get(_STORE, None) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)
    rows = returns.select("series", "t", "r").withWatermark("t", lateness)
    return rows.groupBy("series").transformWithStateInPandas(_Ewma(decay, seed), "series string, t timestamp, r double, volatility double", "Append", "EventTime")
