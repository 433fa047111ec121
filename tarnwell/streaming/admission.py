"""Sliding-window admission control: at most `limit` accepted requests of a key in any `window` seconds.

Rejected requests are not remembered, so they never prolong a block. This feedback makes the decision sequential within
a key; keys are independent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EXEMPT = ("/", "/api/health")


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Decisions on times in order, and the accepted times that still count."""
    log, out = deque(held), []
    for t in times:
        while log and t - log[0] >= window:
            log.popleft()
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out, list(log)


def _schema(requests: DataFrame, key: str) -> str:
    return f"event_id long, {key} {requests.schema[key].dataType.simpleString()}, ts timestamp, allowed boolean"


def _decided(pdf: pd.DataFrame, held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    return admit((pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist(), held, limit, window)


def admitted(requests: DataFrame, key: str = "user_id", limit: int = 60, window: float = 60.0) -> DataFrame:
    """requests(event_id, key, ts) -> event_id, key, ts, allowed; requests of a key in order of (ts, event_id).

    A key's requests stream through its task in sorted batches; what is held of them are `limit` times at most.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in frames:
            groups = [(k if pd.notna(k) else None, g) for k, g in pdf.groupby(key, sort=False, dropna=False)]
            out = []
            for k, g in groups:
                if not out and k != now or out:
                    held = []
                allowed, held = _decided(g, held, limit, window)
                now = k
                out.append(g.assign(allowed=allowed))
            if out:
                yield pd.concat(out)[["event_id", key, "ts", "allowed"]]

    rows = requests.select("event_id", key, F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, _schema(requests, key))


def admitted_stream(requests: DataFrame, key: str = "user_id", limit: int = 60, window: float = 60.0, late: str | None = None) -> DataFrame:
    """The same over a stream: the accepted times of a key are its state. Within a trigger requests are taken in order.

    `late` says how late a request may come. With it, a key's state goes once no request can still fall into the window of
    its last accepted one, which changes no decision; requests that come later than that are dropped. Without it requests
    may come at any time and states stay.
    """
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed, held = _decided(pdf, list(state.get[0]) if state.exists else [], limit, window)
        state.update((held,))
        if late is not None:
            state.setTimeoutTimestamp(max(int((held[-1] + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(allowed=allowed)[["event_id", key, "ts", "allowed"]]

    rows = requests.select("event_id", key, F.col("ts").cast("timestamp").alias("ts"))
    rows = rows if late is None else rows.withWatermark("ts", late)
    return rows.groupBy(key).applyInPandasWithState(run, _schema(requests, key), "held array<double>", "append", timeout)


def exempt(path: str) -> bool:
    return path in EXEMPT
