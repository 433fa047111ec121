"""Windows of event time (tumbling, sliding, session) over tables and streams, and joins of two streams.

On a stream a watermark says how late a row may come. Rows that come later are dropped by a stage of their own before the
windows, one row at a time, so that their number is exact and a window never holds part of what was too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def tumbling(ts: str, length: str) -> Column:
    return F.window(ts, length)


def sliding(ts: str, length: str, step: str) -> Column:
    return F.window(ts, length, step)


def session(ts: str, gap: str) -> Column:
    return F.session_window(ts, gap)


def windowed(events: DataFrame, window: Column, by: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    """window_start, window_end, `by` and the aggregates of each window that has rows; null times lie in no window.

    Counts and sums of a window are made before its rows are shuffled, so a hot key costs a row for each of its windows
    and tasks.
    """
    named = [c.alias(n) for n, c in aggregates.items()]
    return events.groupBy(window.alias("w"), *by).agg(*named).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)


def on_time(events: DataFrame, ts: str, late: str, key: str) -> DataFrame:
    """A stream's rows but for those that come too late, one for each `key` that arrives within the time.

    A row is late if it is more than `late` behind the latest time of the batches up to the one before the last; rows that
    are less late are never dropped.
    """
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_stream(events: DataFrame, window: Callable[[str], Column], ts: str, late: str, key: str, by: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    """The windows of a stream for append mode: each comes once, when the watermark has passed its end.

    Without late rows the result is that of `windowed` over all rows, but for windows that are still open. The state holds
    open windows, and ids until the watermark passes them.
    """
    return windowed(on_time(events, ts, late, key), window(ts), by, aggregates)


class LateRows(StreamingQueryListener):
    """Counts what queries drop for being late, query by query; exact for streams that pass `on_time`."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self._batches: dict[str, set[int]] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = self._batches.setdefault(str(p.id), set())
        if p.batchId in seen and not p.numInputRows:
            return
        seen.add(p.batchId)
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + late_rows(p)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(progress) -> int:
    """Rows of one batch that came too late."""
    return sum(s["numRowsDroppedByWatermark"] if isinstance(s, dict) else s.numRowsDroppedByWatermark for s in (progress["stateOperators"] if isinstance(progress, dict) else progress.stateOperators))


def rows_held(query: StreamingQuery) -> int:
    """Rows that the query's state holds after its last batch."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] if isinstance(s, dict) else s.numRowsTotal for s in (last["stateOperators"] if isinstance(last, dict) else last.stateOperators)) if last else 0


def within_interval_stream(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, columns: dict[str, str], before: int, after: int, late: str, how: str = "inner") -> DataFrame:
    """Pairs of two streams as `timejoins.within_interval` gives them for tables; `how` is inner or left.

    Both sides are kept until the watermarks say that no partner can come any more; then a left row without a partner comes
    out with nulls, and its state goes. Rows of either side that are more than `late` behind are dropped.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how}")
    one = left.withWatermark(left_ts, late)
    two = right.select(F.col(on).alias("_k"), F.col(right_ts).alias("_at"), *(F.col(c).alias(n) for c, n in columns.items())).withWatermark("_at", late)
    near = F.expr(f"_k = {on} AND _at >= {left_ts} - INTERVAL {before} SECONDS AND _at <= {left_ts} + INTERVAL {after} SECONDS")
    return one.join(two, near, "leftOuter" if how == "left" else "inner").drop("_k", "_at")
