"""Change detection on indicator windows, with keyed state that expires by event time."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Functions of this module travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALERTS = "indicator string, window_start timestamp, n long, expected double, kind string"
STATE = "level double, last_end timestamp"


def step(level: float | None, n: int, weight: float, width: float) -> tuple[float, str | None]:
    """The smoothed level after a window of ``n`` events, and what kind of change the window is, if any: it is one if ``n`` is
    ``width`` roots of the level away from it. A first window sets the level."""
    if level is None:
        return float(n), None
    gap = n - level
    kind = None if abs(gap) <= width * math.sqrt(max(level, 1.0)) else "rise" if gap > 0 else "fall"
    return level + weight * gap, kind


def change_alerts(
    windows: DataFrame,
    indicator: str = "event_type",
    weight: float = 0.3,
    width: float = 3.0,
    silent_days: int = 3,
    lateness: str = "1 day",
) -> DataFrame:
    """Alerts (indicator, window_start, n, expected, kind) of a stream of closed windows (window_start, window_end,
    ``indicator``, n), as ``indicator_windows`` writes them to a table that this stream reads.

    Each indicator keeps a smoothed level of its counts. A window far from it is an alert of kind rise or fall. When
    the watermark is ``silent_days`` past an indicator's last window, a silent alert is given, for the end of that window,
    and its state goes; it starts anew with its next window. Windows of one batch are taken in order of time; they are closed
    in order, so batches follow each other in time as well, up to ``lateness``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            level, last_end = state.get
            state.remove()
            yield pd.DataFrame({"indicator": [key[0]], "window_start": [last_end], "n": [0], "expected": [level], "kind": ["silent"]})
            return
        level, last_end = state.get if state.exists else (None, None)
        found = []
        for row in pd.concat(list(batches)).sort_values("window_start").itertuples():
            if last_end is not None and row.window_start - last_end >= pd.Timedelta(days=silent_days):
                found.append((key[0], last_end, 0, level, "silent"))
                level = None
            expected, (level, kind) = level, step(level, row.n, weight, width)
            if kind:
                found.append((key[0], row.window_start, row.n, expected, kind))
            last_end = row.window_end
        state.update((level, last_end.to_pydatetime()))
        due = int(last_end.timestamp() * 1000) + silent_days * 86_400_000
        if due <= state.getCurrentWatermarkMs():  # the batch that closed the window went past its silence already
            found.append((key[0], last_end, 0, level, "silent"))
            state.remove()
        else:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(found, columns=["indicator", "window_start", "n", "expected", "kind"])

    rows = windows.withWatermark("window_end", lateness).selectExpr("window_start", "window_end", f"CAST(`{indicator}` AS string) AS indicator", "n")
    return rows.groupBy("indicator").applyInPandasWithState(update, ALERTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
