"""Progress while runs go on: a line for each finished attempt, as attempts come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINE = "run string, seq bigint, elapsed double, cost double, remaining bigint, eta double, cost_so_far double, projected_cost double"
#: Per run: attempts, known costs and their sum so far, how many attempts an ended run has made, and those that wait for earlier ones.
STATE = "attempted bigint, known bigint, total double, expected bigint, seq array<bigint>, elapsed array<double>, cost array<double>, pending array<bigint>"
_WAITING = ("seq", "elapsed", "cost", "pending")
#: Event time of the moment a run starts, in milliseconds: at 0 the first attempts would count as late.
_START = 10**12


def live_progress(finished: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What attempts.progress() gives, from a stream and in any order of arrival within `delay`.

    finished: run, seq, elapsed (seconds since the run's start, ascending with seq), cost (null where unknown), pending (the jobs that the
    run began with). An attempt's line comes once the watermark, the latest elapsed time less the delay, has passed it; attempts that come
    later than that are dropped. A row without seq says that the run has ended, and in `pending` how many attempts it made: once all of
    them are there, the rest of the lines comes at once. The state of a run is what waits: it grows with the delay, not with the run.
    """
    at = F.timestamp_millis(F.round(F.col("elapsed") * 1000).cast("bigint") + _START)
    own = finished.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("bigint").alias("seq"), F.col("elapsed").cast("double").alias("elapsed"), F.col("cost").cast("double").alias("cost"), F.col("pending").cast("bigint").alias("pending"), at.alias("at"))
    return own.withWatermark("at", delay).groupBy("run").applyInPandasWithState(_advanced, LINE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _advanced(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempted, known, total, expected, *held = state.get if state.exists else (0, 0, 0.0, None, [], [], [], [])
    parts = [pd.DataFrame(dict(zip(_WAITING, map(list, held), strict=True)))]
    if not state.hasTimedOut:
        for b in batches:
            ends = b[b["seq"].isna()]
            expected = int(ends["pending"].max()) if len(ends) else expected
            parts.append(b[b["seq"].notna()][list(_WAITING)])
    parts = [p for p in parts if len(p)] or parts[:1]
    waiting = pd.concat([p.astype({"seq": "int64", "elapsed": "float64", "cost": "float64", "pending": "int64"}) for p in parts]).sort_values("seq", kind="stable")
    passed = (waiting["elapsed"] * 1000).round() + _START <= state.getCurrentWatermarkMs()
    if expected is not None and attempted + len(waiting) >= expected:
        passed |= True
    ready, waiting = waiting[passed], waiting[~passed]
    if len(ready):
        n = attempted + np.arange(1, len(ready) + 1)
        paid = ready["cost"].to_numpy()
        sure = known + np.cumsum(~np.isnan(paid))
        spent = np.cumsum(np.concatenate([[total], np.nan_to_num(paid)]))[1:]  # in order, as a window adds
        left = np.maximum(ready["pending"].to_numpy() - n, 0)
        late = np.maximum(ready["elapsed"].to_numpy(), 0.0)
        so_far = np.where(sure > 0, spent, np.nan)
        yield pd.DataFrame(
            {
                "run": key[0], "seq": ready["seq"].to_numpy(), "elapsed": ready["elapsed"].to_numpy(), "cost": paid, "remaining": left,
                "eta": np.where(left > 0, late / n * left, 0.0), "cost_so_far": so_far, "projected_cost": so_far + so_far / np.maximum(sure, 1) * left,
            }
        )
        attempted, known, total = int(n[-1]), int(sure[-1]), float(spent[-1])
    state.update((attempted, known, total, expected, *[[None if x != x else x for x in waiting[c].tolist()] for c in _WAITING]))
    if len(waiting):
        state.setTimeoutTimestamp(int((waiting["elapsed"].min() * 1000).round()) + _START)
