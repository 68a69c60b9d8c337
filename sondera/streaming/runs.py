"""Windows and detection runs over streams: the batch operators' results, with event-time watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_windows(samples: DataFrame, length: str, step: str, late: str) -> DataFrame:
    """Hop windows of a stream of (sta, ts, value): sta, start, n, total, peak; rows later than ``late`` are dropped by the watermark."""
    w = samples.withWatermark("ts", late).groupBy("sta", F.window("ts", length, step).alias("w"))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    return out.select("sta", F.col("w.start").alias("start"), "n", "total", "peak")


_RUN = "sta string, first double, last double, n_rows long, peak_t double, peak double"
_OPEN = "first double, last double, n long, peak_t double, peak double, hit boolean"


def stream_runs(beams: DataFrame, threshold: float, min_rows: int, gap: float) -> DataFrame:
    """Runs of rows above a threshold, from a stream of (sta, t, f) in order of time per station.

    The state of a station is its open run. A run ends with the first row at or
    below the threshold, or with a step of more than ``gap`` seconds; it is given
    out if it has ``min_rows`` rows. As in the batch form, the newest row of a
    station is not yet part of a finished run.
    """

    def step(key: tuple, found: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else [0.0, 0.0, 0, 0.0, 0.0, False]
        out = []

        def close() -> None:
            if run[5] and run[2] >= min_rows:
                out.append((key[0], *run[:2], run[2], *run[3:5]))
            run[2], run[5] = 0, False

        rows = pd.concat(list(found)).sort_values("t")
        for t, f in zip(rows["t"].tolist(), rows["f"].tolist(), strict=True):
            if run[5] and t - run[1] > gap:
                close()
            if f > threshold:
                if not run[5]:
                    run[:] = [t, t, 0, t, f, True]
                run[1], run[2] = t, run[2] + 1
                if f > run[4]:
                    run[3], run[4] = t, f
            else:
                close()
        state.update(tuple(run))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RUN.split(", ")])

    return beams.groupBy("sta").applyInPandasWithState(step, _RUN, _OPEN, "append", GroupStateTimeout.NoTimeout)
