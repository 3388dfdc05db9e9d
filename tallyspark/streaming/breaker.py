"""Streaming forms of the run monitors (an extension: the batch forms define the results)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failure_runs(calls: DataFrame, most: int = 100) -> DataFrame:
    """(model_id, seq): the call at which a model has failed ``most`` times in a row; once for each model.

    State is two numbers a model. Calls of a model must arrive in order of seq across batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, dropped = state.get if state.exists else (0, False)
        out = []
        for r in pd.concat(frames).sort_values("seq").itertuples():
            run = run + 1 if r.failed else 0
            if run >= most and not dropped:
                dropped = True
                out.append((key[0], int(r.seq)))
        state.update((int(run), bool(dropped)))
        yield pd.DataFrame(out, columns=["model_id", "seq"])

    return calls.select("model_id", "seq", "failed").groupBy("model_id").applyInPandasWithState(step, "model_id string, seq long", "run int, dropped boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_progress(calls: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls and failures by model and window of event time; late rows beyond the watermark are left out."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", width), "model_id")
    return w.agg(F.count("*").alias("calls"), F.sum("failed").alias("failures")).select(F.col("window.start").alias("start"), "model_id", "calls", "failures")
