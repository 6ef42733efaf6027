"""Early stopping over a stream of ``(run, epoch, loss)``, with the same result as the batch window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "best double, last long, seen long, stop long"


def stop_patience_stream(log: DataFrame, patience: int, run_type: str = "long") -> DataFrame:
    """``run, stop_epoch`` once for each run, when ``patience`` epochs have brought no new minimum. Epochs of a run come in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, last, seen, stop = state.get if state.exists else (float("inf"), 0, 0, -1)
        was = stop
        for pdf in batches:
            for epoch, loss in pdf.sort_values("epoch")[["epoch", "loss"]].itertuples(index=False):
                seen += 1
                if loss < best:
                    best, last = loss, seen
                if stop < 0 and seen - last >= patience:
                    stop = int(epoch)
        state.update((float(best), int(last), int(seen), int(stop)))
        if was < 0 <= stop:
            yield pd.DataFrame({"run": [key[0]], "stop_epoch": [stop]})

    return log.groupBy("run").applyInPandasWithState(step, f"run {run_type}, stop_epoch long", STATE, "append", GroupStateTimeout.NoTimeout)
