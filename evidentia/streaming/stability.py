"""The stop rule of a live capture as a stream: state per key is the last value and the length of the calm run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stable_stops(stream: DataFrame, key: str, pos: str, value: str, cut: float, streak: int = 2) -> DataFrame:
    """(Z1) (key, stop_pos) once per key: where `streak` changes in a row were under the cut. Rows of a batch are taken in
    order of pos; state is three numbers per key, and a stopped key keeps only the mark that it has stopped."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, calm, done = state.get if state.exists else (None, 0, False)
        for g in (pd.concat(list(batches)).sort_values(pos, kind="stable"),):
            for p, v in zip(g[pos], g[value], strict=True):
                if done:
                    break
                calm = calm + 1 if last is not None and abs(v - last) < cut else 0
                last = float(v)
                if calm >= streak:
                    done = True
                    yield pd.DataFrame({key: [k[0]], "stop_pos": [int(p)]})
        state.update((last, calm, done))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, stop_pos long", "last double, calm int, done boolean", "append", GroupStateTimeout.NoTimeout)
