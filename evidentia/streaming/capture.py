"""The control of a live capture, as a batch and as a stream with the same decisions.

A capture's frames come with how much of the picture changed. No change twice in a row is the end; little change makes the next step
longer, much makes it shorter. The stream keeps a few numbers per capture, written to the checkpoint, so a restart goes on where
it stopped; a capture that hears nothing for a while is closed and its state given back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.greedy import all_columns, by_group


@dataclass(frozen=True)
class Control:
    """Fixed values of the rule, but for the limit of frames and the idle time, which belong to the installation."""

    start: int = 110
    low: int = 45
    high: int = 180
    calm: float = 0.0008
    little: float = 0.018
    much: float = 0.20
    streak: int = 2
    limit: int = 400
    idle_ms: int = 3_600_000

    def begin(self) -> tuple[int, int, int, bool]:
        """(step, calm frames in a row, frames seen, closed)."""
        return self.start, 0, 0, False

    def advance(self, state: tuple[int, int, int, bool], ratio: float | None) -> tuple[tuple[int, int, int, bool], str]:
        """The state after a frame and what to do with it: save, wait, end, limit (the frame is one too many: the capture is closed
        and incomplete), or closed for frames after that. A frame without a ratio is saved and changes nothing."""
        step, calm, seen, closed = state
        if closed:
            return state, "closed"
        if seen >= self.limit:
            return (step, calm, seen, True), "limit"
        if ratio is not None and ratio < self.calm:
            if calm + 1 >= self.streak:
                return (step, calm + 1, seen + 1, True), "end"
            return (self._within(step * 1.20), calm + 1, seen + 1, False), "wait"
        if ratio is not None and ratio < self.little:
            step = self._within(step * 1.25)
        elif ratio is not None and ratio > self.much:
            step = self._within(step * 0.75)
        return (step, 0, seen + 1, False), "save"

    def _within(self, step: float) -> int:
        return min(self.high, max(self.low, round(step)))


def captured(df: DataFrame, key: str, pos: str, ratio: str, control: Control = Control()) -> DataFrame:  # noqa: B008
    """(Z1, Z2) (key, pos, action, step) of every frame of a capture, in order of pos."""

    def run(rows: list[tuple]) -> list:
        state, out = control.begin(), []
        for (r,) in rows:
            state, action = control.advance(state, r)
            out.append((action, state[0]))
        return out

    return by_group(df.select(key, pos, ratio), [key], all_columns(df.select(key, pos, ratio), pos), [ratio], run, "action string, step int").select(key, pos, "action", "step")


class _Capture(StatefulProcessor):
    def __init__(self, key: str, pos: str, ratio: str, control: Control):
        self.key, self.pos, self.ratio, self.control = key, pos, ratio, control

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("capture", "step int, calm int, seen int, closed boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        state, last = (tuple(held[:4]), held[4]) if held else (self.control.begin(), None)
        out = []
        frames = pd.concat(list(rows)).sort_values([self.pos, self.ratio], kind="stable", na_position="first")
        for pos, ratio in zip(frames[self.pos].tolist(), frames[self.ratio].tolist(), strict=True):
            if last is not None and pos < last:
                out.append((key[0], pos, "late", state[0]))
                continue
            state, action = self.control.advance(state, None if ratio is None or ratio != ratio else ratio)
            last = pos
            out.append((key[0], pos, action, state[0]))
        self.state.update((*state, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.control.idle_ms)
        yield pd.DataFrame(out, columns=[self.key, self.pos, "action", "step"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            step, _, _, closed, last = self.state.get()
            self.state.clear()
            if not closed:
                yield pd.DataFrame([(key[0], last, "expired", step)], columns=[self.key, self.pos, "action", "step"])

    def close(self) -> None:
        pass


def capturing(stream: DataFrame, key: str, pos: str, ratio: str, control: Control = Control()) -> DataFrame:  # noqa: B008
    """(Z1, Z2) The same of a stream: frames of a micro-batch go by pos, frames that come after later ones are late and change nothing,
    and captures without frames for idle_ms are expired. Needs the RocksDB state store."""
    kinds = stream.select(key, pos, ratio).withColumn(pos, F.col(pos).cast("long")).withColumn(ratio, F.col(ratio).cast("double"))
    out = T.StructType([kinds.schema[key], T.StructField(pos, T.LongType()), T.StructField("action", T.StringType()), T.StructField("step", T.IntegerType())])
    return kinds.groupBy(key).transformWithStateInPandas(_Capture(key, pos, ratio, control), out, "append", "processingTime")
