"""The sequence operators over unbounded input: tracks and memory per clip, windows of event time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from gridloom.operators.suppress import CORNERS
from gridloom.operators.temporal import FOLDED, advance, fold_frames


class _Clip(StatefulProcessor):
    """What is common to operators that go along a clip: rows of one trigger, by frame; a timer that ends what no frame has reached for long."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def in_order(self, rows: Iterator[pd.DataFrame], timers: TimerValues) -> pd.DataFrame:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)
        return pd.concat(list(rows)).sort_values(["frame", "idx"], kind="stable")

    def close(self) -> None:
        pass


class _Tracks(_Clip):
    def __init__(self, idle: int, least: float, group: str):
        super().__init__(idle)
        self.least, self.group = least, group

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.boxes = handle.getMapState("boxes", "track long", "x0 double, y0 double, x1 double, y1 double")
        self.begun = handle.getValueState("begun", "tracks long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {int(k[0]): np.array(v, float) for k, v in self.boxes.iterator()}
        active, fresh = before, self.begun.get()[0] if self.begun.exists() else -1
        part = self.in_order(rows, timerValues)
        at, b, track = part["frame"].to_numpy(), part[CORNERS].to_numpy(float), np.full(len(part), -1)
        for i, j in itertools.pairwise([0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]):
            if fresh >= 0 and not active:
                break  # every track has ended, and no later box gets one
            got, active, fresh = advance(active, b[i:j], self.least, max(fresh, 0), fresh < 0)
            track[i:j] = got
        for k in before.keys() - active.keys():
            self.boxes.removeKey((k,))
        for k, box in active.items():
            self.boxes.updateValue((k,), tuple(map(float, box)))
        self.begun.update((int(fresh),))
        yield pd.DataFrame({self.group: key[0], "frame": at, "idx": part["idx"].to_numpy(), "track": track})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.boxes.clear()
        yield pd.DataFrame(columns=[self.group, "frame", "idx", "track"], dtype="int64")


class _Reseed(_Clip):
    def __init__(self, idle: int, rule: tuple, group: str):
        super().__init__(idle)
        self.rule, self.names = rule, [group, *(c.split()[0] for c in FOLDED.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.box = handle.getValueState("box", "x0 double, y0 double, x1 double, y1 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        box = np.array(self.box.get(), float) if self.box.exists() else None
        out, box = fold_frames(key[0], self.in_order(rows, timerValues), box, *self.rule)
        if box is not None:
            self.box.update(tuple(map(float, box)))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.box.clear()
        yield pd.DataFrame(columns=self.names)


def _stateful(spark: SparkSession) -> None:
    """State of several variables and timers is kept in RocksDB, whose changes go to the stream's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_tracks(frames: DataFrame, least: float = 0.1, group: str = "clip", idle: int = 3_600_000) -> DataFrame:
    """(clip, frame, idx, track) as frames arrive, whole and in order within a clip; the state is a map of the open tracks' boxes.

    Frames of one trigger are taken in order, so that results agree with the batch operator on the same rows, however clips
    are cut over triggers. A clip's tracks end when no frame has come for ``idle`` milliseconds.
    """
    _stateful(frames.sparkSession)
    return frames.groupBy(group).transformWithStateInPandas(_Tracks(idle, least, group), f"{group} long, frame long, idx long, track long", "append", "processingTime")


def stream_reseed(rows: DataFrame, every: int, least_score: float = 0.0, least_overlap: float = 0.5, group: str = "clip", idle: int = 3_600_000) -> DataFrame:
    """``temporal.reseed_fold`` as frames arrive, whole and in order within a clip: rows are those of ``temporal.frame_rows``.

    The state is the carried box; a clip that no frame has reached for ``idle`` milliseconds begins anew.
    """
    _stateful(rows.sparkSession)
    return rows.groupBy(group).transformWithStateInPandas(_Reseed(idle, (every, least_score, least_overlap), group), f"{group} long, {FOLDED}", "append", "processingTime")


def stream_memory(frames: DataFrame, value: str, recent: int = 3, group: str = "clip", order: str = "frame") -> DataFrame:
    """(clip, frame, anchor, recent): each clip's first value, which never leaves, and the last ``recent`` of those after it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, near = state.get if state.exists else (None, [])
        rows, near = [], list(near)
        for f, v in pd.concat(list(parts)).sort_values(order)[[order, value]].itertuples(index=False):
            if anchor is None:
                anchor = v
            else:
                near = (near + [v])[-recent:]
            rows.append((key[0], f, anchor, ",".join(map(str, near))))
        state.update((int(anchor), [int(v) for v in near]))
        yield pd.DataFrame(rows, columns=[group, order, "anchor", "recent"])

    return frames.groupBy(group).applyInPandasWithState(step, f"{group} long, {order} long, anchor long, recent string", "anchor long, recent array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Count and mean value by event-time window (tumbling, or sliding with ``slide``) and kind; rows later than ``late`` are let go."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def run_to_end(stream: DataFrame, path: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over all input there is, and reads what it wrote. ``path`` is a new folder that all machines share.

    Appended rows add up; of complete results, each replaces the one before. A stream with ``timers`` has no batches without
    input, which would go on for ever: no timer is due at the end of the input.
    """
    conf, empty = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(empty)
    if timers:
        conf.set(empty, "false")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":
        q = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out")).start()
    else:
        q = out.format("parquet").option("path", f"{path}/out").start()
    conf.set(empty, before)  # a query keeps the settings that it was started with
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
