"""Stateful operators over streams of rows that arrive in any order within the watermark.

A row waits in its timeline's state until the watermark has passed it; a timer then steps the waiting rows in order of time. So the results are those of the batch operators, however the stream is cut into micro-batches. All inputs need a watermarked column ``ts`` (see timelines.with_watermark), and Spark's RocksDB state store, which ``started`` sets for the query that it starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.answering import ASKED, Gate
from tidemark.operators.caches import Fifo
from tidemark.operators.stateful import BOX, Cooldown, Lifecycle, Tracker

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
US = "__us"


def started(writer, spark):
    """Starts a stream with the state store that these operators need; the session's own setting stays as it was."""
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        return writer.start()
    finally:
        if was is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], was)


class Steps(StatefulProcessor):
    """Steps a key's rows in order once the watermark has passed them.

    ``begin(state)`` gives a machine from its saved state, or a new one from None; it has ``rows(rows)``, an iterator of output tuples, and ``state()``, which JSON can hold. ``order`` is the key of a row's place among rows of its time. A key that had no row for ``idle`` seconds, and none waiting, is forgotten if ``idle`` is given.
    """

    def __init__(self, columns: T.StructType, output: T.StructType, begin, order, idle: float | None = None):
        self.columns, self.output, self.begin, self.order, self.idle = columns, output, begin, order, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.saved = handle.getValueState("saved", T.StructType([T.StructField("state", T.StringType()), T.StructField("last", T.LongType())]))

    @staticmethod
    def due(us: int) -> int:
        return -(-us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        names = self.columns.names
        new = [tuple(r[c] for c in names) for r in rows]
        if new:
            self.waiting.appendList(new)
            soonest = min(self.due(r[0]) for r in new)
            if all(t > soonest for t in self.handle.listTimers()):
                self.handle.registerTimer(soonest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        mark = timerValues.getCurrentWatermarkInMs()
        named = Row(*self.columns.names)
        held = [named(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        now = sorted((r for r in held if self.due(r[0]) <= mark), key=lambda r: (r[0], *self.order(r)))
        later = [tuple(r) for r in held if self.due(r[0]) > mark]
        saved = self.saved.get() if self.saved.exists() else None
        if now:
            machine = self.begin(json.loads(saved[0]) if saved else None)
            for out in machine.rows(now):
                yield Row(**dict(zip(self.output.names, (key[0], *out))))
            saved = (json.dumps(machine.state()), now[-1][0])
            self.saved.update(saved)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(min(self.due(r[0]) for r in later))
        elif saved and self.idle is not None:
            end = self.due(saved[1]) + int(self.idle * 1000)
            if end <= mark:
                self.saved.clear()
            else:
                self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def _stepped(rows: DataFrame, columns: list[str], output: str, begin, order, idle: float | None) -> DataFrame:
    held = rows.select("timeline_id", "ts", F.unix_micros("ts").alias(US), *columns)
    state = T.StructType([held.schema[c] for c in (US, *columns)])
    out = T.StructType.fromDDL(output)
    return held.groupBy("timeline_id").transformWithState(Steps(state, out, begin, order, idle), out, "append", "eventTime")


class _Cooling:
    def __init__(self, state, seconds: float):
        self.cool = Cooldown(seconds, state["last"] if state else 0.0)

    def rows(self, rows):
        for r in rows:
            if self.cool.step(r.t_sec):
                yield r.t_sec, r.seq, r.source

    def state(self):
        return {"last": self.cool.last}


def triggers(candidates: DataFrame, seconds: float = 1.0, idle: float | None = None) -> DataFrame:
    """What operators.stateful.triggers gives, over a stream of (timeline_id, ts, t_sec, seq, source)."""
    return _stepped(candidates, ["t_sec", "seq", "source"], "timeline_id string, t_sec double, seq bigint, source string", lambda state: _Cooling(state, seconds), lambda r: (r.source != "visual", r.seq), idle)


class _Tracking:
    def __init__(self, state, tracker: Tracker, every_frame: bool):
        self.tracker, self.every_frame = tracker.restore(state) if state else tracker, every_frame

    def rows(self, rows):
        for f, frame in groupby(rows, key=lambda r: r.frame_idx):
            own = list(frame)
            for r, i in zip(own, self.tracker.step([(r.entity_type, tuple(r[c] for c in BOX)) for r in own], f if self.every_frame else None)):
                yield f, r.det_no, i

    def state(self):
        return self.tracker.state()


def track(detections: DataFrame, threshold: float = 0.3, max_missing: int = 10, every_frame: bool = False, idle: float | None = None) -> DataFrame:
    """What operators.stateful.track gives, over a stream of its columns and ``ts``, the time of a frame. With ``idle``, a timeline that is forgotten numbers anew."""
    return _stepped(detections, ["frame_idx", "det_no", "entity_type", *BOX], "timeline_id string, frame_idx bigint, det_no int, entity_id string", lambda state: _Tracking(state, Tracker(threshold, max_missing), every_frame), lambda r: (r.frame_idx, r.det_no), idle)


class _Living:
    def __init__(self, state, life: Lifecycle):
        self.life = life.restore(state) if state else life

    def rows(self, rows):
        for f, frame in groupby(rows, key=lambda r: r.frame_idx):
            for entity, state in self.life.step(f, [(r.label, tuple(r[c] for c in BOX)) for r in frame])[1]:
                yield f, entity, state

    def state(self):
        return self.life.state()


def lifecycle(detections: DataFrame, idle: float | None = None, **limits) -> DataFrame:
    """What operators.stateful.lifecycle gives, over a stream of its columns and ``ts``, the time of a frame. Terminated entities leave the state."""
    return _stepped(detections, ["frame_idx", "det_no", "label", *BOX], "timeline_id string, frame_idx bigint, entity_id string, state string", lambda state: _Living(state, Lifecycle(**limits)), lambda r: (r.frame_idx, r.det_no), idle)


class _Caching:
    def __init__(self, state, cache: Fifo):
        self.cache = cache.restore(state) if state else cache

    def rows(self, rows):
        for r in rows:
            yield r.seq, r.key, self.cache.step(r.key, r.seq)

    def state(self):
        return self.cache.state()


def cached(frames: DataFrame, most: int = 100, evicts: str = "oldest", idle: float | None = None) -> DataFrame:
    """What operators.caches.lookups gives, over a stream of (timeline_id, ts, seq, key)."""
    return _stepped(frames, ["seq", "key"], "timeline_id string, seq bigint, key string, hit boolean", lambda state: _Caching(state, Fifo(most, evicts)), lambda r: (r.seq,), idle)


class _Gating:
    def __init__(self, state, gate: Gate):
        self.gate = gate.restore(state) if state else gate

    def rows(self, rows):
        for r in rows:
            out = self.gate.step(r.t_sec, r.seq, r.kind, r.label)
            if out:
                yield out

    def state(self):
        return self.gate.state()


def asked(frames: DataFrame, seconds: float = 1.0, window: float = 300.0, most: int = 2048, idle: float | None = None) -> DataFrame:
    """What operators.answering.asked gives, over a stream of (timeline_id, ts, t_sec, seq, kind, label): the moments that reach the model. The question that waits, the cooldown and the rolling context are the state."""
    return _stepped(frames, ["t_sec", "seq", "kind", "label"], f"timeline_id string, {ASKED}", lambda state: _Gating(state, Gate(seconds, window, most)), lambda r: (Gate.rank(r.kind), r.seq), idle)


class Context(StatefulProcessor):
    """Each timeline's newest rows: those within ``seconds`` of its newest, at most ``most``.

    Rows are kept as they come, and whatever the order, the newest are among the newest of those that have come; so nothing waits, and the state never has more than ``most`` rows. When the watermark has left the whole window behind, the state is empty again.
    """

    def __init__(self, seconds: float, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([T.StructField("us", T.LongType()), T.StructField("t_sec", T.DoubleType()), T.StructField("seq", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        held += [(r[US], r["t_sec"], r["seq"]) for r in rows]
        newest = max(t for _, t, _ in held)
        kept = sorted((r for r in held if r[1] >= newest - self.seconds), key=lambda r: (r[1], r[2]))[-self.most :]
        self.rows.put(kept)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(Steps.due(kept[-1][0]) + int(self.seconds * 1000) + 1)
        yield Row(timeline_id=key[0], newest=newest, n_context=len(kept), seqs=[r[2] for r in kept])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def context(rows: DataFrame, seconds: float = 300.0, most: int = 2048) -> DataFrame:
    """A stream of (timeline_id, ts, t_sec, seq) as (timeline_id, newest, n_context, seqs): a timeline's context after each micro-batch that it has rows in. Its last row is operators.timeline.final_context, in whatever order the rows came."""
    held = rows.select("timeline_id", "ts", F.unix_micros("ts").alias(US), "t_sec", "seq")
    out = T.StructType.fromDDL("timeline_id string, newest double, n_context int, seqs array<bigint>")
    return held.groupBy("timeline_id").transformWithState(Context(seconds, most), out, "update", "eventTime")
