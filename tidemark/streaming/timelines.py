"""Streams of timeline events: (timeline_id, seq, ts timestamp, modality, ...)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.stateful import Cooldown, Tracker


def with_watermark(events: DataFrame, lateness: str = "1 hour", column: str = "ts") -> DataFrame:
    """Times without a zone get one first, as watermarks need it."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def segments(events: DataFrame, length: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """(timeline_id, start, end, event_count): tumbling windows, or sliding ones."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy("timeline_id", w.alias("w")).agg(F.count(F.lit(1)).alias("event_count")).select("timeline_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_count")


def sessions(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Runs of one modality with gaps below ``gap``. A gap of exactly that length parts them, where batch runs join."""
    return events.groupBy("timeline_id", "modality", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("timeline_id", "modality", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose content hash has not come within the watermark."""
    return frames.dropDuplicatesWithinWatermark(keys)


FIRED = "timeline_id string, ts double, seq bigint, source string"


def triggers(candidates: DataFrame, seconds: float = 1.0) -> DataFrame:
    """The cooldown of operators.stateful over a stream: candidates (timeline_id, t_sec, seq, source) of a micro-batch are taken in order of time; in_order.triggers takes them in any order within the watermark."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cool = Cooldown(seconds, state.get[0] if state.exists else 0.0)
        rows = pd.concat(list(batches))
        rows = rows.assign(rank=(rows.source != "visual").astype(int)).sort_values(["t_sec", "rank", "seq"], kind="stable")
        fired = rows[[cool.step(t) for t in rows.t_sec]]
        state.update((cool.last,))
        yield pd.DataFrame({"timeline_id": key[0], "ts": fired.t_sec, "seq": fired.seq, "source": fired.source})

    return candidates.groupBy("timeline_id").applyInPandasWithState(step, FIRED, "last double", "append", GroupStateTimeout.NoTimeout)


TRACKED = "timeline_id string, frame_idx bigint, det_no int, entity_id string"
def track(detections: DataFrame, threshold: float = 0.3, max_missing: int = 10, every_frame: bool = False) -> DataFrame:
    """The tracker of operators.stateful over a stream whose frames come in order; in_order.track takes them in any order within the watermark."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(threshold, max_missing)
        if state.exists:
            tracker.restore(json.loads(state.get[0]))
        rows = pd.concat(list(batches)).sort_values(["frame_idx", "det_no"], kind="stable")
        ids: list[str] = []
        for f, frame in rows.groupby("frame_idx", sort=True):
            ids += tracker.step([(r.entity_type, (r.x1, r.y1, r.x2, r.y2)) for r in frame.itertuples()], int(f) if every_frame else None)
        state.update((json.dumps(tracker.state()),))
        yield pd.DataFrame({"timeline_id": key[0], "frame_idx": rows.frame_idx, "det_no": rows.det_no, "entity_id": ids})

    return detections.groupBy("timeline_id").applyInPandasWithState(step, TRACKED, "state string", "append", GroupStateTimeout.NoTimeout)
