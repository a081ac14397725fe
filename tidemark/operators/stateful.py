"""Greedy, order-dependent operators: trackers, entity lifecycles, trigger cooldowns.

What depends on order is a small step function over frames; in a stream it runs under state, in order of event time (see streaming.in_order). In batch a timeline is cut first where nothing can cross: by entity type, and where a type isn't seen for longer than it is remembered. The pieces run in parallel, and ids come from a prefix sum over the pieces' counters.
"""

from __future__ import annotations

import itertools
import math
from collections import OrderedDict, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


class Live:
    """The live entities of one kind by number: their box, when last seen, and a grid that finds the boxes near a box.

    Boxes over many cells are looked at always; a box that isn't finite overlaps nothing.
    """

    def __init__(self, cell: float = 128.0, most_cells: int = 64):
        self.cell, self.most_cells = cell, most_cells
        self.held: OrderedDict[int, tuple[tuple, int]] = OrderedDict()  # the longest unseen first
        self.cells: defaultdict[tuple, set[int]] = defaultdict(set)
        self.wide: set[int] = set()

    def _cells(self, box) -> list[tuple] | None:
        if not all(v is not None and math.isfinite(v) for v in box):
            return []
        x1, y1, x2, y2 = (math.floor(v / self.cell) for v in box)
        if (x2 - x1 + 1) * (y2 - y1 + 1) > self.most_cells:
            return None
        return [(x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)]

    def put(self, number: int, box, seen: int) -> None:
        if number in self.held:
            self.drop(number)
        self.held[number] = (tuple(box), seen)
        cells = self._cells(box)
        if cells is None:
            self.wide.add(number)
        else:
            for c in cells:
                self.cells[c].add(number)

    def drop(self, number: int) -> None:
        for c in self._cells(self.held.pop(number)[0]) or ():
            self.cells[c].discard(number)
            if not self.cells[c]:
                del self.cells[c]
        self.wide.discard(number)

    def best(self, box, threshold: float, may) -> int | None:
        """Of the entities that ``may(seen)``, the one that overlaps ``box`` most, over the threshold; the first of equals."""
        cells = self._cells(box) if threshold >= 0 else None
        near = self.held if cells is None else self.wide.union(*(self.cells[c] for c in cells if c in self.cells))
        best, most = None, threshold
        for number in sorted(near):
            held, seen = self.held[number]
            if may(seen) and (o := iou(box, held)) > most:
                best, most = number, o
        return best

    def forget(self, before: int) -> list[int]:
        """Drops what was last seen before ``before``."""
        gone = []
        while self.held and next(iter(self.held.values()))[1] < before:
            gone.append(next(iter(self.held)))
            self.drop(gone[-1])
        return gone


@dataclass
class Tracker:
    """Greedy tracking by overlap: each detection takes the free entity of its type that it overlaps most, over the threshold, or becomes a new one. An entity that more than ``max_missing`` frames have missed is lost."""

    threshold: float = 0.3
    max_missing: int = 10
    live: dict[str, Live] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    clock: int = 0
    last: int | None = None

    def step(self, detections: list[tuple[str, tuple]], frame: int | None = None) -> list[str]:
        """Ids of one frame's (type, box) detections. With a ``frame`` number, the frames since the last one were empty."""
        return [f"{kind}_{n:03d}" for (kind, _), n in zip(detections, self.numbers(detections, frame))]

    def numbers(self, detections: list[tuple[str, tuple]], frame: int | None = None) -> list[int]:
        self.advance(frame)
        return [self.number(kind, box) for kind, box in detections]

    def advance(self, frame: int | None = None) -> None:
        self.clock += 1 if frame is None or self.last is None else max(1, frame - self.last)
        if frame is not None:
            self.last = frame if self.last is None else max(frame, self.last)
        for kind in [k for k, live in self.live.items() if live.forget(self.clock - 1 - self.max_missing) and not live.held]:
            del self.live[kind]

    def number(self, kind: str, box) -> int:
        live = self.live.setdefault(kind, Live())
        n = live.best(box, self.threshold, lambda seen: seen < self.clock)
        if n is None:
            n = self.counts[kind] = self.counts.get(kind, 0) + 1
        live.put(n, box, self.clock)
        return n

    def state(self) -> dict:
        return {"clock": self.clock, "last": self.last, "counts": self.counts, "live": [[kind, n, *box, seen] for kind, live in self.live.items() for n, (box, seen) in live.held.items()]}

    def restore(self, state: dict) -> Tracker:
        self.clock, self.last, self.counts = state["clock"], state["last"], dict(state["counts"])
        for kind, n, *box, seen in state["live"]:
            self.live.setdefault(kind, Live()).put(n, box, seen)
        return self


@dataclass
class Lifecycle:
    """Entities of a label matched within ``memory`` frames: active, occluded after a gap, lost, terminated. Terminated ones leave."""

    threshold: float = 0.3
    memory: int = 30
    occlusion: int = 10
    lost: int = 30
    entities: dict = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    live: dict[str, Live] = field(default_factory=dict)

    def step(self, frame: int, detections: list[tuple[str, tuple]]) -> tuple[list[str], list[tuple[str, str]]]:
        """(ids, changes (entity, state)) of one frame. Several detections may match one entity; a terminated one is never matched."""
        ids, changes = [], []
        for label, box in detections:
            live = self.live.setdefault(label, Live())
            n = live.best(box, self.threshold, lambda seen: frame - seen <= self.memory)
            if n is None:
                n = self.counts.get(label, 0)
                self.counts[label] = n + 1
                self.entities[label, n] = "active"
                changes.append((f"{label}_{n:03d}", "active"))
            live.put(n, box, frame)
            if self.entities[label, n] != "active":
                self.entities[label, n] = "active"
                changes.append((f"{label}_{n:03d}", "active"))
            ids.append(f"{label}_{n:03d}")
        for (label, n), was in list(self.entities.items()):
            gap = frame - self.live[label].held[n][1]
            state = "active" if gap <= 0 else "occluded" if gap <= self.occlusion else "lost" if gap <= self.lost else "terminated"
            if state != was:
                self.entities[label, n] = state
                changes.append((f"{label}_{n:03d}", state))
            if state == "terminated":
                del self.entities[label, n]
                self.live[label].drop(n)
        return ids, changes

    def state(self) -> dict:
        return {"counts": self.counts, "entities": [[label, n, state, *self.live[label].held[n][0], self.live[label].held[n][1]] for (label, n), state in self.entities.items()]}

    def restore(self, state: dict) -> Lifecycle:
        self.counts = dict(state["counts"])
        for label, n, was, *box, seen in sorted(state["entities"], key=lambda e: e[-1]):
            self.entities[label, n] = was
            self.live.setdefault(label, Live()).put(n, box, seen)
        return self


@dataclass
class Cooldown:
    """What may fire: nothing within ``seconds`` of what fired before, nor of time 0."""

    seconds: float = 1.0
    last: float = 0.0

    def step(self, t: float) -> bool:
        if t - self.last < self.seconds:
            return False
        self.last = t
        return True


TRACKED = "timeline_id string, frame_idx bigint, t_sec double, det_no int, entity_type string, entity_id string, confidence double"
CHANGES = "timeline_id string, frame_idx bigint, entity_id string, state string"
BOX = ("x1", "y1", "x2", "y2")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where null equals null; the right side's keys go."""
    of = {k: ordered.name("key") for k in keys}
    return left.join(right.withColumnsRenamed(of), [F.col(k).eqNullSafe(F.col(v)) for k, v in of.items()], how).drop(*of.values())


def _numbered(rows: DataFrame, kind: str, first: int) -> Column:
    return F.format_string("%s_%03d", F.coalesce(kind, F.lit("None")), F.col("number") + F.col("offset") + first)


def _with_offsets(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (timeline_id, kind, piece, number from 0) with ``offset``: the numbers that earlier pieces of the timeline and kind have given."""
    keys = ["timeline_id", kind]
    given = rows.groupBy(*keys, "piece").agg((F.max("number") + 1).alias("given"))
    before = W.partitionBy(*keys).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    return _joined(rows, given.select(*keys, "piece", F.coalesce(F.sum("given").over(before), F.lit(0)).alias("offset")), [*keys, "piece"])


def track(detections: DataFrame, threshold: float = 0.3, max_missing: int = 10, every_frame: bool = False, rows: int = ordered.ROWS) -> DataFrame:
    """``detections`` (timeline_id, frame_idx, t_sec, det_no, entity_type, x1, y1, x2, y2, confidence) with ``entity_id``.

    Entities age by the frames looked at: those with detections, or with ``every_frame`` all, the numbers between being empty frames.

    Types don't meet, and an entity that more than ``max_missing`` frames have missed is lost; so a type's detections are cut where it was not seen for longer, each piece is tracked by itself, and numbers go on from the pieces before. What one task gets is a stretch of one type without such a gap.
    """
    kept = detections.select("timeline_id", "frame_idx", "t_sec", "det_no", "entity_type", *BOX, "confidence")
    if every_frame:
        aged = kept.withColumn("f", F.col("frame_idx"))
    else:  # the frames' places among those of their timeline
        frames = kept.select("timeline_id", "frame_idx").distinct()
        aged = _joined(kept, ordered.with_islands(frames, ["timeline_id"], ["frame_idx"], lambda row, last: F.lit(False), "f", ["frame_idx"], rows), ["timeline_id", "frame_idx"])
    near = lambda row, last: row("f") - last("f") - 1 <= max_missing
    pieces = ordered.with_islands(aged, ["timeline_id", "entity_type"], ["f", "det_no"], near, "piece", ["f"], rows)

    def make():
        tracker = Tracker(threshold, max_missing)

        def step(f, *box):
            if f != tracker.last:
                tracker.advance(f)
            return tracker.number("", box) - 1

        return step

    keys = ["timeline_id", "entity_type", "piece"]
    found = _with_offsets(ordered.walk(pieces, keys, ["f", "det_no"], ["f", *BOX], make, "number", "int"), "entity_type")
    return found.withColumn("entity_id", _numbered(found, "entity_type", 1)).select(*[x.split()[0] for x in TRACKED.split(", ")])


def lifecycle(detections: DataFrame, threshold: float = 0.3, memory: int = 30, occlusion: int = 10, lost: int = 30, rows: int = ordered.ROWS) -> DataFrame:
    """State changes (timeline_id, frame_idx, entity_id, state) of the entities behind detections (timeline_id, frame_idx, det_no, label, x1, y1, x2, y2).

    Only matching needs order: a label's detections are cut where it was not seen for more than ``memory`` frames, and each piece is matched by itself. What an entity turns into is known from its sightings and the timeline's frames: the first frame behind a sighting, the first that is more than ``occlusion`` frames behind and the first more than ``lost`` behind, each of them before it is seen again.
    """
    if occlusion > lost:
        raise ValueError("an entity is lost after it is occluded")
    frames = detections.select("timeline_id", "frame_idx").distinct()
    asked = frames.select("timeline_id", "frame_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("frame_idx") + d + 1).alias("from")) for k, d in enumerate((0, occlusion, lost))])).alias("q")).select("timeline_id", "frame_idx", "q.*")
    ahead = ordered.nearest(asked, frames, "timeline_id", "from", "frame_idx", "frame_idx", "forward", rows)
    then = ahead.groupBy("timeline_id", "frame_idx").agg(*[F.max(F.when(F.col("k") == k, F.col("state.frame_idx"))).alias(f"then{k}") for k in range(3)])
    kept = _joined(detections.select("timeline_id", "frame_idx", "det_no", "label", *BOX), then, ["timeline_id", "frame_idx"])
    near = lambda row, last: row("frame_idx") - last("frame_idx") <= memory
    pieces = ordered.with_islands(kept, ["timeline_id", "label"], ["frame_idx", "det_no"], near, "piece", ["frame_idx"], rows)

    def make():
        live, ends, given = Live(), {}, itertools.count()

        def step(f, end, *box):
            # Those out of memory go, and those that a frame before this one has terminated.
            for gone in [n for n, (_, seen) in live.held.items() if ends[n] < f or f - seen > memory] if memory > lost else live.forget(f - memory):
                if gone in live.held:
                    live.drop(gone)
                del ends[gone]
            n = live.best(box, threshold, lambda seen: True)
            if n is None:
                n = next(given)
            live.put(n, box, f)
            ends[n] = math.inf if end is None else end
            return n

        return step

    found = _with_offsets(ordered.walk(pieces, ["timeline_id", "label", "piece"], ["frame_idx", "det_no"], ["frame_idx", "then2", *BOX], make, "number", "int"), "label")
    seen = found.withColumn("entity_id", _numbered(found, "label", 0)).select("timeline_id", "entity_id", "frame_idx", "then0", "then1", "then2").distinct()
    w = W.partitionBy("timeline_id", "entity_id").orderBy("frame_idx")
    seen = seen.withColumn("again", F.lead("frame_idx").over(w)).withColumn("before", F.lag("then0").over(w))
    back = F.when(F.col("before").isNull() | (F.col("before") < F.col("frame_idx")), F.struct("frame_idx", F.lit("active").alias("state")))

    def turns(k: int) -> Column:
        at, gap = F.col(f"then{k}"), F.col(f"then{k}") - F.col("frame_idx")
        unseen = F.col("again").isNull() | (at < F.col("again"))
        new = at > F.col(f"then{k - 1}") if k else F.lit(True)
        state = F.when(gap <= occlusion, "occluded").when(gap <= lost, "lost").otherwise("terminated")
        return F.when(unseen & new & at.isNotNull(), F.struct(at.alias("frame_idx"), state.alias("state")))

    return seen.select("timeline_id", "entity_id", F.explode(F.array_compact(F.array(back, turns(0), turns(1), turns(2)))).alias("c")).select("timeline_id", "c.frame_idx", "entity_id", "c.state")


def triggers(candidates: DataFrame, seconds: float = 1.0, rows: int = ordered.ROWS) -> DataFrame:
    """Of candidates (timeline_id, t_sec, seq, source) those that fire: visual before audio at one time, then the cooldown.

    A candidate that nothing precedes for ``seconds`` fires whatever came before, so a timeline is cut there and the pieces run by themselves.
    """
    ranked = candidates.select("timeline_id", "t_sec", F.when(F.col("source") == "visual", 0).otherwise(1).alias("rank"), "seq", "source")
    pieces = ordered.with_islands(ranked, ["timeline_id"], ["t_sec", "rank", "seq"], lambda row, last: row("t_sec") - last("t_sec") < seconds, "piece", ["t_sec"], rows)

    def make():
        cool = Cooldown(seconds, -math.inf)

        def step(t):
            if cool.last == -math.inf and t < seconds:
                cool.last = 0.0
            return cool.step(t)

        return step

    fired = ordered.walk(pieces, ["timeline_id", "piece"], ["t_sec", "rank", "seq"], ["t_sec"], make, "fires", "boolean").where("fires")
    return fired.select("timeline_id", "t_sec", "seq", "source")


def track_summaries(tracked: DataFrame) -> DataFrame:
    """(timeline_id, entity_id, first_seen, last_seen, duration, n_frames, avg_confidence); the first observation's confidence does not count."""
    k = F.row_number().over(W.partitionBy("timeline_id", "entity_id").orderBy("t_sec", "det_no"))
    return tracked.withColumn("k", k).groupBy("timeline_id", "entity_id").agg(F.min("t_sec").alias("first_seen"), F.max("t_sec").alias("last_seen"), (F.max("t_sec") - F.min("t_sec")).alias("duration"), F.count("k").alias("n_frames"), F.avg(F.when(F.col("k") > 1, F.col("confidence"))).alias("avg_confidence"))


def state_counts(states: DataFrame) -> DataFrame:
    """Entities in each lifecycle state, none counting 0."""
    dim = states.sparkSession.createDataFrame([(s,) for s in ("active", "occluded", "lost", "terminated")], "state string")
    counts = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
