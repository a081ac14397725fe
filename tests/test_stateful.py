"""Trackers, lifecycles and cooldowns cut into pieces, against the plain steps over whole timelines."""

import math
import random
from itertools import groupby

import pytest

from tidemark.operators import stateful

DETECTIONS = "timeline_id string, frame_idx long, t_sec double, det_no int, entity_type string, label string, x1 double, y1 double, x2 double, y2 double, confidence double"


def detections(seed, n=500, frames=400):
    r = random.Random(seed)
    rows, no = [], {}
    for _ in range(n):
        f = r.choice([r.randint(0, frames), r.randint(0, 40)])
        t = r.choice(["hot", "hot", "hot", "other", None])
        no[t, f] = no.get((t, f), -1) + 1
        x, y, size = r.randint(-300, 300), r.randint(-200, 200), r.choice([40, 60, 90, 5000])
        box = (math.nan, 0.0, 1.0, 1.0) if r.random() < 0.02 else (float(x // 20 * 20), float(y // 20 * 20), float(x // 20 * 20 + size), float(y // 20 * 20 + size))
        kind = r.choice(["cat", "dog_2", "dog_2"])
        rows.append((t, f, f / 2, no[t, f], kind, kind, *box, r.random()))
    return rows


def frames_of(rows, timeline):
    own = sorted((x for x in rows if x[0] == timeline), key=lambda x: (x[1], x[3]))
    return [(f, list(g)) for f, g in groupby(own, key=lambda x: x[1])]


class SlowTracker:
    """Scans every live entity; ages them a frame at a time."""

    def __init__(self, threshold, max_missing):
        self.threshold, self.max_missing, self.boxes, self.missing, self.counts, self.last = threshold, max_missing, {}, {}, {}, None

    def empty(self):
        for k in list(self.missing):
            self.missing[k] += 1
            if self.missing[k] > self.max_missing:
                del self.missing[k], self.boxes[k]

    def step(self, found, frame):
        for _ in range(0 if frame is None or self.last is None else frame - self.last - 1):
            self.empty()
        self.last = frame
        for k in self.missing:
            self.missing[k] += 1
        taken, out = set(), []
        for kind, box in found:
            free = [(stateful.iou(box, b), -k[1], k) for k, b in self.boxes.items() if k[0] == kind and k not in taken]
            best = max((x for x in free if x[0] > self.threshold), default=None)
            if best is None:
                self.counts[kind] = self.counts.get(kind, 0) + 1
            k = best[2] if best else (kind, self.counts[kind])
            taken.add(k)
            self.boxes[k], self.missing[k] = box, 0
            out.append(f"{k[0]}_{k[1]:03d}")
        for k in [k for k, n in self.missing.items() if n > self.max_missing]:
            del self.missing[k], self.boxes[k]
        return out


@pytest.mark.parametrize(("seed", "rows", "every", "max_missing"), [(1, 10, True, 10), (2, 30, False, 10), (3, 10_000, True, 2), (4, 12, False, 0)])
def test_track(spark, seed, rows, every, max_missing):
    data = detections(seed)
    want = set()
    for t in ("hot", "other", None):
        tracker, again = SlowTracker(0.3, max_missing), stateful.Tracker(0.3, max_missing)
        for f, own in frames_of(data, t):
            found = [(x[4], x[6:10]) for x in own]
            ids = tracker.step(found, f if every else None)
            assert ids == again.step(found, f if every else None)
            again = stateful.Tracker(0.3, max_missing).restore(again.state())
            want |= {(t, f, x[3], i) for x, i in zip(own, ids)}
    got = stateful.track(spark.createDataFrame(data, DETECTIONS).repartition(3), max_missing=max_missing, every_frame=every, rows=rows)
    assert got.columns == [x.split()[0] for x in stateful.TRACKED.split(", ")]
    assert {(x.timeline_id, x.frame_idx, x.det_no, x.entity_id) for x in got.collect()} == want and len(want) == len(data)


def slow_lifecycle(frames, threshold, memory, occlusion, lost):
    """Every entity stays and is looked at in every frame."""
    entities, out = {}, []
    for f, own in frames:
        for x in own:
            label, box = x[5], x[6:10]
            near = [(stateful.iou(box, e["box"]), -k[1], k) for k, e in entities.items() if k[0] == label and e["state"] != "terminated" and f - e["last"] <= memory]
            best = max((x for x in near if x[0] > threshold), default=None)
            k = best[2] if best else (label, sum(1 for n in entities if n[0] == label))
            e = entities.setdefault(k, {"state": None})
            if e["state"] != "active":
                out.append((f, f"{k[0]}_{k[1]:03d}", "active"))
            e.update(state="active", last=f, box=box)
        for k, e in entities.items():
            gap = f - e["last"]
            state = "active" if gap <= 0 else "occluded" if gap <= occlusion else "lost" if gap <= lost else "terminated"
            if e["state"] not in ("terminated", state):
                e["state"] = state
                out.append((f, f"{k[0]}_{k[1]:03d}", state))
    return out


@pytest.mark.parametrize(("seed", "rows", "limits"), [(1, 10, (30, 10, 30)), (2, 10_000, (30, 10, 30)), (3, 25, (50, 3, 8)), (4, 8, (4, 2, 20))])
def test_lifecycle(spark, seed, rows, limits):
    data = detections(seed)
    want = []
    for t in ("hot", "other", None):
        frames = frames_of(data, t)
        slow = slow_lifecycle(frames, 0.3, *limits)
        want += [(t, *x) for x in slow]
        life, steps = stateful.Lifecycle(0.3, *limits), []
        for f, own in frames:
            steps += [(f, *x) for x in life.step(f, [(x[5], x[6:10]) for x in own])[1]]
            life = stateful.Lifecycle(0.3, *limits).restore(life.state())
        assert sorted(steps) == sorted(slow)
    got = stateful.lifecycle(spark.createDataFrame(data, DETECTIONS).repartition(3), 0.3, *limits, rows=rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and {x[-1] for x in want} == {"active", "occluded", "lost", "terminated"}


def test_cooldown_in_pieces(spark):
    r = random.Random(5)
    data = [(r.choice(["hot", "hot", "b"]), r.choice([r.randint(-10, 400) / 4, r.randint(0, 40) / 4]), k, r.choice(["visual", "audio"])) for k in range(400)]
    want = []
    for t in ("hot", "b"):
        last = 0.0
        for x in sorted((x for x in data if x[0] == t), key=lambda x: (x[1], x[3] != "visual", x[2])):
            if x[1] - last >= 1.0:
                last = x[1]
                want.append(x)
    df = spark.createDataFrame(data, "timeline_id string, t_sec double, seq long, source string").repartition(3)
    for rows in (9, 10_000):
        assert sorted(map(tuple, stateful.triggers(df, 1.0, rows).collect())) == sorted(want)


def test_a_hot_timeline_is_tracked_in_pieces(spark):
    """One timeline, seen now and then: its pieces are many and small, and its numbers go on."""
    data = [("hot", 40 * k + j, 0.0, 0, "cat", "cat", 0.0, 0.0, 10.0, 10.0, 1.0) for k in range(300) for j in range(3)]
    got = stateful.track(spark.createDataFrame(data, DETECTIONS), every_frame=True, rows=100)
    assert {(x.frame_idx, x.entity_id) for x in got.collect()} == {(40 * k + j, f"cat_{k + 1:03d}") for k in range(300) for j in range(3)}
