"""Streams that arrive in any order within the watermark, against the batch operators."""

import hashlib
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_stateful import DETECTIONS, detections
from tidemark.operators import answering, caches, stateful
from tidemark.operators import timeline as TL
from tidemark.streaming import in_order, timelines

END = 10.0**6


def streamed(spark, tmp_path, rows, schema, cuts=4, seed=0):
    """The rows in any order, a file a micro-batch; a timeline of its own drives the watermark past them at the end."""
    folder = tmp_path / "in"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = random.Random(seed).sample(rows, len(rows))
    end = tuple({"timeline_id": "~end", "t_sec": END, "seq": 0}.get(c) for c in names)
    parts = [rows[k::cuts] for k in range(cuts)] + [[end]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    raw = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return timelines.with_watermark(raw.withColumn("ts", F.timestamp_micros((F.col("t_sec") * 1_000_000 + 10**12).cast("long"))), "10000 seconds")


def run(spark, tmp_path, df, name, mode="append"):
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
    q = in_order.started(writer, spark)
    q.awaitTermination(300)
    assert q.exception() is None
    assert spark.conf.get(in_order.STORE[0], None) != in_order.STORE[1]
    return [r for r in spark.table(name).collect() if r.timeline_id != "~end"]


def test_context(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b"]), float(r.randint(0, 900)), k) for k in range(300)]
    schema = "timeline_id string, t_sec double, seq long"
    got = run(spark, tmp_path, in_order.context(streamed(spark, tmp_path, rows, schema), 300.0, 20), "context", "update")
    last = {}
    for x in got:
        assert x.n_context == len(x.seqs) <= 20
        last[x.timeline_id] = x  # rows of the memory sink are in order of micro-batches
    want = {}
    for x in TL.final_context(spark.createDataFrame(rows, schema), 300.0, 20).orderBy("t_sec", "seq").collect():
        want.setdefault(x.timeline_id, []).append(x.seq)
    assert {k: x.seqs for k, x in last.items()} == want


def test_context_sizes(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "b"]), float(r.choice([r.randint(0, 900), 50])), k) for k in range(400)]
    df = spark.createDataFrame(rows, "timeline_id string, t_sec double, seq long").repartition(3)
    want = []
    for t in ("hot", "b"):
        held = deque()
        for x in sorted((x for x in rows if x[0] == t), key=lambda x: (x[1], x[2])):
            held.append(x[1])
            while held[0] < x[1] - 60 or len(held) > 15:
                held.popleft()
            want.append((*x, len(held), held[-1] - held[0]))
    for pieces in (30, 10_000):
        assert sorted(map(tuple, TL.context_sizes(df, 60.0, 15, pieces).collect())) == sorted(want)


def test_trackers(spark, tmp_path):
    data = [x for x in detections(11, 250) if x[0] is not None]
    df = spark.createDataFrame(data, DETECTIONS)
    key = lambda rows: sorted((x.timeline_id, x.frame_idx, x.det_no, x.entity_id) for x in rows)
    stream = streamed(spark, tmp_path, data, DETECTIONS).where("timeline_id != '~end' or t_sec > 0").fillna({"frame_idx": 10**9, "det_no": 0, "entity_type": "end", "label": "end"})
    got = run(spark, tmp_path, in_order.track(stream, every_frame=True), "tracked")
    assert key(got) == key(stateful.track(df, every_frame=True).collect()) and len(got) == len(data)
    got = run(spark, tmp_path, in_order.lifecycle(stream), "lived")
    assert sorted(map(tuple, got)) == sorted(map(tuple, stateful.lifecycle(df).collect()))


def test_cooldown_and_caches(spark, tmp_path):
    r = random.Random(3)
    schema = "timeline_id string, t_sec double, seq long, source string, key string"
    rows = [(r.choice("ab"), r.randint(1, 200) / 4, k, r.choice(["visual", "audio"]), f"k{r.randint(0, 30)}") for k in range(200)]
    rows = [(t, float(k), k, s, c) for k, (t, _, _, s, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, schema)
    stream = streamed(spark, tmp_path, rows, schema)
    fired = run(spark, tmp_path, in_order.triggers(stream, 2.5, idle=100.0), "fired")
    assert sorted((x.timeline_id, x.seq) for x in fired) == sorted((x.timeline_id, x.seq) for x in stateful.triggers(df, 2.5).collect())
    for evicts in ("oldest", "least"):
        want = []
        for t in "ab":
            held = deque()
            for x in (x for x in rows if x[0] == t):
                hit = x[4] in [k for k, _ in held]
                want.append((t, x[2], hit))
                if not hit:
                    if len(held) == 10:
                        held.remove(min(held, key=lambda e: e[1]) if evicts == "least" else held[0])
                    held.append((x[4], x[2]))
        assert sorted((x.timeline_id, x.seq, x.hit) for x in caches.lookups(df, 10, evicts).collect()) == sorted(want) and any(x[2] for x in want)
    got = run(spark, tmp_path, in_order.cached(stream, 10), "cached")
    assert sorted((x.timeline_id, x.seq, x.hit) for x in got) == sorted((x.timeline_id, x.seq, x.hit) for x in caches.lookups(df, 10).collect())


def test_frame_keys(spark):
    rng = np.random.default_rng(1)
    frames = [rng.integers(0, 256, (20, 33, 3), dtype=np.uint8) for _ in range(3)]
    near = frames[0].copy()
    near[1, 1] += 1  # a pixel that the key doesn't see
    df = spark.createDataFrame([(k, bytearray(f.tobytes()), 20, 33) for k, f in enumerate([*frames, near])] + [(9, None, 20, 33), (10, bytearray(b"abc"), 20, 33)], "k int, p binary, h int, w int")
    got = {r.k: r.key for r in df.select("k", caches.frame_key(F.col("p"), F.col("h"), F.col("w")).alias("key")).collect()}
    assert got == {**{k: hashlib.md5(f[::8, ::8, :].tobytes()).hexdigest() for k, f in enumerate([*frames, near])}, 9: None, 10: None} and got[0] == got[3] != got[1]


@pytest.mark.parametrize("pieces", [20, 10_000])
def test_asked(spark, tmp_path, pieces):
    r = random.Random(pieces)
    schema = "timeline_id string, t_sec double, seq long, kind string, label string"
    rows = [(r.choice(["hot", "hot", "b"]), float(r.choice([r.randint(0, 600), r.randint(0, 60)])) / 2, k, r.choice(["context"] * 4 + ["question", "visual", "visual", "audio", "force", "other"]), r.choice(["boss", "roar", "", None])) for k in range(400)]
    want = []
    for t in ("hot", "b"):
        gate = answering.Gate(1.0, 20.0, 6)
        for x in sorted((x for x in rows if x[0] == t), key=lambda x: (x[1], gate.rank(x[3]), x[2])):
            out = gate.step(*x[1:])
            gate = answering.Gate(1.0, 20.0, 6).restore(gate.state())
            want += [(t, *out)] if out else []
    df = spark.createDataFrame(rows, schema).repartition(3)
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    moments = answering.asked(df, 1.0, 20.0, 6, pieces)
    assert key(moments.collect()) == key(want) and {x[3] for x in want} == {"visual", "audio", "force"} and any(x[5] == "boss" for x in want)
    if pieces == 20:
        stream = in_order.asked(streamed(spark, tmp_path, rows, schema), 1.0, 20.0, 6)
        seen = spark.sparkContext.accumulator(0)

        def model(frame):
            seen.add(len(frame))
            return frame.assign(answer=frame.question.str.upper())[["timeline_id", "t_sec", "seq", "answer"]]

        got = run(spark, tmp_path, answering.answered(stream, model, "timeline_id string, t_sec double, seq long, answer string"), "answered")
        assert key(got) == key((x[0], x[1], x[2], x[5].upper()) for x in want) and seen.value == len(want)
