"""Work along time, cut into many small pieces, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, ordered
from tidemark.operators import timeline as TL

EVENTS = "timeline_id string, seq long, t_sec double, modality string, description string, priority int, duration double, entity_id string, confidence double"


def events(seed, n=600):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        t = float(r.choice([r.randint(0, 300), r.randint(0, 300), 77, 78]))
        rows.append((r.choice(["hot"] * 8 + ["a", None]), k, t, r.choice("vvvo"), r.choice(["x", "y", "Z", "w", None]), r.randint(0, 4), r.random() * 3, r.choice(["e", "e", None]), r.random()))
    return rows


def runs(rows, window):
    """(timeline, first seq, last seq, n) and the merged wording, one timeline after the other."""
    out, run = [], []
    for x in sorted(rows, key=lambda x: (str(x[0]), x[0] is None, x[2], x[1])):
        p = run[-1] if run else None
        if p and p[0] == x[0] and p[3] == x[3] and p[7] == x[7] and x[2] - p[2] <= window:
            run.append(x)
        else:
            out.append(run)
            run = [x]
    return [r for r in [*out, run] if r]


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_runs_of_a_hot_timeline(spark, rows):
    data = events(rows)
    df = spark.createDataFrame(data, EVENTS).repartition(3)
    for window in (0.0, 1.0):
        want = []
        for r in runs(data, window):
            texts = list(dict.fromkeys(x[4] for x in r if x[4] is not None))
            end = max(x[2] + x[6] for x in r)
            want.append((r[0][0], r[0][1], r[0][2], r[0][3], r[0][4] if len(r) == 1 else "; ".join(texts[:3]), min(x[5] for x in r), round(r[0][6] if len(r) == 1 else end - r[0][2], 9), r[0][7], max(x[8] for x in r), len(r)))
        got = [(*x[:6], round(x[6], 9), *x[7:]) for x in TL.merge_nearby(df, window, rows).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        numbered = TL.with_run(df, window, rows)
        assert numbered.columns == [*df.columns, "run"]
        per = {}
        for x in numbered.collect():
            per.setdefault(x.timeline_id, {}).setdefault(x.run, []).append((x.t_sec, x.seq))
        for runs_of in per.values():  # numbered from 1 in order of time
            assert sorted(runs_of) == list(range(1, len(runs_of) + 1))
            assert [min(runs_of[k]) for k in sorted(runs_of)] == sorted(map(min, runs_of.values()))


def test_a_hot_timeline_is_spread(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), (F.col("id") * 1.0).alias("t"))
    pieces = ordered.cut(df, ["k"], "t", "piece", 1000).groupBy("piece").count().collect()
    assert len(pieces) == 20 and max(p["count"] for p in pieces) <= 1001
    assert ordered.cut(df.withColumn("t", F.lit(1.0)), ["k"], "t", "piece", 1000).select("piece").distinct().count() == 1


@pytest.mark.parametrize("rows", [5, 40, 10_000])
def test_nearest(spark, rows):
    r = random.Random(rows)
    states = [(r.choice(["hot"] * 6 + ["a", "b"]), float(r.choice([r.randint(0, 200), r.randint(90, 110)])), k, f"s{k}") for k in range(300)] + [("hot", None, 900, "no time"), (None, 5.0, 901, "no key")]
    queries = [(r.choice(["hot"] * 6 + ["a", "c"]), k, r.choice([-50.0, 300.0, float(r.randint(0, 200)), r.randint(0, 400) / 2])) for k in range(200)] + [("hot", 500, None), (None, 501, 5.0), ("hot", 7, queries7 := 12.0), ("hot", 7, queries7)]
    s = spark.createDataFrame(states, "entity_id string, t_sec double, seq long, state string").repartition(3)
    q = spark.createDataFrame(queries, "entity_id string, query_id long, t_query double").repartition(2)
    own = {}
    for x in states:
        if x[1] is not None:
            own.setdefault(x[0], []).append(x)

    def best(k, t, direction):
        near = [x for x in own.get(k, ()) if t is not None and (direction == "nearest" or (x[1] <= t if direction == "backward" else x[1] >= t))]
        return min(near, key=lambda x: (abs(x[1] - t), x[2]), default=None)

    want = [(k, i, t, *b[1:]) for k, i, t in queries if k is not None and (b := best(k, t, "nearest"))]
    assert sorted(map(tuple, joins.nearest_state(q, s, "entity_id", rows=rows).collect())) == sorted(want)
    for direction in ("backward", "forward"):
        got = ordered.nearest(q, s, "entity_id", "t_query", "t_sec", "seq", direction, rows)
        want = [(k, i, t, b and b[2]) for k, i, t in queries for b in (best(k, t, direction),)]
        assert sorted(str((x.entity_id, x.query_id, x.t_query, x.state and x.state.seq)) for x in got.collect()) == sorted(map(str, want))
    assert ordered.nearest(q, s.where("seq < 0"), "entity_id", "t_query", "t_sec", "seq").where("state is not null").count() == 0
    assert ordered.nearest(q.where("query_id < 0"), s, "entity_id", "t_query", "t_sec", "seq").count() == 0
