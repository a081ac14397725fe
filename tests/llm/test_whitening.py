"""Whitening against a plain decomposition."""

import math

import numpy as np

from tidemark.llm import whitening


def frame(spark, vectors, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int").repartition(parts)
    return df.withColumn("n", F.lit("x")).withColumn("component", F.lit("y")).withColumn("x", F.lit("z"))


def expected(vectors, most=32):
    x = np.floor(64 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    off = n * x - total
    c = off / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return (off.astype(object) ** 2).sum(1), c @ axes / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(40, 40))
    vectors = [(int(k), (rng.normal(size=40) @ mix + 50).tolist()) for k in range(300)]
    vectors += [(7, vectors[7][1]), (None, vectors[9][1])]
    odd = [(900, None), (901, [1.0] * 39 + [None]), (902, [math.nan] * 40), (903, [math.inf] + [0.0] * 39), (904, [-math.inf] + [0.0] * 39)]
    got = whitening.whiten(frame(spark, vectors + odd)).collect()
    deviation, white, explained = expected(vectors)
    assert len(got) == len(vectors) * 32 and {r.n for r in got} == {len(vectors)}
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1
    sign = {}
    for k in range(32):
        at = {r.vec_id: r for r in got if r.component == k + 1}
        own = [at[i] for i, _ in vectors]
        sign[k] = np.sign(own[0].whitened * white[0, k])
        assert np.allclose([r.whitened * sign[k] for r in own], white[:, k], atol=1e-8)
        assert [r.deviation for r in own] == deviation.tolist()
        assert all(abs(r.explained / explained[k] - 1) < 1e-9 for r in own)


def test_huge_entries_are_exact(spark):
    vectors = [(k, [float((k * 37) % 11) * 2**20, float(k), -float(k * k)]) for k in range(50)]
    got = whitening.whiten(frame(spark, vectors)).collect()
    deviation = expected(vectors)[0]
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got)
    vectors[0] = (0, [2.0**33, 0.0, 0.0])
    got, deviation = whitening.whiten(frame(spark, vectors)).collect(), expected(vectors)[0]
    assert deviation[0] >= 1 << 63 and all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got)


def test_flat_directions_and_short_vectors(spark):
    vectors = [(k, [float(k % 5), 2.0, float(k % 3)]) for k in range(30)] + [(30, [1.0]), (31, [])]
    got = whitening.whiten(frame(spark, vectors)).collect()
    padded = [(i, v + [0.0] * (3 - len(v))) for i, v in vectors]
    deviation, _, explained = expected(padded)
    assert len(got) == 32 * 3 and all(r.deviation == deviation[r.vec_id] for r in got)
    flat = whitening.whiten(frame(spark, [(k, [float(k % 5), 2.0, float(k % 3)]) for k in range(30)])).collect()
    assert {r.component for r in flat} == {1, 2} and flat[0].identity_error < 1e-9


def test_nothing_to_whiten(spark):
    for vectors in ([(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        df = whitening.whiten(frame(spark, vectors))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, [(1, [1.0])]).where("vec_id < 0")).collect() == []
