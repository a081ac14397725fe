"""Feature caches, outputs of one run, seeded samples, folders of videos."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus, graph, records
from tidemark.sources import feature_cache, loaders


def test_feature_cache(spark, tmp_path):
    cache = feature_cache.FeatureCache(spark, str(tmp_path / "c"))
    rows = spark.createDataFrame([("a", "/a", 1), ("a", "/a", 2), ("b", "/b", 3), ("c", "/c", 4)], "video_hash string, video_path string, x int")
    asked = spark.createDataFrame([("a", 1), ("z", 2)], "video_hash string, n int")
    assert cache.load().collect() == [] and [r.cached for r in cache.has(asked).collect()] == [False, False] and cache.statistics().first().num_cached_videos == 0
    cache.invalidate(asked)
    cache.save(rows, 1.0)
    assert {r.video_hash: r.cached for r in cache.has(asked).collect()} == {"a": True, "z": False}
    newer = feature_cache.FeatureCache(spark, str(tmp_path / "c"), "2.0")
    newer.save(rows.where("video_hash = 'a' and x = 1").withColumn("x", F.lit(9)), 2.0)
    newer.invalidate(rows.where("video_hash = 'b'"))
    assert sorted((r.video_hash, r.x, r.stale) for r in newer.load().collect()) == [("a", 9, False), ("c", 4, True)]
    assert [r.x for r in newer.load(asked).collect()] == [9]
    assert tuple(newer.statistics().first()) == (2, 2, 1) and {(r.video_hash, r.saved_at, r.version) for r in newer.index().collect()} == {("a", 2.0, "2.0"), ("c", 1.0, "1.0")}
    newer.save(rows.where("video_hash <> 'b'"), 3.0)
    newer.clean()
    assert sorted(r.x for r in newer.load().collect()) == [1, 2, 4]
    # A save that was lost before its index was committed is not seen.
    (tmp_path / "c/index/part=9").mkdir()
    assert sorted(r.x for r in newer.load().collect()) == [1, 2, 4]


def test_one_run_for_all_outputs(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(50, numPartitions=2).mapInArrow(count, "id long")
    feature_cache.write_outputs(rows, str(tmp_path / "o"), {"even": lambda d: d.where("id % 2 = 0"), "sum": lambda d: d.agg(F.sum("id").alias("s"))})
    assert seen.value == 50 and feature_cache.read_output(spark, str(tmp_path / "o"), "even").count() == 25 and feature_cache.read_output(spark, str(tmp_path / "o"), "sum").first().s == 1225
    with pytest.raises(RuntimeError):
        feature_cache.write_outputs(rows, str(tmp_path / "p"), {"even": lambda d: d, "bad": lambda d: (_ for _ in ()).throw(RuntimeError("no"))})
    with pytest.raises(ValueError, match="not complete"):
        feature_cache.read_output(spark, str(tmp_path / "p"), "even")


def test_seeded_samples(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 5 else f"s{k % 3}") for k in range(500)], "id long, stratum string")
    order = lambda seed: lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
    want = set()
    for s in ("hot", "s0", "s1", "s2"):
        want |= set(sorted((k for k in range(500) if ("hot" if k % 5 else f"s{k % 3}") == s), key=order("x"))[:40])
    for parts in (1, 7):
        assert {r.id for r in corpus.sampled(rows.repartition(parts), ["stratum"], "id", 40, "x", 8).collect()} == want
        assert [r.id for r in corpus.shuffled_head(rows.repartition(parts), "id", 9).collect()] == sorted(range(500), key=order("42"))[:9]
    assert corpus.shuffled_head(rows, "id", 1000).count() == 500


def test_training_samples_say_what_is_near(spark):
    events = spark.createDataFrame([("v", 1.0, 0, "a"), ("v", 2.0, 1, ""), ("v", 2.5, 2, "b"), ("v", 4.0, 3, None), ("v", 9.0, 4, "c")], "timeline_id string, t_sec double, seq long, description string")
    images = spark.createDataFrame([("v", 1, 3.0), ("w", 2, 3.0)], "timeline_id string, emb_id long, t_emb double")
    clips = spark.createDataFrame([("v", 1, 1.0, 9.0), ("v", 2, 5.0, 6.0)], "timeline_id string, clip_id long, start double, end double")
    got = {(r.modality, r.emb_id): (r.context, r.target) for r in corpus.training_samples(images, clips, clips, events, events).collect()}
    assert got["siglip", 1] == ("b", "At timestamp 3.0s, the visual analysis shows: b") and got["siglip", 2][0] == "Visual content detected"
    assert got["videomae", 1] == ("a; b; c", "From 1.0s to 9.0s, the temporal analysis shows: a; b; c") and got["videomae", 2][0] == "Temporal video segment"
    assert got["wav2vec2", 1] == ("a b c", "Audio from 1.0s to 9.0s: a b c") and got["wav2vec2", 2][0] == "Audio segment detected"


def long_samples(spark):
    """Samples of clips so long that there can't be a row for each minute, beside short ones."""
    events = spark.createDataFrame([("v", float(t), k, f"e{k}") for k, t in enumerate((0, 59.5, 60, 3e11, 1e12, 1e12 + 1))] + [("w", 5.0, 6, "far")], "timeline_id string, t_sec double, seq long, description string")
    images = spark.createDataFrame([("v", 1, 60.0)], "timeline_id string, emb_id long, t_emb double")
    clips = spark.createDataFrame([("v", 1, 0.0, 1e12), ("v", 2, 59.5, 60.0), ("v", 3, 60.0, 60.0), ("v", 4, 1.0, 1e6), ("v", 5, 9.0, 8.0), ("v", 6, None, 8.0)], "timeline_id string, clip_id long, start double, end double")
    return corpus.training_samples(images, clips, clips, events, events)


def test_training_samples_of_long_clips(spark):
    got = {(r.modality, r.emb_id): r.context for r in long_samples(spark).collect()}
    assert got["siglip", 1] == "e1; e2" and [got["videomae", k] for k in range(1, 5)] == ["e0; e1; e2; e3; e4", "e1; e2", "e2", "e1; e2"]
    assert [got["wav2vec2", k] for k in range(1, 7)] == ["e0 e1 e2 e3 e4", "e1 e2", "e2", "e1 e2", "Audio segment detected", "Audio segment detected"]


def test_training_samples_round_times_as_printf_does(spark):
    times = (148979.65, 878622.25, 914297.75, 2031978.05)
    none = spark.createDataFrame([], "timeline_id string, t_sec double, seq long, description string")
    images = spark.createDataFrame([*(("v", k, t) for k, t in enumerate(times)), ("v", 9, None)], "timeline_id string, emb_id long, t_emb double")
    clips = spark.createDataFrame([*(("v", k, t, t + 86400) for k, t in enumerate(times)), ("v", 9, None, None)], "timeline_id string, clip_id long, start double, end double")
    got = {(r.modality, r.emb_id): r.target for r in corpus.training_samples(images, clips, clips, none, none).collect()}
    want = {}
    for k, t in enumerate(times):
        want["siglip", k] = f"At timestamp {t:.1f}s, the visual analysis shows: Visual content detected"
        want["videomae", k] = f"From {t:.1f}s to {t + 86400:.1f}s, the temporal analysis shows: Temporal video segment"
        want["wav2vec2", k] = f"Audio from {t:.1f}s to {t + 86400:.1f}s: Audio segment detected"
    assert got == want | {(m, 9): None for m in corpus.MODALITIES}


def test_tenths_of_exact_values(spark):
    drawn = random.Random(7)
    xs = [0.0, -0.0, -0.04, 0.05, 0.15, 0.25, 0.35, 0.45, 0.95, 9.95, 9.96, -0.25, -12345.65, 0.04999999999999999, 5e-324, 1e14 + 0.25, 2.0**51 + 0.5, 2.0**52 + 1, 1e17, 2.0**62]
    xs += [round(drawn.uniform(-3e6, 3e6), 2) for _ in range(2000)] + [drawn.randrange(10**8) / 20 for _ in range(2000)] + [drawn.random() * 10.0 ** drawn.randrange(-6, 16) for _ in range(1000)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate([*xs, None])], "k int, x double").select("k", T.tenths(F.col("x")).alias("text")).collect()
    assert {r.k: r.text for r in got} == dict(enumerate([*(f"{x:.1f}" for x in xs), None]))


def test_sampled_strata_of_long_clips(spark):
    picked = corpus.sampled(long_samples(spark), ["modality"], "emb_id", 2)
    order = lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k)
    want = {("siglip", 1), *((m, k) for m in ("videomae", "wav2vec2") for k in sorted(range(1, 7), key=order)[:2])}
    assert {(m, r.emb_id) for m, rows in corpus.by_modality(picked).items() for r in rows.collect()} == want


def test_folders_of_videos(spark, tmp_path):
    for name in ("optics/deep/Reflections_lighting.mp4", "optics/other.MOV", "kinematics/none.txt", "loose.mp4"):
        (tmp_path / "a" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "a" / name).write_bytes(b"x")
    assert sorted(map(tuple, loaders.physics_videos(spark, str(tmp_path / "a")).collect())) == [("Reflections_lighting", "optics/deep/Reflections_lighting.mp4", "optics", "lighting"), ("other", "optics/other.MOV", "optics", "unknown")]
    (tmp_path / "b/x").mkdir(parents=True)
    (tmp_path / "b/x/gravity.mp4").write_bytes(b"x")
    assert [tuple(r) for r in loaders.physics_videos(spark, str(tmp_path / "b") + "/").collect()] == [("gravity", "x/gravity.mp4", "unknown", "unknown")]


def test_statistics_and_graph_tables(spark):
    none = spark.createDataFrame([], "seconds double")
    assert tuple(records.pipeline_statistics(none, none).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(records.pipeline_statistics(spark.createDataFrame([(1.0,), (2.0,)], "seconds double"), spark.createDataFrame([(9.0,)], "seconds double")).first()) == (2, 9.0, 3.0, 9.0, 1.5)
    nodes = spark.createDataFrame([("e", "cat", "k", 0.0, 5.0), ("f", "dog", "k", 0.0, 50.0)], "entity_id string, concept_label string, category string, first_seen double, last_seen double")
    links = spark.createDataFrame([("e", "f", "near", 1.0, None)], "source_id string, target_id string, relation_type string, start_time double, end_time double")
    a, b = graph.graph_tables(nodes, links, 60.0)
    assert [r.id for r in a.collect()] == ["f"] and graph.graph_tables(nodes, links)[0].count() == 2 and b.first().type == "near"
