"""Attention pooling against a plain loop; audio chunks against whole files."""

import math
import struct

import numpy as np
import pytest

from tidemark.operators import pooling, records
from tidemark.sources import audio, frames, registry, results


def weights_of(d, heads, places=True, seed=1):
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(size=(d, d)) / d**0.5 for k in pooling.MATRICES} | {k: rng.normal(size=(1, d)) for k in pooling.ROWS}
    return w | ({"places": rng.normal(size=(12, d))} if places else {})


def plain(tokens, w, heads):
    d = w["query"].shape[1]
    c = d // heads
    q = w["wq"] @ w["query"][0] + w["bq"][0]
    out = np.zeros(d)
    for h in range(heads):
        part = slice(h * c, h * c + c)
        scores, values = [], []
        for place, t in tokens:
            x = np.array(t) + (w["places"][min(place, 11)] if "places" in w else 0)
            scores.append(float((w["wk"] @ x + w["bk"][0])[part] @ q[part]) / math.sqrt(c))
            values.append((w["wv"] @ x + w["bv"][0])[part])
        e = np.exp(np.array(scores) - max(scores))
        out[part] = (e / e.sum()) @ np.array(values)
    y = w["wo"] @ out + w["bo"][0] + w["query"][0]
    return (y - y.mean()) / math.sqrt(y.var() + 1e-5) * w["gain"][0] + w["shift"][0]


@pytest.mark.parametrize(("heads", "places", "batch"), [(4, True, 10_000), (2, False, 7)])
def test_attention_pooled(spark, heads, places, batch):
    rng = np.random.default_rng(2)
    w = weights_of(16, heads, places)
    rows = [(f"g{k % 5}" if k % 3 else "hot", k % 15, (50 * rng.normal(size=16)).tolist()) for k in range(200)]
    table = spark.createDataFrame([(name, k, row.tolist()) for name, m in w.items() for k, row in enumerate(m)], "name string, row int, values array<double>")
    odd = [("g0", 0, None), ("none", 0, None), ("g0", 1, [1.0]), ("g0", 2, [None] * 16), (None, 3, [1.0] * 16)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.key: r for r in pooling.attention_pooled(spark.createDataFrame(rows + odd, "key string, place int, token array<double>").repartition(3), table, heads).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key, place, t in rows:
        want.setdefault(key, []).append((place, t))
    assert set(got) == set(want)
    for key, tokens in want.items():
        assert got[key].n == len(tokens) and np.allclose(got[key].pooled, plain(tokens, w, heads), atol=1e-9)


def test_weights_are_checked(spark, monkeypatch):
    table = spark.createDataFrame([("wq", 0, [1.0, 2.0])], "name string, row int, values array<double>")
    with pytest.raises(ValueError, match="lack"):
        pooling.given_weights(table)
    monkeypatch.setattr(pooling, "MOST_BYTES", 8)
    with pytest.raises(ValueError, match="travel"):
        pooling.given_weights(table)


def wave(n, rate, channels=1):
    t = np.arange(n) / rate
    return np.stack([0.5 * np.sin(2 * np.pi * (40 + 13 * c) * t) + 0.2 * np.cos(2 * np.pi * 5 * t) for c in range(channels)], 1)


@pytest.mark.parametrize(("rate", "target", "bits", "channels"), [(8000, 16000, 16, 1), (44100, 16000, 16, 2), (16000, 16000, 8, 1), (22050, 16000, 24, 1), (48000, 16000, 32, 1)])
def test_chunks_equal_the_whole(spark, tmp_path, rate, target, bits, channels):
    x = wave(rate * 2 + 37, rate, channels)
    scaled = np.round(x * (127 if bits == 8 else 2.0 ** (bits - 1) - 1)).astype(np.int64)
    raw = (scaled + 128).astype(np.uint8).tobytes() if bits == 8 else b"".join(int(v).to_bytes(4, "little", signed=True)[: bits // 8] for v in scaled.ravel())
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.WAV").write_bytes(audio.pcm(raw, rate, channels, bits))
    (tmp_path / "other.txt").write_bytes(b"no audio")
    mono = scaled.mean(1) / (128 if bits == 8 else 2.0 ** (bits - 1))
    r = audio.Resampler(rate, target)
    low, high = r.needs(0, r.length(len(mono)))
    low, high = min(low, 0), max(high, len(mono))
    whole = r.run(np.pad(mono, (-low, high - len(mono))), low, 0, r.length(len(mono)))
    for split in (1 << 20, 5000):
        got = sorted(registry.read(spark, "wav", str(tmp_path), chunk=0.3, overlap=0.05, split=split, rate=target).collect(), key=lambda c: c.chunk)
        assert [c.chunk for c in got] == list(range(len(got))) and got[0].start == 0 and abs(got[-1].end - len(whole) / target) < 1e-9
        for c in got:
            first = round(c.start * target)
            assert len(c.samples) == round(c.end * target) - first
            assert np.array_equal(np.array(c.samples, np.float32), whole[first : first + len(c.samples)].astype(np.float32))
    # The filter keeps what is in its band.
    t = np.arange(len(whole)) / target
    ideal = np.mean([0.5 * np.sin(2 * np.pi * (40 + 13 * c) * t) for c in range(channels)], 0) + 0.2 * np.cos(2 * np.pi * 5 * t)
    assert np.abs(whole - ideal)[200:-200].max() < (0.02 if bits == 8 else 0.005)


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.wav").write_bytes(audio.pcm(b"", 8000))
    cut = bytearray(audio.pcm(b"\x01\x00" * 50, 8000))
    cut[40:44] = struct.pack("<I", 0xFFFFFFFF)  # a length that the writer didn't know
    (tmp_path / "cut.wav").write_bytes(bytes(cut))
    got = registry.read(spark, "wav", str(tmp_path)).collect()
    assert [(c.path.rsplit("/", 1)[1], len(c.samples)) for c in got] == [("cut.wav", 100)]
    (tmp_path / "bad.wav").write_bytes(b"no audio at all")
    with pytest.raises(Exception, match="not a WAV file"):
        registry.read(spark, "wav", str(tmp_path)).collect()


def test_registry(spark):
    with pytest.raises(ValueError, match="no reader"):
        registry.read(spark, "nothing", "x")
    with pytest.raises(ValueError, match="already"):
        registry.register("wav", lambda spark, path: None)
    registry.register("mine", lambda spark, path, n=1: spark.range(n))
    try:
        assert registry.read(spark, "mine", "x", n=3).count() == 3
    finally:
        del registry.READERS["mine"]


def plain_frames(planes, w, h, across, down):
    """RGB of a frame, a pixel at a time."""
    y, u, v = planes
    out = bytearray()
    for r in range(h):
        for c in range(w):
            a = 298 * (y[r][c] - 16) + 128
            p, q = (u[r // down][c // across] - 128, v[r // down][c // across] - 128) if u else (0, 0)
            out += bytes(min(255, max(0, x >> 8)) for x in (a + 409 * q, a - 100 * p - 208 * q, a + 516 * p))
    return bytes(out)


@pytest.mark.parametrize(("colour", "across", "down"), [("420jpeg", 2, 2), ("422", 2, 1), ("444", 1, 1), ("mono", 0, 0)])
@pytest.mark.parametrize("split", [37, 1 << 20])
def test_frames(spark, tmp_path, colour, across, down, split):
    rng = np.random.default_rng(5)
    w, h, n = 7, 5, 23
    small = (-(-h // down), -(-w // across)) if down else (0, 0)
    raw, want = [], []
    for _ in range(n):
        y, u, v = (rng.integers(0, 256, s).tolist() for s in ((h, w), small, small))
        raw.append(bytes(x for p in (y, u, v) for row in p for x in row))
        want.append(plain_frames((y, u if down else None, v), w, h, across, down))
    (tmp_path / "a.y4m").write_bytes(frames.file(raw, w, h, "30:1", colour) + b"FRAME\ncut short")
    (tmp_path / "none.Y4M").write_bytes(frames.file([], w, h))
    (tmp_path / "other.bin").write_bytes(b"no video")
    got = registry.read(spark, "y4m", str(tmp_path), fps=7, split=split).collect()
    assert sorted((r.frame_idx, r.t_sec, r.width, r.height, bytes(r.pixels)) for r in got) == [(k, k / 30, w, h, want[k]) for k in range(0, n, 4)]
    # More frames than the video has: all of them.
    assert registry.read(spark, "y4m", str(tmp_path), fps=100, split=split).count() == n


@pytest.mark.parametrize("body", [b"", b"YUV4MPEG2 W0 H2 F1:1\n", b"YUV4MPEG2 W2 H2\n", b"YUV4MPEG2 W2 H2 F1:1 C420p10\n", b"YUV4MPEG2 W1 H1 F1:1 Cmono\nFRAME I\nx"])
def test_frames_of_no_video(spark, tmp_path, body):
    (tmp_path / "a.y4m").write_bytes(body)
    with pytest.raises(Exception, match="YUV4MPEG2|size or rate|unknown format|head of its own"):
        registry.read(spark, "y4m", str(tmp_path), pixels="grey").collect()


def test_loaded_samples(spark, tmp_path):
    whole = '{"sample_id": "s", "benchmark": "b", "task_type": "t", "model_config": "m", "correct": true, "predicted": "p", "ground_truth": "g"'
    (tmp_path / "a.json").write_text(whole + "}\n" + whole + ', "num_frames": 7, "question": "q", "other": [1]}\n')
    got = sorted((r.num_frames, r.question, r.total_time, r.correct) for r in results.load_samples(spark, str(tmp_path / "a.json")).collect())
    assert got == [(0, "", 0.0, True), (7, "q", 0.0, True)]
    (tmp_path / "b.json").write_text(whole.replace('"benchmark": "b", ', "") + "}\n")
    with pytest.raises(Exception, match="no benchmark"):
        results.load_samples(spark, str(tmp_path / "b.json")).collect()


def test_shortened(spark):
    rows = spark.createDataFrame([("a", k, f"l{k}") for k in range(9)] + [(None, 1, "x"), (None, 2, None)], "key string, k int, line string")
    got = {r.key: r.text for r in records.shortened(rows, "key", "k", "line", 3).collect()}
    assert got == {"a": "l0\nl1\nl2\n... and 6 more", None: "x"}
