"""Literal cases of the operators, and properties against plain Python."""

import json

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import chat, evaluation, graph, joins, retrieval, sampling, stateful
from tidemark.operators import timeline as TL
from tidemark.sources import loaders
from tidemark.streaming import timelines

SCHEMA = "timeline_id string, seq long, t_sec double, modality string, description string, priority int, duration double, entity_id string, confidence double"


def events(spark, rows):
    return spark.createDataFrame([("v", k, t, m, d, p, dur, e, c) for k, (t, m, d, p, dur, e, c) in enumerate(rows)], SCHEMA)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_alignment_and_transcript(spark):
    tl = events(spark, [(1.5, "visual", "Player detected", 2, 0.0, "player_01", 0.95), (1.6, "speech", "Let's do this!", 1, 0.0, None, 0.98), (1.55, "ocr", "HP: 100/100", 2, 0.0, None, 0.9)])
    assert TL.transcript(tl).first().transcript.split("\n") == ["[00:01] Player detected", '[00:01] (Text: "HP: 100/100")', "[00:01] \"Let's do this!\""]


def test_window_is_the_whole_span(spark):
    tl = events(spark, [(t, "visual", str(t), 2, 0.0, None, 1.0) for t in (10.0, 30.0, 60.0, 90.0)])
    assert sorted(r.t_sec for r in retrieval.by_timestamp(tl, 30.0, 20.0).collect()) == [10, 30]
    assert sorted(r.t_sec for r in TL.around(tl, 30.0, 0).collect()) == [30]


def test_low_is_hidden_and_debug_is_not(spark):
    tl = events(spark, [(1.0, "visual", str(p), p, 0.0, None, 1.0) for p in range(5)])
    assert sorted(r.priority for r in TL.in_range(tl).collect()) == [0, 1, 2, 4]
    assert TL.in_range(tl, include_low=True).count() == 5


def test_times(spark):
    got = [one(spark, T.query_seconds(F.col("q")), q=q) for q in ("at 5:30 there", "1:05:30", "at 45 seconds", "none", "that 5 items")]
    assert got == [330.0, 3930.0, 45.0, None, 5.0]
    assert [one(spark, T.time_token(F.col("t")), t=t) for t in (0.0, 65.0, 3661.0)] == ["<ts=00:00>", "<ts=01:05>", "<ts=61:01>"]
    assert [one(spark, T.token_seconds(F.col("t")), t=t) for t in ("<ts=61:01>", "x")] == [3661.0, None]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from("ab"), st.sampled_from([None, "e", "f"]), st.sampled_from("xyz"), st.integers(0, 4)), max_size=14))
def test_merge_equals_plain_python(spark, rows):
    tl = events(spark, [(t / 4, m, d, p, 0.25, e, p / 4) for t, m, e, d, p in rows])
    groups = []
    for k, r in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        last = groups[-1][-1][1] if groups else None
        if last and (r[0] - last[0]) / 4 <= 0.5 and r[1] == last[1] and r[2] == last[2]:
            groups[-1].append((k, r))
        else:
            groups.append([(k, r)])
    want = sorted((g[0][0], "; ".join(list(dict.fromkeys(r[3] for _, r in g))[:3]), min(r[4] for _, r in g), len(g)) for g in groups)
    got = sorted((r.seq, r.description, r.priority, r.n_merged) for r in TL.merge_nearby(tl).collect())
    assert got == want


def test_segments_cover_and_stop(spark):
    tl = events(spark, [(0.0, "visual", "a", 2, 0.0, None, 1.0), (25.0, "visual", "b", 2, 5.0, None, 1.0), (30.0, "visual", "edge", 2, 0.0, None, 1.0)])
    assert [(r.k, r.event_count) for r in TL.segments(tl).orderBy("k").collect()] == [(0, 1), (1, 0), (2, 1)]
    assert TL.segments(events(spark, [(1.0, "v", "a", 2, 0.0, None, 1.0)])).count() == 0
    assert TL.segments(events(spark, []).where("false")).count() == 0


def test_fusion(spark):
    ocr = spark.createDataFrame([("v", 0, 1.0, "HP", 0.9)], "timeline_id string, seq long, t_sec double, text string, confidence double")
    speech = ocr.withColumn("end_time", F.lit(3.0))
    visual = ocr.withColumn("entity_id", F.lit("p")).withColumn("motion_type", F.lit("high_action"))
    assert sorted((r.modality, r.priority, r.duration) for r in TL.fused(ocr, speech, visual).collect()) == [("ocr", 2, 0.0), ("speech", 1, 2.0), ("visual", 3, 0.0)]
    audio, tokens = speech.withColumn("kind", F.lit("dialogue")), spark.createDataFrame([("v", 80, 10), ("w", 5, 0)], "timeline_id string, n_frames long, n_tokens long")
    got = TL.fused_extracted(ocr, visual, audio, tokens).orderBy("seq").collect()
    assert [(r.modality, r.priority) for r in got] == [("ocr", 1), ("visual", 1), ("speech", 1), ("temporal", 3)] and got[3].description == "Temporal context: 80 frames compressed to 10 tokens"


def test_fusion_keeps_the_order_of_streams_at_one_time(spark):
    late = spark.createDataFrame([("v", 5, 1.0, "HP", 0.9)], "timeline_id string, seq long, t_sec double, text string, confidence double")
    early = late.withColumn("seq", F.lit(0).cast("bigint")).withColumn("end_time", F.lit(2.0)).withColumn("entity_id", F.lit("p"))
    got = TL.fused(late, early, early).orderBy("t_sec", "seq").collect()
    assert [r.modality for r in got] == ["ocr", "speech", "visual"]
    assert [r.description for r in TL.appended(TL.fused(late, early, early), TL.fused(late, early, early).where("modality = 'ocr'").withColumn("description", F.lit("new"))).orderBy("seq").collect()][-1] == "new"


def test_ends_without_an_open_edge_close_nothing(spark):
    def intervals(*changes):
        rows = [("a", "b", "near", float(t), k, s) for k, (t, s) in enumerate(changes)]
        edges = joins.opened_and_closed(spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, t_sec double, seq long, is_start boolean"))
        return [(r.start_time, r.end_time) for r in edges.orderBy("start_time").collect()]

    assert intervals((0, False), (1, True), (2, False)) == [(1, 2)]
    assert intervals((0, False), (0, False), (1, True), (2, True), (3, False), (4, False), (5, False), (6, True)) == [(1, 3), (2, 4), (6, None)]


def test_band_join_keeps_left_rows(spark):
    a = spark.createDataFrame([("k", 1.0, 1), ("k", 50.0, 2), ("z", 1.0, 3)], "k string, t double, i long")
    b = spark.createDataFrame([("k", 2.0, "x")], "k string, u double, v string")
    got = joins.band_join(a, b, ["k"], "t", "u", 1.0, 5.0, how="left")
    assert sorted((r.i, r.v or "") for r in got.collect()) == [(1, "x"), (2, ""), (3, "")]


def test_fusion_of_tokens_and_text(spark):
    ocr = spark.createDataFrame([("v", 0, 1.0, "HP", 0.9)], "timeline_id string, seq long, t_sec double, text string, confidence double")
    assert TL.from_text(ocr).first().priority == 2 and TL.clean_text(ocr).count() == 0
    tokens = spark.createDataFrame([("v", 0, 0.0, 4.0, "clip", 16)], "timeline_id string, seq long, start double, end double, level string, source_frame_count int")
    assert TL.from_tokens(tokens).first().description == "clip segment (16 frames)"
    assert sampling.token_summary(tokens, "timeline_id").first().frames == 16


def test_boxes(spark):
    b = lambda *v: G.box(*[F.lit(x) for x in v])
    assert one(spark, G.iou(b(0, 0, 10, 10), b(0, 0, 10, 5))) == 0.5
    assert one(spark, G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert one(spark, G.iou(F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"), b(0, 0, 1, 1))) is None
    assert one(spark, G.relations(b(0, 0, 10, 10), b(0, 0, 10, 10))) == ["near", "below", "contains"]
    assert one(spark, G.relations(b(0, 0, 2, 2), b(100, 100, 102, 102))) == ["above"]
    assert one(spark, G.expanded(b(0, 0, 100, 50), F.lit(105), F.lit(60))).asDict() == {"x1": 0.0, "y1": 0.0, "x2": 105.0, "y2": 55.0}
    assert one(spark, G.patch_size(F.lit(1920), F.lit(1080))).asDict() == {"w": 756, "h": 420}
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    t = F.array(F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(2.0)))
    assert [one(spark, V.pooled(t, h)) for h in ("cls", "mean", "max")] == [[1.0, 4.0], [2.0, 3.0], [3.0, 4.0]]


def test_answers(spark):
    o, none = F.array(F.lit("red"), F.lit("blue")), F.array().cast("array<string>")
    parse = lambda r, opts=o: one(spark, T.parsed_answer(F.col("r"), opts), r=r)
    assert [parse(x) for x in ("b. no", "it is [A]", "blue!", "x")] == ["B", "A", "B", "x"]
    assert [parse(x, none) for x in ("TRUE", "know", "hm\nhm")] == ["yes", "no", "hm"]
    glitch = lambda r: one(spark, T.glitch_answer(F.col("r"), none), r=r)
    far = "not " + "x" * 40 + " a physics error"
    assert [glitch(x) for x in ("There is a glitch", "no visible glitch", "I do not see that there is a glitch", far, "Yes.", "**Answer:** a bug", "hm\nx", "")] == ["yes", "no", "no", "yes", "yes", "yes", "hm", ""]
    assert one(spark, T.correct_keywords(F.lit("I know"), F.lit("no"), none)) is True
    assert one(spark, T.correct_letters(F.lit("clean"), F.lit("c"))) is True


def test_bands_meet_once(spark):
    a = spark.createDataFrame([("v", k, float(k)) for k in range(20)], "timeline_id string, a long, ta double")
    b = spark.createDataFrame([("v", k, k / 2) for k in range(40)], "timeline_id string, b long, tb double")
    got = sorted((r.a, r.b) for r in joins.band_join(a, b, ["timeline_id"], "ta", "tb", 1.5, 2.0, (True, False)).collect())
    assert got == sorted((x, y) for x in range(20) for y in range(40) if -1.5 < y / 2 - x <= 2.0)


def test_intervals_frames_and_graph(spark):
    rows = spark.createDataFrame([("a", "b", "near", 1.0, 0, True), ("a", "b", "near", 2.0, 1, True), ("a", "b", "near", 3.0, 2, False)], "source_id string, target_id string, relation_type string, t_sec double, seq long, is_start boolean")
    edges = joins.opened_and_closed(rows)
    assert sorted((r.start_time, r.end_time) for r in edges.collect()) == [(1.0, 3.0), (2.0, None)]
    assert graph.active(edges, 0.0).count() == 1 and graph.active(edges, 2.5).count() == 2
    loop = spark.createDataFrame([("a", "a", "near", 0)], "source_id string, target_id string, relation_type string, seq long")
    assert graph.edges_of(loop, "a").count() == 2
    frames = spark.createDataFrame([(k, float(k)) for k in range(5)], "frame_idx long, t_sec double")
    assert joins.nearest_frame(frames, 2.5).first().frame_idx == 2 and joins.nearest_frame(frames, None).first().frame_idx == 2
    det = spark.createDataFrame([("a", 1.0, "cat", (0.0, 0.0, 1.0, 1.0))], "video string, t_sec double, label string, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    two = frames.withColumn("video", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert sorted(r.label for r in joins.frames_with_detections(two, det, 10.0, 10.0).collect()) == ["cat"] + ["full_frame"] * 9
    nodes = spark.createDataFrame([("a", "x", 0.0, 1.0), ("b", "y", 0.0, 2.0)], "entity_id string, category string, first_seen double, last_seen double")
    assert [r.line for r in graph.export_lines(nodes, edges).orderBy("line_no").collect()] == ["## Entities", "- b (y)", "- a (x)", "## Relationships", "- a near b", "- a near b"]
    assert json.loads(graph.as_graph(nodes, edges).first().nodes)[0]["entity_id"] == "a"
    e = spark.createDataFrame([("a", "b", "near", t) for t in (0.0, 1.0, 9.0)], "source_id string, target_id string, relation_type string, t_sec double")
    assert graph.episodes(e, 2.0).count() == 2


def test_trackers(spark):
    rows = [("v", f, float(f), d, "cat", "cat", x, 0.0, x + 10, 10.0, 0.5 + f / 10) for f, d, x in ((0, 0, 0.0), (1, 0, 1.0), (1, 1, 50.0), (20, 0, 2.0))]
    det = spark.createDataFrame(rows, "timeline_id string, frame_idx long, t_sec double, det_no int, entity_type string, label string, x1 double, y1 double, x2 double, y2 double, confidence double")
    tracked = stateful.track(det)
    assert [r.entity_id for r in tracked.orderBy("frame_idx", "det_no").collect()] == ["cat_001", "cat_001", "cat_002", "cat_001"]
    assert {r.entity_id: r.avg_confidence for r in stateful.track_summaries(tracked).collect()}["cat_002"] is None
    assert [(r.entity_id, r.state) for r in stateful.lifecycle(det).orderBy("frame_idx", "entity_id").collect()] == [("cat_000", "active"), ("cat_001", "active"), ("cat_001", "lost")]
    life = stateful.Lifecycle()
    assert life.step(0, [("cat", (0, 0, 10, 10))])[1] == [("cat_000", "active")]
    assert [life.step(f, [])[1] for f in (1, 11, 31, 40)] == [[("cat_000", "occluded")], [("cat_000", "lost")], [("cat_000", "terminated")], []]
    assert life.step(41, [("cat", (0, 0, 10, 10))])[0] == ["cat_001"]
    c = spark.createDataFrame([("v", t, k, s) for k, (t, s) in enumerate([(0.5, "visual"), (1.0, "audio"), (1.0, "visual"), (1.9, "audio"), (2.0, "audio")])], "timeline_id string, t_sec double, seq long, source string")
    assert [(r.t_sec, r.source) for r in stateful.triggers(c).orderBy("t_sec").collect()] == [(1.0, "visual"), (2.0, "audio")]
    assert [r.n for r in stateful.state_counts(spark.createDataFrame([("lost",)], "state string")).orderBy("state").collect()] == [0, 1, 0, 0]


def test_windows(spark):
    media = spark.createDataFrame([(0, 10.0), (1, 1.0)], "media_id long, duration double")
    assert [(r.start, r.end) for r in sampling.clips(media).orderBy("k").collect()] == [(0.0, 4.0), (3.5, 7.5), (7.0, 10.0)]
    assert sampling.audio_chunks(media).count() == 2
    f = sampling.uniform_frames(spark.createDataFrame([(40,), (1,), (3,)], "n_frames long")).collect()
    assert [r.frames for r in f] == [[int(i * 39 / 15) for i in range(16)], [0], [0, 1, 2]]
    frames = spark.createDataFrame([("v", k, k / 2) for k in range(32)], "video string, frame_idx long, t_sec double")
    assert sorted((r.chunk, r.mid_t) for r in sampling.frame_chunks(frames).collect()) == [(0, 4.0), (1, 8.0), (2, 12.0)]
    assert sampling.every_nth(frames, 30.0, 1.0).count() == 2 and sampling.subsampled(frames, 2.0, 0.5).count() == 8
    ids = spark.createDataFrame([("v", 0, 1.01, "ocr"), ("v", 1, 1.04, "ocr")], "timeline_id string, seq long, t_sec double, type string")
    assert [r.entity_id for r in sampling.time_ids(ids).collect()] == ["ocr_1_0"]
    assert sorted(r.entity_id for r in sampling.numbered_ids(ids, "type", ["seq"]).collect()) == ["ocr_001", "ocr_002"]
    assert sampling.newest(ids, "timeline_id", "seq", 1).first().seq == 1


def test_prompt_context_and_chat(spark):
    tl = events(spark, [(float(t), "visual", "x" * 10, 2, 0.0, None, 1.0) for t in (60, 30, 90)])
    assert [x[:7] for x in retrieval.context_text(tl, "timeline_id").first().context.split("\n")] == ["[00:30]", "[01:00]", "[01:30]"]
    assert retrieval.context_text(tl, "timeline_id", 60).first().context.endswith("(truncated)")
    m = one(spark, retrieval.messages("s", F.lit("ctx"), F.lit("q?")))
    assert [x.role for x in m] == ["system", "user"] and "ctx" in m[1].content
    regions = spark.createDataFrame([("v", 0, "player", 0.95), ("v", 1, "enemy", 0.88)], "k string, seq int, label string, confidence double")
    assert retrieval.region_text(regions, "k").first().text.count("\n") == 2
    e = spark.createDataFrame([("visual", 30.0, 0), ("visual", 29.9, 1), ("audio", 0.0, 2)], "modality string, t0 double, emb_id long")
    assert retrieval.near_embeddings(e, 0.0).count() == 2 and retrieval.near_embeddings(e, None).count() == 3
    turns = spark.createDataFrame([(0, k, "user" if k % 2 == 0 else "assistant", f"t{k} at 0:0{k}") for k in range(5)], "conv_id long, turn long, role string, text string")
    assert chat.window_summary(turns, 3).first().summary == "t0 at 0:00 | t1 at 0:01"
    last = chat.last_words(turns).first()
    assert (last.last_query, last.last_response, last.last_time) == ("t4 at 0:04", "t3 at 0:03", 4.0)


def test_evaluation(spark):
    m = spark.createDataFrame([("c", "b", "t", True), ("c", "b", "u", False)], "model_config string, benchmark string, task_type string, correct boolean")
    assert evaluation.task_breakdown(m).first().tasks["t"].accuracy == 1.0
    s = spark.createDataFrame([(k,) for k in range(9)], "sample_id long")
    assert [r.sample_id for r in evaluation.limited(s, 2, "sample_id").collect()] == [0, 1]
    assert evaluation.limited(s, 4, "sample_id", 42).collect() == evaluation.limited(s, 4, "sample_id", 42).collect()


def test_readers_and_caches(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/list.json").write_text(json.dumps([{"id": 1, "question": "q", "options": ["x", "y"], "answer": "A", "duration": 5}]))
    (tmp_path / "a/under.json").write_text(json.dumps({"samples": [{"id": 2, "question": "q", "answer": "yes"}]}))
    (tmp_path / "a/by_id.json").write_text(json.dumps({"v1": {"question": "q", "answer": "no"}, "v2": [{"question": "r", "answer": "z"}]}))
    got = {r.sample_id: r for r in loaders.plain_benchmark(spark, str(tmp_path / "a")).collect()}
    assert set(got) == {"1", "2", "v1_0", "v2_0"} and got["1"].options == ["x", "y"] and got["2"].answer_format == "binary" and got["v1_0"].video_path == "v1"
    assert {r.answer for r in loaders.glitches(spark, str(tmp_path / "a")).collect()} == {"yes"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x_glitch_detection.json").write_text(json.dumps([{"id": 1, "query": "q", "choices": ["a"]}]))
    (tmp_path / "b/plotQA_test.json").write_text(json.dumps([{"id": 2, "question": "q"}]))
    assert {r.sample_id: r.task for r in loaders.game_questions(spark, str(tmp_path / "b")).collect()}["1"] == "glitch_detection"
    assert {r.sample_id: r.task for r in loaders.long_videos(spark, str(tmp_path / "b")).collect()}["2"] == "temporal_reasoning"
    (tmp_path / "m.json").write_text(json.dumps([{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"messages": []}, {"question": "q", "answer": "a"}]))
    for reader in (loaders.training_messages, loaders.training_pairs):
        with pytest.raises(Exception, match="no question and answer|not a conversation"):
            reader(spark, str(tmp_path / "m.json")).collect()
    (tmp_path / "p.json").write_text(json.dumps([{"question": "q", "answer": "a"}]))
    (tmp_path / "c.json").write_text(json.dumps([{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}]))
    assert loaders.training_messages(spark, str(tmp_path / "c.json")).collect() and loaders.training_pairs(spark, str(tmp_path / "p.json")).first().answer == "a"
    loaders.save_conversations(spark.createDataFrame([(7, 0, "user", "a"), (8, 0, "user", "b")], "conv_id long, turn long, role string, text string"), str(tmp_path / "saved"))
    assert [r.text for r in loaders.load_conversation(spark, str(tmp_path / "saved"), 8).collect()] == ["b"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/clip.mp4").write_bytes(b"abc")
    (tmp_path / "v/clip.txt").write_bytes(b"abc")
    assert [r.video_id for r in loaders.videos(spark, str(tmp_path / "v")).collect()] == ["clip"]
    cache = spark.createDataFrame([(k, 40, k) for k in range(5)], "key long, size long, mtime long")
    assert sorted(r.key for r in loaders.evicted(cache, 150).collect()) == [0, 1] and loaders.evicted(cache, 1000).count() == 0
    df = spark.createDataFrame([("h", 1), ("g", 2)], "video_hash string, x int")
    loaders.write_features(df, str(tmp_path / "f"))
    loaders.write_features(df.where("x = 1").withColumn("x", F.lit(9)), str(tmp_path / "f"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [2, 9]
    fresh = loaders.cached_searches(spark.createDataFrame([("Boss",)], "query string"), spark.createDataFrame([(__import__("hashlib").md5(b"boss").hexdigest(), 90.0, "r")], "key string, ts double, result string"), 100.0, 20.0)
    assert fresh.count() == 1
    assert one(spark, loaders.is_video_url(F.lit("https://youtu.be/x"))) is True


def test_streams_equal_batch(spark, tmp_path):
    rows = [("v", k, k / 2, "visual") for k in range(20)] + [("w", k, k / 1.0, "audio") for k in range(20)]
    schema = "timeline_id string, t_sec double, seq long, source string"
    src = spark.createDataFrame([(a, t, s, c) for a, s, t, c in rows], schema)
    for lo, hi in ((0, 10), (10, 20)):
        src.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    fired = run(timelines.triggers(stream), "fired")
    assert sorted((r.timeline_id, r.ts) for r in fired.collect()) == sorted((r.timeline_id, r.t_sec) for r in stateful.triggers(src).collect())
    timed = stream.withColumn("ts", F.timestamp_micros((F.col("t_sec") * 1_000_000).cast("long")))
    counts = run(timelines.segments(timelines.with_watermark(timed), "5 seconds"), "counted", "complete")
    assert sorted((r.timeline_id, r.event_count) for r in counts.collect()) == sorted([("v", 10), ("v", 10)] + [("w", 5)] * 4)


def test_stream_tracker_equals_batch(spark, tmp_path):
    rows = [("v", f, float(f), d, "cat", float(f + 40 * d), 0.0, float(f + 40 * d + 10), 10.0, 0.5) for f in range(6) for d in range(2)]
    schema = "timeline_id string, frame_idx long, t_sec double, det_no int, entity_type string, x1 double, y1 double, x2 double, y2 double, confidence double"
    src = spark.createDataFrame(rows, schema)
    src.where("frame_idx < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src.where("frame_idx >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = timelines.track(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.frame_idx, r.det_no, r.entity_id) for r in df.collect())
    assert key(spark.table("tracked")) == key(stateful.track(src))
    assert isinstance(stateful.track(src).toPandas(), pd.DataFrame)


def test_tracker_loses_what_is_missing(spark, tmp_path):
    box = (0.0, 0.0, 10.0, 10.0)
    t = stateful.Tracker()
    assert [t.step([("cat", box)] if f in (0, 11, 23) else []) for f in range(24)][::11] == [["cat_001"], ["cat_001"], []] and t.counts["cat"] == 2
    rows = [("v", f, float(f), 0, "cat", *box, 0.5) for f in (0, 11, 23, 24)]
    schema = "timeline_id string, frame_idx long, t_sec double, det_no int, entity_type string, x1 double, y1 double, x2 double, y2 double, confidence double"
    src = spark.createDataFrame(rows, schema)
    want = [(0, "cat_001"), (11, "cat_001"), (23, "cat_002"), (24, "cat_002")]
    key = lambda df: sorted((r.frame_idx, r.entity_id) for r in df.collect())
    assert key(stateful.track(src, every_frame=True)) == want
    assert key(stateful.track(src, max_missing=12, every_frame=True)) == [(f, "cat_001") for f, _ in want]
    src.where("frame_idx < 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src.where("frame_idx >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = timelines.track(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), every_frame=True).writeStream.format("memory").queryName("lost").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert key(spark.table("lost")) == want


def test_records(spark):
    from tidemark.operators import records as R

    res = spark.createDataFrame([(0, 0, "a", "https://x.org", "s"), (0, 1, "b", "https://www.ign.com/y", "s")], "query_id int, seq int, title string, url string, snippet string")
    assert [(r.title, r.source) for r in R.ranked_results(res, 1).collect()] == [("b", "ign")] and R.result_texts(res, 3).count() == 1
    assert one(spark, R.expanded_query(F.lit("best weapon"), F.lit("Elden Ring"), F.lit("wiki"))) == "Elden Ring best weapon wiki"
    assert one(spark, R.trigger_query(F.lit("concept"), F.lit("boss"), F.lit(None))) == "A boss was just detected. Describe what's happening with it."
    assert one(spark, R.vram_breakdown(F.create_map(F.lit("hico"), F.lit(True)))) == {"llm": 16.0, "hico": 2.0}
    assert R.presets(spark).count() == 3 and R.eval_configs(spark).count() == 3
    d = spark.createDataFrame([(0, "p", 0, 200.0, 0.9, " "), (0, "p", 1, 200.0, 0.9, "x"), (0, "p", 2, 50.0, 1.0, "y")], "frame_id int, prompt string, det_no int, area double, confidence double, text string")
    assert R.best_mask(d).first().det_no == 0 and R.confident(d).count() == 2 and R.where_equal(d, prompt="p", det_no=None).count() == 3 and R.where_named(d, "text", "X").count() == 1
    f = spark.createDataFrame([(0, 0.0, [("hi", None)])], "frame_idx long, t_sec double, detections array<struct<text:string,category:string>>")
    assert R.flattened(f).first().category == "unknown"
    lines = spark.createDataFrame([(0, k, f"l{k}") for k in range(4)], "k int, o int, line string")
    assert R.shortened(lines, "k", "o", "line", 2).first().text == "l0\nl1\n... and 2 more"
    t = spark.createDataFrame([("v", "cat_001", 1.0, 65.0, 3)], "timeline_id string, entity_id string, first_seen double, last_seen double, n_frames long")
    assert R.knowledge_lines(t).first().line == "cat_001: 00:01-01:05, 3 frames"
    e = spark.createDataFrame([("a", "x", "c", 1.0, 2.0), ("a", "y", "d", 3.0, 4.0)], "entity_id string, concept_label string, category string, first_seen double, last_seen double")
    assert tuple(R.upserted(e.limit(1), e.where("first_seen > 2")).first()) == ("a", "x", "c", 1.0, 4.0)
    a = spark.createDataFrame([("dialogue", "ab"), ("dialogue", "abc"), ("event", "no audio here"), ("event", "thunder")], "kind string, text string")
    assert sorted(r.text for r in R.audible(a).collect()) == ["abc", "thunder"]
    assert R.inferred(a, lambda b: b[["text"]], "text string").count() == 4
    assert R.run_statistics(spark.createDataFrame([], "seconds double")).first().avg_seconds == 0.0
