"""Queries of the smaller operators on the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import evaluation, graph, joins, records, retrieval, sampling, stateful
from tidemark.operators import timeline as TL
from tidemark.plans import driver as D
from tidemark.plans.driver import LINE, MMSS, STS, TLS, query, states, table, timeline
from tidemark.sources import loaders
from tidemark.storage import new_path


def any_sql(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


# Text of events and questions


@query(f"with {TLS} select seq, '<ts=' || {MMSS} || '>' as token, floor(t_sec)::double as back, '<ts=' || {MMSS} || '> ' || case modality when 'view' then '<r> ' when 'error' then '<a> ' when 'click' then '<v> ' else '' end || description as line, '<ts=' || {MMSS} || '> ' || case modality when 'view' then '<r_emb> ' when 'error' then '<a_emb> ' when 'click' then '<v_emb> ' else '' end || description as line_emb from tl")
def time_tokens(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    kind = F.when(F.col("modality") == "view", "visual").when(F.col("modality") == "error", "audio").when(F.col("modality") == "click", "video")
    t, d = F.col("t_sec"), F.col("description")
    return tl.select("seq", T.time_token(t).alias("token"), T.token_seconds(T.time_token(t)).alias("back"), T.interleaved(t, kind, d).alias("line"), T.interleaved(t, kind, d, True).alias("line_emb"))


@query(f"with {TLS} select seq, '[' || {MMSS} || ']' || case when seq % 3 = 0 then '' else ' [' || entity_id || ']' end || ' (' || modality || ') ' || description as line, trunc(t_sec * 10)::bigint as frame_idx from tl")
def verbose_lines(spark, sf_dir):
    who = F.when(F.col("seq") % 3 != 0, F.col("entity_id"))
    out = timeline(spark, sf_dir).select("seq", T.verbose(F.col("t_sec"), who, F.col("modality"), F.col("description")).alias("line"), T.frame_at(F.col("t_sec")).alias("frame_idx"))
    return out


@query("select item_id, text || chr(10) || '  (A) yes' || chr(10) || '  (B) no' || chr(10) || 'Answer with the letter only.' as prompt from benchmark where item_id % 2 = 0 union all select item_id, text from benchmark where item_id % 2 = 1")
def choice_prompts(spark, sf_dir):
    options = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.choice_prompt(F.col("text"), options).alias("prompt"))


@query("select event_id, case when event_type = 'view' then 'A ' || case when event_id % 5 = 0 then 'object' else event_type end || ' was just detected. Describe what''s happening with it.' when event_type = 'error' then 'An audio event ''' || event_type || ''' was detected. What''s happening?' else 'Something triggered. Describe the current situation.' end as q from events")
def trigger_queries(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "concept").when(F.col("event_type") == "error", "audio").otherwise("none")
    concept = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", records.trigger_query(kind, concept, F.col("event_type")).alias("q"))


@query("select conv_id, turn, case when conv_id % 3 = 0 and not contains(lower(text), 'elden ring') then 'Elden Ring ' || text else text end || case turn % 4 when 0 then ' wiki' when 1 then ' guide walkthrough' when 2 then ' lore story explained' else '' end as q from conversations")
def expanded_queries(spark, sf_dir):
    game = F.when(F.col("conv_id") % 3 == 0, "Elden Ring")
    kind = F.when(F.col("turn") % 4 == 0, "wiki").when(F.col("turn") % 4 == 1, "guide").when(F.col("turn") % 4 == 2, "lore")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.expanded_query(F.col("text"), game, kind).alias("q"))


GAME_SQL = "case " + " ".join(f"when regexp_matches(lower({{0}}), '{p.replace(chr(39), chr(39) * 2)}') then '{n.replace(chr(39), chr(39) * 2)}'" for p, n, _ in T.GAMES) + " end"
PLACED = "'Minecraft' || turn", "'we play overwatch'", "text"


@query(f"with c as (select conv_id, turn, case when turn % 5 = 0 then {PLACED[0]} else 'hud' end as o, case when turn % 3 = 0 then {PLACED[1]} else 'talk' end as s, text as x from conversations) select conv_id, turn, coalesce({GAME_SQL.format('o')}, {GAME_SQL.format('s')}, {GAME_SQL.format('x')}) as name, case when {GAME_SQL.format('o')} is not null then 0.8::double when {GAME_SQL.format('s')} is not null then 0.6 when {GAME_SQL.format('x')} is not null then 0.5 end as confidence from c")
def games_by_evidence(spark, sf_dir):
    ocr = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Minecraft"), F.col("turn").cast("string"))).otherwise("hud")
    speech = F.when(F.col("turn") % 3 == 0, "we play overwatch").otherwise("talk")
    g = T.game_by_evidence(ocr, speech, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", g["name"].alias("name"), g["confidence"].alias("confidence"))


TASK_SQL = "case " + " ".join(f"when contains(lower({{0}}), '{w}') then '{n}'" for w, n in T.LONG_VIDEO_TASKS) + " else 'visual_qa' end"


@query(f"with c as (select conv_id, turn, role || case turn % 7 when 0 then '_needle' when 1 then '_Topic_reasoning' when 2 then '_action_order' when 3 then 'anomaly' when 4 then '_ego' when 5 then '_temporal' else '' end as task, text, turn from conversations) select conv_id, turn, {TASK_SQL.format('task')} as by_task, case when contains(lower(task), 'temporal') or contains(lower(text), 'when') then 'temporal_reasoning' else 'visual_qa' end as by_question, case when turn % 6 = 0 then 'free_text' when turn % 2 = 0 then 'mcq' when lower(role) in ('yes', 'no', 'true', 'false') then 'binary' else 'free_text' end as format from c join (select distinct conv_id as i, turn as t, role from conversations) r on c.conv_id = r.i and c.turn = r.t")
def question_types(spark, sf_dir):
    k = F.col("turn") % 7
    suffix = F.when(k == 0, "_needle").when(k == 1, "_Topic_reasoning").when(k == 2, "_action_order").when(k == 3, "anomaly").when(k == 4, "_ego").when(k == 5, "_temporal").otherwise("")
    task = F.concat("role", suffix)
    options = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("turn") % 6 == 0, "bug_report").otherwise("visual_qa")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.long_video_task(task).alias("by_task"), T.long_question_task(task, F.col("text")).alias("by_question"), T.answer_format(kind, options, F.col("role")).alias("format"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'large-v3' when 1 then 'tiny' else o_orderstatus end as name from orders")
def model_names(spark, sf_dir):
    path = F.when(F.col("o_orderkey") % 3 == 0, "openai/whisper-large-v3").when(F.col("o_orderkey") % 3 == 1, "whisper-tiny").otherwise(F.concat(F.lit("a/b/"), "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.model_name(path).alias("name"))


@query("select doc_id, sha256(strlen(text)::varchar || text || text)[1:16] as content_key, md5(source || ':' || n_chars || ':' || doc_id)[1:16] as path_key from documents where strlen(text) <= 1048576")
def cache_keys(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").where(F.octet_length("text") <= 1 << 20).select("doc_id", loaders.file_key(raw, F.octet_length("text")).alias("content_key"), loaders.path_key(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("path_key"))


@query("select conv_id, turn, 2::bigint as n_messages, 'user' as last_role, case when turn > 0 then 'Conversation:' || chr(10) || role || chr(10) || chr(10) else '' end || 'Timeline:' || chr(10) || text || chr(10) || chr(10) || 'Question: why' as last_content from conversations where text <> ''")
def prompt_messages(spark, sf_dir):
    history = F.when(F.col("turn") > 0, F.col("role")).otherwise("")
    m = retrieval.messages("You watch videos.", F.col("text"), F.lit("why"), history)
    return table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.size(m).cast("bigint").alias("n_messages"), m[1]["role"].alias("last_role"), m[1]["content"].alias("last_content"))


# Shapes and vectors


@query("""with p as (select p_partkey as k, 100 + p_partkey * 37 % 2000 as w, 80 + p_partkey * 53 % 1500 as h, (p_partkey * 37 % 500)::double as x1, (p_partkey * 53 % 400)::double as y1, (p_partkey * 37 % 500 + 10 + p_partkey % 60)::double as x2, (p_partkey * 53 % 400 + 10 + p_partkey % 45)::double as y2 from part), s as (select *, least(1.0::double, 768.0::double / greatest(w, h)) as sc from p)
select k, (floor(greatest(224.0::double, w * sc) / 14) * 14)::int as pw, (floor(greatest(224.0::double, h * sc) / 14) * 14)::int as ph, greatest(0.0::double, x1 - (x2 - x1) * 0.1::double) as ex1, greatest(0.0::double, y1 - (y2 - y1) * 0.1::double) as ey1, least(480.0::double, x2 + (x2 - x1) * 0.1::double) as ex2, least(400.0::double, y2 + (y2 - y1) * 0.1::double) as ey2,
 floor(x1 / 1000 * w)::bigint as ax1, floor(y2 / 1000 * h)::bigint as ay2, case k % 3 when 0 then 131072 when 1 then 524288 else 262144 end as min_pixels, case k % 3 when 0 then 262144 else 1048576 end as max_pixels, least(x1, y1) as lo, greatest(x2, y2) as hi from s""")
def shapes(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = (k * 37 % 500).cast("double"), (k * 53 % 400).cast("double")
    p = table(spark, sf_dir, "part").select(k.alias("k"), (100 + k * 37 % 2000).alias("w"), (80 + k * 53 % 1500).alias("h"), G.box(x, y, x + 10 + k % 60, y + 10 + k % 45).alias("b"))
    patch, grown = G.patch_size(F.col("w"), F.col("h")), G.expanded(F.col("b"), F.lit(480), F.lit(400))
    share = G.absolute(G.box(*[F.col(f"b.{n}") / 1000 for n in ("x1", "y1", "x2", "y2")]), F.col("w"), F.col("h"))
    budget = G.pixel_budget(F.when(F.col("k") % 3 == 0, "low").when(F.col("k") % 3 == 1, "high").otherwise("auto"))
    around = G.polygon_box(F.array(F.struct(F.col("b.x1").alias("x"), F.col("b.y1").alias("y")), F.struct(F.col("b.y1").alias("x"), F.col("b.x1").alias("y")), F.struct(F.col("b.x2").alias("x"), F.col("b.y2").alias("y")), F.struct(F.col("b.y2").alias("x"), F.col("b.x2").alias("y"))))
    return p.select(
        "k", patch["w"].alias("pw"), patch["h"].alias("ph"), grown["x1"].alias("ex1"), grown["y1"].alias("ey1"), grown["x2"].alias("ex2"), grown["y2"].alias("ey2"), share["x1"].alias("ax1"), share["y2"].alias("ay2"),
        budget["min_pixels"].alias("min_pixels"), budget["max_pixels"].alias("max_pixels"), around["x1"].alias("lo"), around["y2"].alias("hi"),
    )


@query("with m as (select p_partkey as k, list_transform(range(0, 16), lambda i: (i * p_partkey) % 3 = 0) as a, list_transform(range(0, 16), lambda i: (i + p_partkey) % 4 = 0 and p_partkey % 5 > 0) as b from part), c as (select k, len(list_filter(range(1, 17), lambda i: a[i] and b[i])) as n, len(list_filter(range(1, 17), lambda i: a[i] or b[i])) as u from m) select k, case when k % 7 = 0 or u = 0 then 0.0::double else n / u end as iou from c")
def mask_overlaps(spark, sf_dir):
    k = F.col("p_partkey")
    mask = lambda w, f: F.struct(F.lit(4).alias("h"), w.alias("w"), F.transform(F.sequence(F.lit(0), F.lit(15)), f).alias("bits"))
    a, b = mask(F.lit(4), lambda i: i * k % 3 == 0), mask(F.when(k % 7 == 0, 8).otherwise(4), lambda i: ((i + k) % 4 == 0) & (k % 5 > 0))
    return table(spark, sf_dir, "part").select(k.alias("k"), G.mask_iou(a, b).alias("iou"))


@query("select vec_id, embedding[1]::double as cls, round(list_sum(list_transform([embedding[1:32], embedding[33:64]], lambda v: v[1]::double)) / 2, 9) as mean1, greatest(embedding[2], embedding[34])::double as max2 from embeddings")
def pooled_vectors(spark, sf_dir):
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.pooled(halves, "cls")[0].cast("double").alias("cls"), F.round(V.pooled(halves)[0], 9).alias("mean1"), V.pooled(halves, "max")[1].alias("max2"))


@query("select n_nationkey as k, component, gb from (select n_nationkey, unnest(['llm', 'sam3', 'siglip', 'hico']) as component, unnest([16.0::double, 4, 2, 2]) as gb, unnest([true, n_nationkey % 2 = 0, n_nationkey % 3 = 0, false]) as used from nation) where used")
def vram_use(spark, sf_dir):
    k = F.col("n_nationkey")
    uses = F.create_map(F.lit("sam3"), k % 2 == 0, F.lit("siglip"), k % 3 == 0, F.lit("hico"), F.lit(False))
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.explode(records.vram_breakdown(uses)).alias("component", "gb"))


@query("""with m as (select item_id as media_id, length(text)::double as seconds from benchmark), p as (select * from (values ('light', 0.5::double, 120.0::double, null::bigint, 20.0::double), ('standard', 1.0, 300.0, null, 28.0), ('full', 2.0, 600.0, null, 45.0), ('eval baseline', 4.0, null, 64, 18.0), ('eval light', 4.0, null, 128, 22.0), ('eval full', 8.0, null, 256, 35.0)) v(name, fps, kept, most, vram_gb))
select media_id, name, vram_gb, least(floor(seconds * fps)::bigint, most) as frames, floor(least(seconds, kept) * fps)::bigint as context_frames from m, p""")
def presets(spark, sf_dir):
    return records.preset_frames(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("media_id"), F.length("text").cast("double").alias("seconds")))


# Filters and lookups


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def equal_lookup(spark, sf_dir):
    return records.where_equal(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_clerk=None).select("o_orderkey")


@query("select o_orderkey, 'part' as how from orders where contains(lower(o_orderpriority), 'high') union all select o_orderkey, 'exact' from orders where o_orderpriority = '5-LOW'")
def named_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = lambda df, how: df.select("o_orderkey", F.lit(how).alias("how"))
    return rows(records.where_named(o, "o_orderpriority", "HIGH"), "part").unionByName(rows(records.where_named(o, "o_orderpriority", "5-LOW", exact=True), "exact"))


@query(f"with {STS} select * from st where entity_id = 7 and t_sec between 500000 and 2000000")
def entity_history(spark, sf_dir):
    return graph.history(states(spark, sf_dir), 7, 500_000.0, 2_000_000.0)


@query(f"with {D.EDGES} select *, 0::int as part from ed where source_id = '7' union all select *, 1 from ed where target_id = '7'")
def entity_edges(spark, sf_dir):
    return graph.edges_of(D.edges(spark, sf_dir), "7")


@query("select conv_id as frame_idx, conv_id::double as t_sec, (row_number() over (partition by conv_id order by turn) - 1)::int as det_no, text, case when turn % 3 = 0 then 'unknown' else role end as category from conversations")
def flat_detections(spark, sf_dir):
    d = F.struct("turn", "text", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("category"))
    frames = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("frame_idx")).agg(F.sort_array(F.collect_list(d)).alias("detections")).withColumn("t_sec", F.col("frame_idx").cast("double"))
    return records.flattened(frames)


@query("select event_id, text from (select event_id, case when event_id % 4 = 0 then '  ' else event_type end as text, value / 100 as confidence from events) where confidence >= 0.5 and trim(text) <> ''")
def confident_texts(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("event_type")).alias("text"), (F.col("value") / 100).alias("confidence"))
    return records.confident(d).select("event_id", "text")


NOISY = "nz as (select user_id::varchar as timeline_id, event_id as seq, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t_sec, case when event_id % 3 = 0 then ' ' || upper(event_type) || '  x' when event_id % 7 = 0 then 'ab' else event_type || ' x' end as text, case when event_id % 5 > 0 then event_id % 100 / 100 end as confidence from events)"


@query(f"with {NOISY}, ok as (select * from nz where coalesce(confidence, 0.8) >= 0.7 and length(trim(text)) >= 3) select timeline_id, seq, text from ok qualify row_number() over (partition by timeline_id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') order by t_sec, seq) = 1")
def clean_texts(spark, sf_dir):
    e = F.col("seq")
    text = F.when(e % 3 == 0, F.concat(F.lit(" "), F.upper("modality"), F.lit("  x"))).when(e % 7 == 0, "ab").otherwise(F.concat("modality", F.lit(" x")))
    d = timeline(spark, sf_dir).select("timeline_id", "seq", "t_sec", text.alias("text"), F.when(e % 5 > 0, e % 100 / 100).alias("confidence"))
    return TL.clean_text(d).select("timeline_id", "seq", "text")


@query("select frame_id, prompt, det_no from (select user_id as frame_id, event_type as prompt, event_id as det_no, event_id * 7 % 500 as area, event_id % 10 / 10 as confidence from events) where area >= 100 and confidence > 0.4 qualify row_number() over (partition by frame_id, prompt order by confidence desc, det_no) = 1")
def best_masks(spark, sf_dir):
    e = F.col("event_id")
    return records.best_mask(table(spark, sf_dir, "events").select(F.col("user_id").alias("frame_id"), F.col("event_type").alias("prompt"), e.alias("det_no"), (e * 7 % 500).alias("area"), (e % 10 / 10).alias("confidence"))).select("frame_id", "prompt", "det_no")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P') order by o_orderkey limit 100")
def first_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("category"), F.lit(None).cast("double").alias("duration"))
    return evaluation.limited(evaluation.filtered(rows, categories=["F", "P"]), 100, "o_orderkey").select("o_orderkey")


@query("select conv_id, turn from conversations where case when role = 'user' then length(trim(text)) > 2 else length(trim(text)) > 5 and not contains(lower(text), 'no audio') end")
def audible_rows(spark, sf_dir):
    return records.audible(table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "user", "dialogue").otherwise("sound"))).select("conv_id", "turn")


def tokens(spark, sf_dir):
    return timeline(spark, sf_dir).select("timeline_id", "seq", F.col("t_sec").alias("start"), (F.col("t_sec") + F.col("duration")).alias("end"), F.when(F.col("seq") % 3 == 0, "fine").otherwise("clip").alias("level"), (F.col("seq") % 16).cast("int").alias("source_frame_count"))


TOKENS = f"{TLS}, tk as (select timeline_id, seq, t_sec as start, t_sec + duration as \"end\", case when seq % 3 = 0 then 'fine' else 'clip' end as level, (seq % 16)::int as source_frame_count from tl)"


@query(f"with {TOKENS} select timeline_id, seq from tk where start >= 900000 and \"end\" <= 1500000")
def inside_tokens(spark, sf_dir):
    return records.inside(tokens(spark, sf_dir), 900_000.0, 1_500_000.0).select("timeline_id", "seq")


@query(f"with {TOKENS} select timeline_id, count(*) as n_tokens, min(start) as first_start, max(\"end\") as last_end, array_to_string(list_sort(list(distinct level)), ',') as levels, sum(source_frame_count)::bigint as frames from tk group by timeline_id")
def token_summaries(spark, sf_dir):
    return sampling.token_summary(tokens(spark, sf_dir), "timeline_id").withColumn("levels", F.array_join("levels", ","))


@query(f"with {TOKENS} select timeline_id, seq from tk qualify row_number() over (partition by timeline_id order by seq desc) <= 20")
def newest_tokens(spark, sf_dir):
    return sampling.newest(tokens(spark, sf_dir), "timeline_id", "seq", 20).select("timeline_id", "seq")


EMBEDDED = "em as (select vec_id as emb_id, case label % 3 when 0 then 'visual' when 1 then 'temporal' else 'audio' end as modality, vec_id % 97 * 3.0::double as t0 from embeddings)"


@query(f"with {EMBEDDED} select emb_id, 'near' as how from em where abs(t0 - 120) < 30 union all select emb_id, 'first' from em qualify row_number() over (partition by modality order by t0, emb_id) <= case modality when 'visual' then 20 else 10 end")
def embeddings_in_time(spark, sf_dir):
    k = F.col("label") % 3
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("emb_id"), F.when(k == 0, "visual").when(k == 1, "temporal").otherwise("audio").alias("modality"), (F.col("vec_id") % 97 * 3.0).alias("t0"))
    rows = lambda t, how: retrieval.near_embeddings(e, t).select("emb_id", F.lit(how).alias("how"))
    return rows(120.0, "near").unionByName(rows(None, "first"))


# Joins


@query(f"with {STS} (select seq, 'nearest' as how from st order by abs(t_sec - 1000000), seq limit 1) union all (select seq, 'middle' from st order by seq limit 1 offset (select count(*) // 2 from st))")
def frames_at(spark, sf_dir):
    frames = states(spark, sf_dir).select(F.col("seq").alias("frame_idx"), "t_sec")
    rows = lambda t, how: joins.nearest_frame(frames, t).select(F.col("frame_idx").alias("seq"), F.lit(how).alias("how"))
    return rows(1e6, "nearest").unionByName(rows(None, "middle"))


@query(f"with {TLS}, c as (select timeline_id, seq as clip_id, t_sec as s, t_sec + 43200 as e from tl where modality = 'purchase') select clip_id, string_agg(description, ' ' order by t_sec, tl.seq) as joined from c join tl on c.timeline_id = tl.timeline_id and t_sec between s and e group by clip_id")
def clip_texts(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    clips = tl.where("modality = 'purchase'").select("timeline_id", F.col("seq").alias("clip_id"), F.col("t_sec").alias("start"), (F.col("t_sec") + D.DAY / 2).alias("end"))
    return joins.texts_within(clips, tl, " ", None, bucket=D.DAY / 2)


@query("with f as (select distinct user_id as video, event_id % 40 as t from events), d as (select user_id as video, event_id % 40 as t, event_type as label, event_id from events where event_type = 'error') select f.video, f.t::double as t_sec, coalesce(label, 'full_frame') as label, case when label is null then 640.0::double else event_id::double end as x2 from f left join d on f.video = d.video and f.t = d.t")
def frame_detections(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), (F.col("event_id") % 40).cast("double").alias("t_sec"), F.col("event_type").alias("label"), "event_id")
    det = e.where("label = 'error'").select("video", "t_sec", "label", G.box(F.lit(0), F.lit(0), F.col("event_id"), F.lit(1)).alias("bbox"))
    return joins.frames_with_detections(e.select("video", "t_sec").distinct(), det, 640.0, 360.0).select("video", "t_sec", "label", F.col("bbox.x2").alias("x2"))


@query(f"with {D.EDGES}, st2 as (select user_id::varchar as entity_id, event_id as seq, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t_sec from events), dg as (select source_id as id, 1 as o, 0 as i from ed union all select target_id, 0, 1 from ed) select e.entity_id, e.latest_t, coalesce(sum(o), 0)::bigint as n_out, coalesce(sum(i), 0)::bigint as n_in from (select entity_id, max(t_sec) as latest_t from st2 group by entity_id) e left join dg on e.entity_id = dg.id group by 1, 2")
def entity_overview(spark, sf_dir):
    s = states(spark, sf_dir).withColumn("entity_id", F.col("entity_id").cast("string"))
    return graph.overview(s.select("entity_id").distinct(), s, D.edges(spark, sf_dir))


WATCHED = "wt as (select conv_id::varchar as timeline_id, turn as seq, turn::double as t_sec, case when role = 'user' then 'ocr' else 'visual' end as modality, text || case turn % 6 when 0 then ' attacks' when 1 then ' critical damage' when 2 then ' uses healing' when 3 then ' Victory' when 4 then ' combat' else '' end as description, turn from conversations)"


def watched(spark, sf_dir):
    k = F.col("turn") % 6
    more = F.when(k == 0, " attacks").when(k == 1, " critical damage").when(k == 2, " uses healing").when(k == 3, " Victory").when(k == 4, " combat").otherwise("")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("timeline_id"), F.col("turn").alias("seq"), F.col("turn").cast("double").alias("t_sec"), F.when(F.col("role") == "user", "ocr").otherwise("visual").alias("modality"), F.concat("text", more).alias("description"))


CLASSES = f"""{WATCHED}, cl as (select timeline_id, seq, t_sec, description, 'attack' as type, 'cause' as side from wt where modality = 'ocr' and {any_sql('lower(description)', T.ATTACKS)} union all select timeline_id, seq, t_sec, description, 'skill', 'cause' from wt where modality = 'ocr' and {any_sql('lower(description)', T.SKILLS)}
 union all select timeline_id, seq, t_sec, description, 'combat_visual', 'cause' from wt where modality = 'visual' and {any_sql('lower(description)', ('combat', 'attack', 'weapon'))} union all select timeline_id, seq, t_sec, description, 'effect', 'effect' from wt where modality = 'ocr' and {any_sql('lower(description)', T.EFFECTS)} union all select timeline_id, seq, t_sec, description, 'victory', 'effect' from wt where modality = 'ocr' and {any_sql('lower(description)', T.VICTORIES)})"""


@query(f"with {CLASSES} select timeline_id, seq, type, side from cl")
def classified_texts(spark, sf_dir):
    causes, effects = joins.classified(watched(spark, sf_dir))
    rows = lambda df, side: df.select("timeline_id", "seq", "type", F.lit(side).alias("side"))
    return rows(causes, "cause").unionByName(rows(effects, "effect"))


@query(f"with {CLASSES} select c.timeline_id, c.seq as cause_seq, e.seq as effect_seq, c.type as cause_type, e.type as effect_type, printf('[%.1fs] %s... → [%.1fs] %s...', c.t_sec, c.description[1:50], e.t_sec, e.description[1:50]) as formatted from cl c join cl e on c.side = 'cause' and e.side = 'effect' and c.timeline_id = e.timeline_id and e.t_sec > c.t_sec and e.t_sec - c.t_sec <= 5")
def causal_lines(spark, sf_dir):
    return joins.causal_links(*joins.classified(watched(spark, sf_dir))).select("timeline_id", "cause_seq", "effect_seq", "cause_type", "effect_type", "formatted")


@query("select user_id, arg_max(value, event_id) as value from events group by user_id")
def last_durations(spark, sf_dir):
    return joins.last_value_of(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


# Counts and means


@query(f"with {D.SAMPLES} select 'task' as kind, task as name, count(*) as n from sm group by task union all select 'category', category, count(*) from sm group by category")
def loader_counts(spark, sf_dir):
    return evaluation.loader_counts(D.samples(spark, sf_dir))


@query(f"with {D.METRICS} select model_config as preset, count(*) as total, round(avg(correct::int), 6) as accuracy, round(avg(total_time), 6) as avg_latency, count(*) filter (where num_frames = 0) as n_errors from mt group by 1")
def preset_comparison(spark, sf_dir):
    m = D.metrics(spark, sf_dir)
    return evaluation.preset_comparison(m.select(F.col("model_config").alias("preset"), "correct", F.col("total_time").alias("latency_sec"), F.when(F.col("num_frames") == 0, "no frames").alias("error")))


@query("select o_orderkey as sample_id, 'late' as error from orders where o_orderkey % 50 = 0")
def failed_samples(spark, sf_dir):
    return evaluation.errors(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 50 == 0, "late").alias("error")))


@query("select s.state, count(o_orderkey) as n from (values ('active'), ('occluded'), ('lost'), ('terminated')) s(state) left join orders on s.state = case o_orderstatus when 'F' then 'active' when 'O' then 'lost' end group by s.state")
def state_counts(spark, sf_dir):
    return stateful.state_counts(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "lost").alias("state")))


def tracked(spark, sf_dir):
    return timeline(spark, sf_dir).select("timeline_id", F.col("modality").alias("entity_id"), "t_sec", F.col("seq").alias("det_no"), "seq", "confidence")


TRACKS = f"{TLS}, tr as (select timeline_id, modality as entity_id, t_sec, seq, confidence, row_number() over (partition by timeline_id, modality order by t_sec, seq) as k from tl), su as (select timeline_id, entity_id, min(t_sec) as first_seen, max(t_sec) as last_seen, max(t_sec) - min(t_sec) as duration, count(*) as n_frames, round(avg(confidence) filter (where k > 1), 6) as avg_confidence from tr group by 1, 2)"


@query(f"with {TRACKS} select * from su")
def track_summaries(spark, sf_dir):
    return stateful.track_summaries(tracked(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


MS = "printf('%02d:%02d', floor({0} / 60)::bigint, (floor({0})::bigint % 60))"


@query(f"with {TRACKS} select timeline_id, first_seen, entity_id, entity_id || ': ' || {MS.format('first_seen')} || '-' || {MS.format('last_seen')} || ', ' || n_frames || ' frames' as line from su")
def track_lines(spark, sf_dir):
    return records.knowledge_lines(stateful.track_summaries(tracked(spark, sf_dir)))


@query("select count(*) as n_files, coalesce(sum(n_chars), 0)::bigint as bytes from documents")
def cache_statistics(spark, sf_dir):
    return loaders.cache_statistics(table(spark, sf_dir, "documents").withColumn("size", F.col("n_chars")))


@query("with c as (select doc_id, n_chars, doc_id * 611 % 1000003 as mtime from documents), r as (select *, sum(n_chars) over (order by mtime desc, doc_id rows unbounded preceding) as kept, sum(n_chars) over () as total from c) select doc_id from r where total > 100000 and kept > 80000")
def evicted_files(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), (F.col("doc_id") * 611 % 1000003).alias("mtime"))
    return loaders.evicted(c, 100_000).select(F.col("key").alias("doc_id"))


@query("select count(*) as total_samples, round(sum(o_orderkey % 100 / 10), 6) as total_seconds, round(sum(o_orderkey % 100 / 10) / greatest(count(*), 1), 6) as avg_seconds from orders")
def run_statistics(spark, sf_dir):
    out = records.run_statistics(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100 / 10).alias("seconds")))
    return out.select("total_samples", F.round("total_seconds", 6).alias("total_seconds"), F.round("avg_seconds", 6).alias("avg_seconds"))


@query("with b as (select conv_id, turn, least(1.0, greatest(0.0, case when turn >= 3 then 0.3 else turn * 0.1 end + least(0.25, len(regexp_extract_all(text, '\\[?\\d{1,2}:\\d{2}\\]?')) * 0.05) + case when length(text) > 50 then case when contains(lower(text), 'because') then 0.15 else 0.1 end else 0.05 end + 0.15)) as s from conversations) select conv_id, turn, round(s * (0.5 + 0.5 * (0.5 + turn % 2 * 0.25) / 2 * 2), 6)::double as score from b")
def confidence_with_probabilities(spark, sf_dir):
    probs = F.array(F.lit(0.5) + F.col("turn") % 2 * 0.25, F.lit(0.5) + F.col("turn") % 2 * 0.25)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(T.confidence(F.col("turn"), F.lit("why"), F.col("text"), probs), 6).alias("score"))


# Windows of frames and sound


@query("select event_id as frame_idx, event_id / 30 as t_sec from events where event_id % 15 = 0")
def sampled_frames(spark, sf_dir):
    return sampling.every_nth(table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_idx")), 30.0, 2.0)


FRAMES = "fr as (select user_id as video, event_id as frame_idx, event_id / 30 as t_sec, row_number() over (partition by user_id order by event_id) - 1 as k from events)"


def frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame_idx"), (F.col("event_id") / 30).alias("t_sec"))


@query(f"with {FRAMES} select video, frame_idx, t_sec from fr where k % 4 = 0")
def subsampled_frames(spark, sf_dir):
    return sampling.subsampled(frames(spark, sf_dir), 2.0, 0.5)


@query(f"with {FRAMES}, c as (select video, unnest(range(greatest(0, (k - 16) // 8 + 1 - case when k < 16 and (k - 16) % 8 <> 0 then 1 else 0 end), k // 8 + 1))::int as chunk, k, t_sec from fr) select video, chunk, count(*) as n, max(case when k = chunk * 8 + 8 then t_sec end) as mid_t from c where k between chunk * 8 and chunk * 8 + 15 group by 1, 2 having count(*) = 16")
def frame_chunks(spark, sf_dir):
    return sampling.frame_chunks(frames(spark, sf_dir))


@query(f"with {FRAMES}, g as (select video, k // 16 as chunk, count(*) as n, min(t_sec) as first_t, list(frame_idx order by k) as f from fr group by 1, 2) select video, chunk::bigint as chunk, n, first_t, array_to_string(list_concat(f, list_transform(range(0, 16 - len(f)), lambda i: f[len(f)])), ',') as frames from g")
def padded_chunks(spark, sf_dir):
    return sampling.padded_chunks(frames(spark, sf_dir)).withColumn("frames", F.array_join("frames", ","))


@query("with m as (select item_id as media_id, length(text)::double / 7 as duration from benchmark), c as (select media_id, k::int as k, k * 10.0::double as start, least(k * 10.0::double + 10, duration) as e from m, unnest(range(0, ceil(duration / 10)::bigint)) t(k) where duration > 0) select media_id, k, start, e as \"end\" from c where e - start >= 1")
def tumbling_chunks(spark, sf_dir):
    return sampling.tumbling_chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("media_id"), (F.length("text").cast("double") / 7).alias("duration")))


@query("select p_partkey as k, array_to_string(case when p_size <= 1 then [0] else list_transform(range(0, least(p_size, 16)), lambda i: floor(i * (p_size - 1) / (least(p_size, 16) - 1))::bigint) end, ',') as frames from part")
def uniform_frames(spark, sf_dir):
    return sampling.uniform_frames(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n_frames"))).select("k", F.array_join("frames", ",").alias("frames"))


@query("select user_id::varchar as timeline_id, event_type as entity_id, count(*)::int as n_points, string_agg((event_id % 500 + 5)::varchar, ',' order by ts, event_id) as xs from events group by 1, 2")
def trajectories(spark, sf_dir):
    x = F.col("seq") % 500
    rows = timeline(spark, sf_dir).select("timeline_id", F.col("modality").alias("entity_id"), "t_sec", "seq", G.box(x, F.lit(0), x + 10, F.lit(4)).alias("bbox"))
    return sampling.trajectories(rows).select("timeline_id", "entity_id", "n_points", F.array_join(F.transform("centers", lambda p: p["x"].cast("bigint").cast("string")), ",").alias("xs"))


@query("select event_id, event_type || '_' || printf('%03d', k) as entity_id from (select event_id, event_type, row_number() over (partition by event_type order by event_id) as k from events)")
def numbered_entities(spark, sf_dir):
    return sampling.numbered_ids(table(spark, sf_dir, "events"), "event_type", ["event_id"]).select("event_id", "entity_id")


@query(f"with {TLS}, n as (select timeline_id, seq, modality || '_' || replace(printf('%.1f', (seq % 50) / 4 + 0.01), '.', '_') as entity_id from tl) select timeline_id, seq, entity_id from n qualify row_number() over (partition by timeline_id, entity_id order by seq) = 1")
def timed_entities(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("timeline_id", "seq", F.col("modality").alias("type"), (F.col("seq") % 50 / 4 + 0.01).alias("t_sec"))
    return sampling.time_ids(rows).select("timeline_id", "seq", "entity_id")


# Search results, exports, lines


@query("with r as (select label as query_id, vec_id as seq, 'title ' || vec_id as title, case vec_id % 3 when 0 then 'https://www.ign.com/a' when 1 then 'https://example.org/b' else 'https://x.fandom.com/c' end as url, 'text' as snippet from embeddings), k as (select *, case when vec3 = 1 then 1.0::double else 1.5 end as relevance from (select *, seq % 3 as vec3 from r)) select query_id, seq, relevance, case vec3 when 0 then 'ign' when 1 then 'web' else 'fandom' end as source from k qualify row_number() over (partition by query_id order by relevance desc, seq) <= 5")
def ranked_results(spark, sf_dir):
    k = F.col("vec_id") % 3
    url = F.when(k == 0, "https://www.ign.com/a").when(k == 1, "https://example.org/b").otherwise("https://x.fandom.com/c")
    r = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("seq"), F.concat(F.lit("title "), F.col("vec_id").cast("string")).alias("title"), url.alias("url"), F.lit("text").alias("snippet"))
    return records.ranked_results(r).select("query_id", "seq", "relevance", "source")


@query("select doc_lang, seq from (select lang as doc_lang, doc_id as seq, sum(length(source) + 10) over (partition by lang order by doc_id rows unbounded preceding) as chars from documents) where chars <= 2000")
def budgeted_results(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("seq"), F.col("source").alias("title"), F.lit("ten chars.").alias("snippet"))
    return records.result_texts(r).select(F.col("query_id").alias("doc_lang"), "seq")


@query(f"with {TLS}, l as (select timeline_id, t_sec, seq, {LINE} as line, row_number() over (partition by timeline_id order by t_sec, seq) as k, count(*) over (partition by timeline_id) as n from tl) select timeline_id, string_agg(line, chr(10) order by k) filter (where k <= 10) || case when max(n) > 10 then chr(10) || '... and ' || (max(n) - 10) || ' more' else '' end as text from l group by timeline_id")
def shortened_lines(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("timeline_id", "t_sec", T.compact(F.col("t_sec"), F.col("modality"), F.col("description")).alias("line"))
    return records.shortened(rows, "timeline_id", "t_sec", "line", 10)


@query(f"with {TLS} select timeline_id, t_sec as start, t_sec + duration as \"end\", case modality when 'view' then 'speech' else modality end as kind, description as text from tl where modality in ('view', 'error')")
def audio_rows(spark, sf_dir):
    tl = timeline(spark, sf_dir).select("timeline_id", "modality", F.col("t_sec").alias("start"), (F.col("t_sec") + F.col("duration")).alias("end"), "description")
    return records.audio_timeline(tl.where("modality = 'view'").withColumn("text", F.col("description")), tl.where("modality = 'error'").withColumn("type", F.col("modality")))


@query(f"""with {D.EDGES}, n as (select entity_id, first, max_t, row_number() over (order by max_t desc, entity_id) as k from (select user_id::varchar as entity_id, arg_min(event_type, (ts, event_id)) as first, max(ts) as max_t from events group by 1)), r as (select *, row_number() over (order by start_time desc, seq) as n from ed)
select 0::int as line_no, '## Entities' as line union all select 1000, '## Relationships' union all select k::int, '- ' || entity_id || ' (' || first || ')' from n where k <= 20 union all select (n + 1000)::int, '- ' || source_id || ' ' || relation_type || ' ' || target_id from r where n <= 30""")
def export_lines(spark, sf_dir):
    nodes = D.kb_entities(spark, sf_dir).withColumn("entity_id", F.col("entity_id").cast("string"))
    return graph.export_lines(nodes, D.edges(spark, sf_dir))


@query("select user_id, 'Detected regions:' || chr(10) || string_agg('- ' || event_type || ' (confidence: ' || printf('%.2f', (event_id % 100) / 100) || ')', chr(10) order by event_id) as text from events group by user_id")
def region_texts(spark, sf_dir):
    r = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("label"), (F.col("event_id") % 100 / 100).alias("confidence"))
    return retrieval.region_text(r, "user_id")


@query(f"with {TLS}, o as (select *, '[' || {MMSS} || '] [' || entity_id || '] (' || modality || ') ' || description as line, from_ as f from (select *, 1 as from_ from tl)), c as (select *, sum(length(line)) over (partition by timeline_id order by t_sec, seq rows unbounded preceding) as chars from o), v as (select *, min(case when chars > 1000 then (t_sec, seq) end) over (partition by timeline_id) as over_ from c) select timeline_id, string_agg(case when (t_sec, seq) = over_ then '... (truncated)' else line end, chr(10) order by t_sec, seq) as context from v where over_ is null or (t_sec, seq) <= over_ group by timeline_id")
def context_texts(spark, sf_dir):
    return retrieval.context_text(timeline(spark, sf_dir), "timeline_id", 1000)


# Streams made one timeline


def stream(spark, sf_dir, kind: str) -> DataFrame:
    return timeline(spark, sf_dir).where(F.col("modality") == kind).select("timeline_id", "seq", "t_sec", F.col("description").alias("text"), (F.col("t_sec") + F.col("duration")).alias("end_time"), "confidence", "entity_id", F.when(F.col("seq") % 4 == 0, "high_action").otherwise("low").alias("motion_type"), F.when(F.col("seq") % 2 == 0, "dialogue").otherwise("sound").alias("kind"))


def turned(k: int) -> str:
    return f"seq + {k << 40}::bigint as seq"


@query(f"with {TLS} select timeline_id, {turned(0)}, t_sec, 'ocr' as modality, description, 2::int as priority, 0.0::double as duration, null::varchar as entity_id, confidence from tl where modality = 'click' union all select timeline_id, {turned(1)}, t_sec, 'speech', description, 1, (t_sec + duration) - t_sec, null, confidence from tl where modality = 'view' union all select timeline_id, {turned(2)}, t_sec, 'visual', description, 3, 0.0, entity_id, confidence from tl where modality = 'error'")
def fused_live(spark, sf_dir):
    return TL.fused(*(stream(spark, sf_dir, k) for k in ("click", "view", "error")))


@query(f"with {TLS} select timeline_id, {turned(0)}, t_sec, 'ocr' as modality, 'Text: \"' || description || '\"' as description, case when confidence > 0.8 then 1 else 2 end::int as priority, 0.0::double as duration, null::varchar as entity_id, confidence from tl where modality = 'click' union all select timeline_id, {turned(1)}, t_sec, 'visual', description, case when seq % 4 = 0 then 1 else 2 end, 0.0, null, confidence from tl where modality = 'error' union all select timeline_id, {turned(2)}, t_sec, case when seq % 2 = 0 then 'speech' else 'audio' end, description, 1, (t_sec + duration) - t_sec, null, 1.0 from tl where modality = 'view' union all select timeline_id, {3 << 40}, 0.0, 'temporal', 'Temporal context: ' || count(*) || ' frames compressed to ' || count(*) // 8 || ' tokens', 3, 0.0, null, 1.0 from tl group by timeline_id having count(*) // 8 > 0")
def fused_extracted(spark, sf_dir):
    n = timeline(spark, sf_dir).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("n_tokens", F.floor(F.col("n_frames") / 8))
    return TL.fused_extracted(stream(spark, sf_dir, "click"), stream(spark, sf_dir, "error"), stream(spark, sf_dir, "view"), n)


@query(f"with {TOKENS} select timeline_id, seq, start as t_sec, 'temporal' as modality, level || ' segment (' || source_frame_count || ' frames)' as description, 2::int as priority, \"end\" - start as duration, null::varchar as entity_id, 1.0::double as confidence from tk")
def events_of_tokens(spark, sf_dir):
    return TL.from_tokens(tokens(spark, sf_dir))


@query(f"with {TLS} select timeline_id, seq, case when regexp_full_match(trim(x), '[0-9]{{1,6}}') or contains(lower(x), 'hp') or contains(lower(x), 'health') or contains(x, '/') then 2 else 3 end::int as priority from (select *, case seq % 4 when 0 then seq::varchar when 1 then 'HP ' || seq when 2 then 'Level ' || seq else description end as x from tl)")
def events_of_text(spark, sf_dir):
    k = F.col("seq") % 4
    text = F.when(k == 0, F.col("seq").cast("string")).when(k == 1, F.concat(F.lit("HP "), F.col("seq").cast("string"))).when(k == 2, F.concat(F.lit("Level "), F.col("seq").cast("string"))).otherwise(F.col("description"))
    return TL.from_text(timeline(spark, sf_dir).withColumn("text", text)).select("timeline_id", "seq", "priority")


@query(f"with {TLS} select timeline_id, seq, 12.5::double as t_sec, 'visual' as modality, modality || ' detected' as description, 2::int as priority, 0.0::double as duration, entity_id, confidence from tl where seq % 30 = 4")
def events_of_entities(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("concept_label", F.col("modality")).withColumn("frame_idx", F.col("seq") % 30)
    return TL.from_entities(rows, 4, 12.5)


@query(f"with {TLS} select timeline_id, {turned(0)}, t_sec, 'speech' as modality, description, 2::int as priority, (t_sec + duration) - t_sec as duration, null::varchar as entity_id, confidence from tl where modality = 'view' union all select timeline_id, {turned(1)}, t_sec, 'audio', description, 2, (t_sec + duration) - t_sec, null, confidence from tl where modality = 'error'")
def events_of_audio(spark, sf_dir):
    return TL.from_audio(stream(spark, sf_dir, "view"), stream(spark, sf_dir, "error"))


@query(f"with {TLS}, o as (select * from tl where modality <> 'error'), m as (select timeline_id, max(seq) as last from o group by 1), e as (select tl.*, row_number() over (partition by tl.timeline_id order by seq) as k from tl where modality = 'error') select timeline_id, seq, description from o union all select e.timeline_id, coalesce(last + k, k - 1), description from e left join m on e.timeline_id = m.timeline_id")
def appended_events(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    return TL.appended(tl.where("modality <> 'error'"), tl.where("modality = 'error'")).select("timeline_id", "seq", "description")


@query("select user_id as entity_id, arg_min(event_type, (event_id)) as concept_label, min(event_id)::double as first_seen, max(event_id)::double as last_seen from events group by user_id")
def upserted_entities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = lambda df: df.groupBy(F.col("user_id").alias("entity_id")).agg(F.min_by("event_type", "event_id").alias("concept_label"), F.min_by("event_type", "event_id").alias("category"), F.min("event_id").cast("double").alias("first_seen"), F.max("event_id").cast("double").alias("last_seen"))
    return records.upserted(rows(e.where("event_id % 2 = 0")), rows(e.where("event_id % 2 = 1"))).drop("category")


# Files: written from the driver's tables, read by the readers


def as_json(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    loaders.write_json(df, path)
    return path


def as_list(df: DataFrame, name: str, container: str | None = None) -> str:
    """One JSON file with a list of the rows, under a name of its own if asked."""
    path = new_path(df.sparkSession, name)
    body = F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns))))
    whole = df.agg(body.alias("b")).select(F.concat(F.lit('{"' + container + '":'), "b", F.lit("}")) if container else F.col("b"))
    whole.coalesce(1).write.text(path)
    return path


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.format_string("i%06d", "item_id").alias("id"), F.substring("text", 1, 60).alias("question"), F.col("item_id").alias("n"))


ITEMS = "it as (select printf('i%06d', item_id) as id, text[1:60] as question, item_id as n from benchmark)"


@query(f"with {ITEMS} select id as sample_id, question, 'yes' as answer, 'glitch_detection' as task, 'clip' || n % 3 as category, 'binary' as answer_format, n::double as start_time from it")
def glitch_samples(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "question", F.concat(F.lit("clip"), (F.col("n") % 3).cast("string")).alias("glitch_type"), F.col("n").alias("start_time"))
    return loaders.glitches(spark, as_list(rows, "glitches")).select("sample_id", "question", "answer", "task", "category", "answer_format", "start_time")


@query(f"with {ITEMS} select id as sample_id, 'physics_understanding' as task, 'mechanics' as category, 'B' as answer, 2::int as n_options, 'mcq' as answer_format from it")
def physics_samples(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "question", F.array(F.lit("up"), F.lit("down")).alias("options"), F.lit("B").alias("answer"), F.lit("mechanics").alias("domain"))
    return loaders.physics(spark, as_list(rows, "physics", "samples")).select("sample_id", "task", "category", "answer", F.size("options").alias("n_options"), "answer_format")


GAME_TASK = "case " + " ".join(f"when task = '{t}' then '{m}'" for t, m in loaders.TASKS) + " else 'visual_qa' end"


@query(f"with {ITEMS}, t as (select id, case n % 4 when 0 then 'bug_report' when 1 then 'temporal_qa' when 2 then 'needle_haystack' else 'other' end as task from it) select id as sample_id, {GAME_TASK} as task, task as raw_task, case when task = 'bug_report' then 'free_text' else 'binary' end as answer_format from t")
def game_question_samples(spark, sf_dir):
    k = F.col("n") % 4
    rows = items(spark, sf_dir).select("id", F.col("question").alias("query"), F.when(k == 0, "bug_report").when(k == 1, "temporal_qa").when(k == 2, "needle_haystack").otherwise("other").alias("task"), F.lit("no").alias("answer"))
    return loaders.game_questions(spark, as_list(rows, "questions")).select("sample_id", "task", "raw_task", "answer_format")


@query(f"with {ITEMS} select id as sample_id, case when n % 3 = 0 then 'temporal_reasoning' when contains(lower(question), 'when') then 'temporal_reasoning' else 'visual_qa' end as task, n * 1.5::double as duration from it")
def long_question_samples(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "question", F.when(F.col("n") % 3 == 0, "Temporal order").otherwise("count").alias("task"), (F.col("n") * 1.5).alias("duration"))
    return loaders.long_questions(spark, as_list(rows, "long", "questions")).select("sample_id", "task", "duration")


@query(f"with {ITEMS} select id as sample_id, case n % 3 when 0 then 'needle_in_haystack' when 1 then 'temporal_reasoning' else 'visual_qa' end as task from it")
def long_video_samples(spark, sf_dir):
    k = F.col("n") % 3
    rows = items(spark, sf_dir).select("id", "question", F.when(k == 0, "findNeedle").when(k == 1, "plotQA").otherwise("ego").alias("question_type"))
    return loaders.long_videos(spark, as_list(rows, "mlvu")).select("sample_id", "task")


@query(f"with {ITEMS} select id as sample_id, question, 'visual_qa' as task from it")
def plain_samples(spark, sf_dir):
    return loaders.plain_benchmark(spark, as_list(items(spark, sf_dir).select("id", "question"), "plain", "samples")).select("sample_id", "question", "task")


@query(f"with {ITEMS} select question, id as answer from it")
def training_pairs(spark, sf_dir):
    return loaders.training_pairs(spark, as_list(items(spark, sf_dir).select("question", F.col("id").alias("answer")), "pairs"))


@query(f"with {ITEMS} select question as asked, id as answered, 2::int as n from it")
def training_messages(spark, sf_dir):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    rows = items(spark, sf_dir).select(F.array(turn("user", "question"), turn("assistant", "id")).alias("messages"))
    return loaders.training_messages(spark, as_list(rows, "messages")).select(F.col("messages")[0]["content"].alias("asked"), F.col("messages")[1]["content"].alias("answered"), F.size("messages").alias("n"))


@query("select conv_id, turn, role, text from conversations")
def saved_conversations(spark, sf_dir):
    path = new_path(spark, "conversations")
    loaders.save_conversations(table(spark, sf_dir, "conversations"), path)
    return loaders.load_conversation(spark, path).select("conv_id", "turn", "role", "text")


@query("select o_orderkey as sample_id, o_orderstatus as predicted, o_orderkey % 3 = 0 as correct, (o_orderkey % 1000) / 100 as total_time from orders")
def saved_results(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("predicted"), (F.col("o_orderkey") % 3 == 0).alias("correct"), (F.col("o_orderkey") % 1000 / 100).alias("total_time"))
    return loaders.read_json(spark, as_json(rows, "results"), "sample_id long, predicted string, correct boolean, total_time double")


@query("select page_id, regexp_matches(url, '^https?://(www\\.)?youtube\\.com/watch\\?v=|^https?://youtu\\.be/|^https?://(www\\.)?youtube\\.com/shorts/') as is_video from pages")
def video_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", loaders.is_video_url(F.col("url")).alias("is_video"))


@query("with c as (select md5(lower(text)) as key, max(conv_id) * 1000.0::double as ts from conversations where conv_id % 2 = 0 group by 1) select conv_id, turn, key from conversations join c on key = md5(lower(text)) where ts > 100000 - 86400")
def cached_searches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    cache = c.where("conv_id % 2 = 0").groupBy(F.md5(F.lower("text").cast("binary")).alias("key")).agg((F.max("conv_id") * 1000.0).alias("ts"))
    return loaders.cached_searches(c.select("conv_id", "turn", F.col("text").alias("query")), cache, 100_000.0).select("conv_id", "turn", "key")
