"""Queries of media files, caches, outputs and training samples on the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus, graph, pooling, records
from tidemark.plans.driver import DAY, EDGES, METRICS, ORACLES, TLS, edges, kb_entities, metrics, query, table, timeline
from tidemark.sources import audio, feature_cache, frames, loaders, registry, results
from tidemark.storage import new_path


def files(rows: DataFrame, folder: str) -> None:
    """Writes a file (name, body) a row below a folder that driver and executors share."""

    def run(batches):
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, path = audio.filesystem(f"{folder}/{name}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(body)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows.select("name", "body").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def wave(raw) -> DataFrame:
    return F.udf(lambda b: audio.pcm(bytes(b), 100, 1, 8), "binary", useArrow=False)(raw)


@query("""with b as (select conv_id, octet_length(encode(text)) as n from conversations where turn = 0), c as (select conv_id, 2 * n as total, unnest(range(0, greatest(1, ceil((2 * n - 100) / 300))::bigint)) as k from b where n > 0)
select conv_id, k as chunk, k * 300 / 200.0::double as start, least(k * 300 + 400, total) / 200.0::double as "end", (least(k * 300 + 400, total) - k * 300)::int as n_samples from c""")
def audio_file_chunks(spark, sf_dir):
    """Each conversation's first turn as a recording of its bytes, 100 a second; chunks at 200 samples a second."""
    folder = new_path(spark, "recordings")
    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    files(turns.select(F.concat(F.lit("c"), "conv_id", F.lit(".wav")).alias("name"), wave(F.col("text").cast("binary")).alias("body")), folder)
    chunks = registry.read(spark, "wav", folder, rate=200, chunk=2.0, overlap=0.5, split=256)
    return chunks.select(F.regexp_extract("path", r"c(\d+)\.wav$", 1).cast("bigint").alias("conv_id"), "chunk", "start", "end", F.size("samples").alias("n_samples"))


VIDEO_SQL = """n as (select item_id, case item_id % 4 when 0 then 'mechanics/deep/gravity_' || item_id || '.mp4' when 1 then 'optics/x_Shadows_lighting' || item_id || '.MKV' when 2 then 'materials/gravity' || item_id || '.avi' else 'other/fluids' || item_id || '.txt' end as name, text from benchmark)"""


def video_files(spark, sf_dir) -> str:
    folder, k = new_path(spark, "videos"), F.col("item_id") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("mechanics/deep/gravity_"), "item_id", F.lit(".mp4"))).when(k == 1, F.concat(F.lit("optics/x_Shadows_lighting"), "item_id", F.lit(".MKV")))
        .when(k == 2, F.concat(F.lit("materials/gravity"), "item_id", F.lit(".avi"))).otherwise(F.concat(F.lit("other/fluids"), "item_id", F.lit(".txt")))
    )
    files(table(spark, sf_dir, "benchmark").select(name.alias("name"), F.col("text").cast("binary").alias("body")), folder)
    return folder


@query(f"with {VIDEO_SQL} select regexp_extract(name, '([^/]*)\\.[^.]*$', 1) as video_id, octet_length(encode(text)) as length from n where not ends_with(name, '.txt')")
def listed_videos(spark, sf_dir):
    return loaders.videos(spark, video_files(spark, sf_dir)).select("video_id", "length")


@query(f"""with {VIDEO_SQL} select regexp_extract(name, '([^/]*)\\.[^.]*$', 1) as sample_id, name as video_path, split_part(name, '/', 1) as domain,
case split_part(name, '/', 1) when 'mechanics' then 'gravity' when 'optics' then 'lighting' else 'unknown' end as category from n where not ends_with(name, '.txt')""")
def physics_folders(spark, sf_dir):
    return loaders.physics_videos(spark, video_files(spark, sf_dir))


@query("select vec_id::varchar as video, case when vec_id % 2 = 0 then 'siglip' else 'wav2vec2' end as modality, vec_id / 2.0::double as t0, vec_id / 2.0::double + 1 as t1, len(embedding)::int as d from embeddings")
def embedding_files(spark, sf_dir):
    path = new_path(spark, "embeddings")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("video"), F.when(F.col("vec_id") % 2 == 0, "siglip").otherwise("wav2vec2").alias("modality"), (F.col("vec_id") / 2.0).alias("t0"), (F.col("vec_id") / 2.0 + 1).alias("t1"), F.col("embedding").alias("vec"))
    rows.write.parquet(path)
    return registry.read(spark, "embeddings", path).select("video", "modality", "t0", "t1", F.size("vec").alias("d"))


@query("""with v as (select conv_id, turn, md5('v' || conv_id) as video_hash, case when conv_id % 4 = 1 then 'again ' || text else text end as text from conversations where conv_id % 4 <> 2)
select video_hash, turn, octet_length(encode(text)) as chars, conv_id % 4 <> 1 as stale from v""")
def feature_cache_round(spark, sf_dir):
    """Every conversation's turns as a video's features: all saved, a quarter saved anew by a later version, a quarter forgotten, and what is left loaded."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    rows = c.select(F.md5(F.concat(F.lit("v"), "conv_id").cast("binary")).alias("video_hash"), F.concat(F.lit("v"), "conv_id").alias("video_path"), "conv_id", "turn", "text")
    old = feature_cache.FeatureCache(spark, new_path(spark, "features"), "1.0")
    old.save(rows, 1.0)
    new = feature_cache.FeatureCache(spark, old.folder, "2.0")
    new.save(rows.where(k == 1).withColumn("text", F.concat(F.lit("again "), "text")), 2.0)
    new.invalidate(rows.where(k == 2).select("video_hash"))
    return new.load(rows.select("video_hash")).select("video_hash", "turn", F.octet_length("text").cast("bigint").alias("chars"), "stale")


@query("with o as (select o_orderstatus as status, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1) select 'totals' as output, status as name, n, keys from o union all select 'lines', o_orderpriority, count(*), max(o_orderkey) from orders group by 2 union all select 'rows', '', count(*), min(o_orderkey) from orders")
def outputs_of_one_run(spark, sf_dir):
    path = new_path(spark, "outputs")
    feature_cache.write_outputs(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, {
        "totals": lambda d: d.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")),
        "lines": lambda d: d.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("keys")),
        "rows": lambda d: d.agg(F.lit("").alias("name"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("keys")),
    })
    outs = [feature_cache.read_output(spark, path, n).select(F.lit(n).alias("output"), "name", "n", "keys") for n in ("totals", "lines", "rows")]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


CORPUS = f"""{TLS}, i as (select timeline_id, seq, t_sec as s, t_sec as e from tl where modality = 'error'), c as (select timeline_id, seq, t_sec as s, t_sec + 86400 as e from tl where modality = 'purchase'), a as (select timeline_id, seq, t_sec as s, t_sec + 43200 as e from tl where modality = 'signup'),
x as (select 'siglip' as modality, i.*, t_sec, tl.seq as q, description, 3 as most from i left join tl on tl.timeline_id = i.timeline_id and abs(t_sec - s) < 43200
    union all select 'videomae', c.*, t_sec, tl.seq, description, 5 from c left join tl on tl.timeline_id = c.timeline_id and t_sec >= s and t_sec <= e
    union all select 'wav2vec2', a.*, t_sec, tl.seq, description, 1000000 from a left join tl on tl.timeline_id = a.timeline_id and t_sec >= s and t_sec <= e and modality = 'view'),
r as (select *, row_number() over (partition by modality, seq order by t_sec, q) as n from x),
g as (select timeline_id as video, modality, seq as emb_id, s as t_sec, e, case modality when 'wav2vec2' then string_agg(description, ' ' order by t_sec, q) else string_agg(description, '; ' order by t_sec, q) end as joined from r where n <= most group by timeline_id, modality, seq, s, e),
smp as (select video, modality, emb_id, t_sec, coalesce(joined, case modality when 'siglip' then 'Visual content detected' when 'videomae' then 'Temporal video segment' else 'Audio segment detected' end) as context, e from g)"""
CORPUS_ROWS = """select video, modality, emb_id, t_sec, context, case modality when 'siglip' then printf('At timestamp %.1fs, the visual analysis shows: %s', t_sec, context) when 'videomae' then printf('From %.1fs to %.1fs, the temporal analysis shows: %s', t_sec, e, context) else printf('Audio from %.1fs to %.1fs: %s', t_sec, e, context) end as target from smp"""


def samples(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    of = lambda m, length: tl.where(F.col("modality") == m).select("timeline_id", F.col("seq").alias("clip_id"), F.col("t_sec").alias("start"), (F.col("t_sec") + length).alias("end"))
    images = tl.where("modality = 'error'").select("timeline_id", F.col("seq").alias("emb_id"), F.col("t_sec").alias("t_emb"))
    return corpus.training_samples(images, of("purchase", DAY), of("signup", DAY / 2), tl, tl.where("modality = 'view'"), DAY / 2)


@query(f"with {CORPUS} {CORPUS_ROWS}")
def training_samples(spark, sf_dir):
    return samples(spark, sf_dir)


@query(f"with {CORPUS}, n as (select *, row_number() over (partition by modality order by md5('42:' || emb_id), emb_id) as n from smp) select modality, emb_id, context from n where n <= 40")
def sampled_strata(spark, sf_dir):
    """A seeded sample of forty of each modality."""
    picked = corpus.sampled(samples(spark, sf_dir), ["modality"], "emb_id", 40)
    parts = list(corpus.by_modality(picked).values())
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("modality", "emb_id", "context")


@query("select doc_id from documents order by md5('7:' || doc_id), doc_id limit 100")
def shuffled_samples(spark, sf_dir):
    return corpus.shuffled_head(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "7")


@query("""with l as (select 'entities' as kind, doc_id, doc_id || ' ' || source as line, row_number() over (partition by lang order by doc_id) as n, count(*) over (partition by lang) as total, lang, 50 as most from documents
    union all select 'regions', doc_id, doc_id || ' ' || source, row_number() over (partition by lang order by doc_id), count(*) over (partition by lang), lang, 100 from documents)
select kind, lang, string_agg(line, chr(10) order by doc_id) || case when max(total) > max(most) then chr(10) || '... and ' || (max(total) - max(most)) || ' more' else '' end as text from l where n <= most group by kind, lang""")
def export_limits(spark, sf_dir):
    """The first lines of each language: fifty of one kind, a hundred of another, and how many more there are."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), "source").alias("line"))
    one = lambda kind, most: records.shortened(rows, "lang", "doc_id", "line", most).select(F.lit(kind).alias("kind"), "lang", "text")
    return one("entities", 50).unionByName(one("regions", 100))


@query("select doc_id, 2 * len(regexp_extract_all(text, '[^\\s\\x0B]+'))::int as n from documents where text is not null")
def output_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.output_tokens(F.col("text")).alias("n"))


@query("select count(*) as total_samples, (select sum(ps)::double from (select o_custkey, max(o_orderkey % 500) as ps from orders group by 1)) as total_perception_time_sec, sum(o_orderkey % 1000)::double as total_inference_time_sec, (select avg(ps)::double from (select o_custkey, max(o_orderkey % 500) as ps from orders group by 1)) as avg_perception_time_sec, sum(o_orderkey % 1000)::double / count(*) as avg_inference_time_sec from orders")
def pipeline_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    videos = o.groupBy("o_custkey").agg((F.max(F.col("o_orderkey") % 500)).cast("double").alias("seconds"))
    return records.pipeline_statistics(o.select((F.col("o_orderkey") % 1000).cast("double").alias("seconds")), videos)


@query(f"""with {EDGES}, kb as ({ORACLES["kb_entities"]}) select 'node' as part, entity_id as a, concept_label as b, category as c, first_seen as t0, last_seen as t1 from kb where last_seen >= 2000000 - 500000
union all select 'edge', source_id, target_id, relation_type, start_time, end_time from ed""")
def graph_parts(spark, sf_dir):
    nodes, links = graph.graph_tables(kb_entities(spark, sf_dir), edges(spark, sf_dir), 2e6, 5e5)
    a = nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("category").alias("c"), F.col("first_seen").alias("t0"), F.col("last_seen").alias("t1"))
    return a.unionByName(links.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c"), F.col("start_time").alias("t0"), F.col("end_time").alias("t1")))


@query()
def attention_tokens(spark, sf_dir):
    """The embeddings of each label as the tokens of a video, pooled with weights that Spark derives from the table's own means."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("place"), F.col("embedding").alias("token"))
    d = 64
    mean = e.select(F.posexplode("token").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))
    flat = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"] + F.when(x["i"] % 2 == 0, 0.5).otherwise(-0.5)).alias("m"))
    turned = lambda row, by: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.get("m", F.pmod(j + row, F.lit(d))) * F.when(j == row, by).otherwise(0.25))
    square = flat.select("m", F.explode(F.array(*[F.lit(n) for n in pooling.MATRICES])).alias("name")).select("m", "name", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("row"))
    weights = square.select("name", "row", turned(F.col("row"), 2.0).alias("values")).unionByName(flat.select(F.explode(F.array(*[F.lit(n) for n in pooling.ROWS])).alias("name"), F.lit(0).alias("row"), F.col("m").alias("values")))
    return pooling.attention_pooled(e, weights).select("key", "n", F.transform("pooled", lambda v: F.round(v, 6)).alias("pooled"))


@query("""with b as (select conv_id, hex(encode(text)) as h from conversations where turn = 0), f as (select conv_id, h, unnest(range(0, length(h) // 128, 6)) as k from b)
select conv_id, k as frame_idx, k / 25.0::double as t_sec, 8::int as width, substr(h, 1 + 128 * k, 128) as pixels from f""")
def video_frames(spark, sf_dir):
    """Each conversation's first turn as a grey video of its bytes, 8 by 8 at 25 frames a second, sampled at four: every sixth frame."""
    folder = new_path(spark, "films")
    body = F.udf(lambda b: frames.file([bytes(b[k : k + 64]) for k in range(0, len(b) - 63, 64)], 8, 8), "binary", useArrow=False)
    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    files(turns.select(F.concat(F.lit("c"), "conv_id", F.lit(".y4m")).alias("name"), body(F.col("text").cast("binary")).alias("body")), folder)
    found = registry.read(spark, "y4m", folder, fps=4, pixels="grey", split=512)
    return found.select(F.regexp_extract("path", r"c(\d+)\.y4m$", 1).cast("bigint").alias("conv_id"), "frame_idx", "t_sec", "width", F.hex("pixels").alias("pixels"))


@query(ORACLES["metrics_by_config"])
def saved_aggregates(spark, sf_dir):
    path = new_path(spark, "evaluation")
    results.save_results(metrics(spark, sf_dir), path)
    return feature_cache.read_output(spark, path, "aggregates")


@query(f"""with {METRICS}, t as (select model_config, benchmark, count(*) as n, avg(correct::int) as accuracy, avg(total_tokens) as tokens, avg(total_time) as seconds, max(peak_vram_gb) as vram from mt group by 1, 2)
select model_config, benchmark, model_config || ' | ' || benchmark || ' | ' || n || ' | ' || printf('%.1f', round(accuracy, 6) * 100) || '% | ' || printf('%.1f', vram) as line from t""")
def evaluation_summary(spark, sf_dir):
    """The saved summary, but for its means of tokens and seconds, sums of which hang on their order."""
    path = new_path(spark, "evaluation")
    results.save_results(metrics(spark, sf_dir), path)
    parts = F.split("line", r" \| ")
    return feature_cache.read_output(spark, path, "summary").select("model_config", "benchmark", F.concat_ws(" | ", *[parts[k] for k in (0, 1, 2, 3, 6)]).alias("line"))


@query("""select o_orderkey::varchar as sample_id, 'b' || o_custkey as benchmark, o_orderkey % 3 = 0 as correct, o_orderstatus as predicted, case when o_orderkey % 2 = 0 then o_orderkey % 256 else 0 end::int as num_frames,
case when o_orderkey % 2 = 0 then o_orderkey / 4 else 0 end::double as total_time, '' as question, 0.0::double as confidence from orders""")
def loaded_samples(spark, sf_dir):
    """Every order as a saved sample, each second without the optional fields."""
    k = F.col("o_orderkey")
    some = lambda v: F.when(k % 2 == 0, v)
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("sample_id"), F.concat(F.lit("b"), "o_custkey").alias("benchmark"), F.col("o_orderpriority").alias("task_type"), F.lit("m").alias("model_config"), (k % 3 == 0).alias("correct"),
        F.col("o_orderstatus").alias("predicted"), F.lit("yes").alias("ground_truth"), some(k % 256).alias("num_frames"), some(k / 4).alias("total_time"),
    )
    path = new_path(spark, "samples")
    loaders.write_json(rows, path)
    return results.load_samples(spark, path).select("sample_id", "benchmark", "correct", "predicted", "num_frames", "total_time", "question", "confidence")
