"""The driver's queries and the SQL that each must equal.

Times and gaps of the operators suit recordings; the ``events`` table is sparser, so that windows here are days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import text as T
from tidemark.operators import chat, evaluation, graph, joins, retrieval, sampling, stateful
from tidemark.operators import timeline as TL

DAY = 86400.0
MODALITIES = ["click", "error", "purchase", "signup", "view", "speech"]
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.events_timeline(table(spark, sf_dir, "events"))


TLS = r"""tl as (select user_id::varchar as timeline_id, event_id as seq, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t_sec, event_type as modality,
 event_type || ' ' || coalesce(regexp_extract(props, '"k": ([0-9]+)', 1), '') as description, case event_type when 'error' then 0 when 'purchase' then 1 when 'click' then 2 when 'view' then 3 else 4 end as priority,
 value as duration, user_id::varchar as entity_id, least(value / 560, 1.0) as confidence from events)"""
MMSS = "printf('%02d:%02d', floor(t_sec / 60)::bigint, (floor(t_sec)::bigint % 60))"
LINE = f"'[' || {MMSS} || '] ' || description"


@query(f"""with {TLS}, r as (select *, row_number() over (partition by timeline_id order by priority, t_sec, seq) as n from tl where priority <> 3)
select timeline_id, count(*) as n_lines, string_agg({LINE}, chr(10) order by t_sec, seq) as transcript from r where n <= 50 group by timeline_id""")
def timeline_transcript(spark, sf_dir):
    return TL.transcript(timeline(spark, sf_dir))


@query(f"with {TLS} select * from tl where t_sec between 864000 and 1296000 and modality in ('click', 'view', 'error') and priority <> 3")
def timeline_range(spark, sf_dir):
    return TL.in_range(timeline(spark, sf_dir), 864000.0, 1296000.0, ["click", "view", "error"])


@query(f"with {TLS} select * from tl where t_sec between 1000000 - 43200 and 1000000 + 43200 and priority <> 3")
def timeline_around(spark, sf_dir):
    return TL.around(timeline(spark, sf_dir), 1_000_000.0, DAY)


@query(f"with {TLS} select * from tl where entity_id = '7' and t_sec <= 2000000")
def timeline_entity(spark, sf_dir):
    return TL.of_entity(timeline(spark, sf_dir), "7", end=2_000_000.0)


@query(f"with {TLS} select *, t_sec + duration as end_time from tl where modality = 'view'")
def timeline_modality(spark, sf_dir):
    return TL.end_time(TL.of_modality(timeline(spark, sf_dir), "view"))


RUNS = f"""{TLS}, l as (select *, case when lag(modality) over w = modality and lag(entity_id) over w is not distinct from entity_id and t_sec - lag(t_sec) over w <= 86400 then 0 else 1 end as s from tl window w as (partition by timeline_id order by t_sec, seq)),
r as (select *, sum(s) over (partition by timeline_id order by t_sec, seq rows unbounded preceding) as run from l),
d as (select timeline_id, run, description, min(t_sec) as dt, min(seq) as ds from r group by all), dn as (select *, row_number() over (partition by timeline_id, run order by dt, ds) as n from d),
ds as (select timeline_id, run, string_agg(description, '; ' order by n) as names from dn where n <= 3 group by timeline_id, run),
g as (select timeline_id, run, arg_min(seq, (t_sec, seq)) as seq, min(t_sec) as t_sec, arg_min(modality, (t_sec, seq)) as modality, arg_min(description, (t_sec, seq)) as d1, min(priority) as priority, max(t_sec + duration) as last, arg_min(duration, (t_sec, seq)) as dur1, arg_min(entity_id, (t_sec, seq)) as entity_id, max(confidence) as confidence, count(*) as n_merged from r group by timeline_id, run),
merged as (select g.timeline_id, seq, t_sec, modality, case when n_merged = 1 then d1 else names end as description, priority, case when n_merged = 1 then dur1 else last - t_sec end as duration, entity_id, confidence, n_merged from g join ds on g.timeline_id = ds.timeline_id and g.run = ds.run)"""


@query(f"with {RUNS} select * from merged")
def merge_runs(spark, sf_dir):
    return TL.merge_nearby(timeline(spark, sf_dir), DAY)


@query(f"with {TLS} select * from tl qualify row_number() over (partition by timeline_id, modality || ':' || lower(description)[1:50] order by t_sec, seq) = 1")
def dedup_first(spark, sf_dir):
    return TL.dedup_first(timeline(spark, sf_dir))


@query(f"""with {RUNS}, u as (select timeline_id, count(*) as n from (select timeline_id from merged qualify row_number() over (partition by timeline_id, modality || ':' || lower(description)[1:50] order by t_sec, seq) = 1) group by timeline_id),
b as (select timeline_id, count(*) as n from tl group by timeline_id) select b.timeline_id, b.n as n_before, u.n as n_after, b.n - u.n as n_removed from b join u on b.timeline_id = u.timeline_id""")
def merge_dedup_count(spark, sf_dir):
    return TL.removed_by_merge(timeline(spark, sf_dir), DAY)


@query(f"""with {TLS}, b as (select timeline_id, min(t_sec) as lo, max(t_sec + duration) as hi from tl group by timeline_id),
s as (select timeline_id, lo, unnest(range(0, ceil((hi - lo) / 86400)::bigint))::int as k from b where hi > lo),
p as (select tl.*, floor((t_sec - lo) / 86400)::int as k from tl join b on tl.timeline_id = b.timeline_id),
f as (select timeline_id, k, count(*) as c, string_agg({LINE}, chr(10) order by t_sec, seq) as summary from p group by timeline_id, k)
select s.timeline_id, s.k, lo + s.k * 86400.0::double as start_time, lo + s.k * 86400.0::double + 86400.0::double as end_time, coalesce(c, 0) as event_count, coalesce(summary, 'No events') as summary from s left join f on s.timeline_id = f.timeline_id and s.k = f.k""")
def segments(spark, sf_dir):
    return TL.segments(timeline(spark, sf_dir), DAY)


@query(f"with {TLS} select timeline_id, count(*) as total_events, count(distinct entity_id) as n_entities, min(t_sec) as first_t, max(t_sec + duration) as last_t, max(t_sec + duration) - min(t_sec) as duration from tl group by timeline_id")
def timeline_stats(spark, sf_dir):
    return TL.statistics(timeline(spark, sf_dir))


@query(f"with {TLS}, m as (select unnest(['click', 'error', 'purchase', 'signup', 'view', 'speech']) as modality) select m.modality, count(tl.seq) as n from m left join tl on m.modality = tl.modality group by m.modality")
def modality_counts(spark, sf_dir):
    return TL.modality_counts(timeline(spark, sf_dir), MODALITIES)


@query(f"with {TLS} select timeline_id, seq, least(count(*) over (partition by timeline_id order by t_sec range between 604800.0::double preceding and current row), 12) as n_context from tl")
def rolling_context(spark, sf_dir):
    return TL.rolling_context(timeline(spark, sf_dir), 7 * DAY, 12).select("timeline_id", "seq", "n_context")


@query(f"""with {TLS}, k as (select *, max(t_sec) over (partition by timeline_id) as m from tl) select timeline_id, seq, t_sec from k where t_sec >= m - 604800 qualify row_number() over (partition by timeline_id order by t_sec desc, seq desc) <= 12""")
def final_context(spark, sf_dir):
    return TL.final_context(timeline(spark, sf_dir), 7 * DAY, 12).select("timeline_id", "seq", "t_sec")


@query(f"with {TLS} select timeline_id, level, floor(t_sec / len)::bigint as bucket, count(*) as n, min(t_sec) as first_t, max(t_sec) as last_t from tl, (values ('day', 86400.0::double), ('week', 604800.0::double)) v(level, len) group by all")
def context_levels(spark, sf_dir):
    return sampling.hierarchy(timeline(spark, sf_dir), {"day": DAY, "week": 7 * DAY})


def states(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))) / 1e6).alias("t_sec"), F.floor(F.col("value") / 10).alias("bucket"), F.col("event_type").alias("kind"))


STS = "st as (select user_id as entity_id, event_id as seq, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t_sec, floor(value / 10)::bigint as bucket, event_type as kind from events)"


@query(f"with {STS}, l as (select *, lag(bucket) over (partition by entity_id order by t_sec, seq) as old_value from st) select entity_id, t_sec, old_value, bucket as new_value from l where bucket is distinct from old_value")
def attribute_changes(spark, sf_dir):
    return graph.attribute_changes(states(spark, sf_dir), "bucket")


@query(f"with {STS}, l as (select *, lag(kind) over (partition by entity_id order by t_sec, seq) as old_text from st where contains(kind, 'i')) select entity_id as timeline_id, seq as frame_idx, t_sec, kind as text, old_text from l where kind is distinct from old_text")
def text_changes(spark, sf_dir):
    return graph.text_changes(states(spark, sf_dir).select(F.col("entity_id").alias("timeline_id"), F.col("seq").alias("frame_idx"), F.lit(0).alias("det_no"), "t_sec", F.col("kind").alias("text")), "I")


@query(f"with {STS} select * from st qualify row_number() over (partition by entity_id order by t_sec desc, seq) = 1")
def latest_state(spark, sf_dir):
    return graph.latest_state(states(spark, sf_dir))


@query(f"with {STS}, q as (select distinct entity_id, 1000000.0::double * k as t_query, k as query_id from st, (values (0), (1), (2)) v(k)) select q.entity_id, query_id, t_query, seq, t_sec, bucket, kind from q join st on q.entity_id = st.entity_id qualify row_number() over (partition by q.entity_id, query_id order by abs(t_sec - t_query), seq) = 1")
def state_asof_nearest(spark, sf_dir):
    s = states(spark, sf_dir)
    q = s.select("entity_id").distinct().select("entity_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("query_id")).withColumn("t_query", F.col("query_id") * 1e6)
    return joins.nearest_state(q, s, "entity_id")


@query(f"with {STS} select * from st qualify row_number() over (partition by entity_id order by seq desc) <= 10")
def state_history_cap(spark, sf_dir):
    return graph.last_states(states(spark, sf_dir), 10)


@query(f"with {STS} select entity_id, arg_min(kind, (t_sec, seq)) as concept_label, arg_min(kind, (t_sec, seq)) as category, min(t_sec) as first_seen, max(t_sec) as last_seen, count(*) as n_states from st group by entity_id")
def kb_entities(spark, sf_dir):
    return graph.entities(states(spark, sf_dir).withColumn("concept_label", F.col("kind")).withColumn("category", F.col("kind")))


@query(f"""with {TLS}, c as (select timeline_id, t_sec, seq, description, modality from tl where modality in ('click', 'view')), e as (select timeline_id, t_sec, seq, description, modality from tl where modality in ('purchase', 'error'))
select c.timeline_id, c.t_sec as cause_t_sec, c.seq as cause_seq, c.description as cause_content, c.modality as cause_type, e.t_sec as effect_t_sec, e.seq as effect_seq, e.description as effect_content, e.modality as effect_type, e.t_sec - c.t_sec as time_delta
from c join e on c.timeline_id = e.timeline_id and e.t_sec > c.t_sec and e.t_sec - c.t_sec <= 86400""")
def causal_links(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("timeline_id", "t_sec", "seq", F.col("description").alias("content"), F.col("modality").alias("type"))
    return joins.causal_links(rows.where(F.col("type").isin("click", "view")), rows.where(F.col("type").isin("purchase", "error")), DAY).drop("formatted")


@query(f"""with {TLS}, q as (select timeline_id, seq as emb_id, t_sec as t_emb from tl where modality = 'error'), n as (select emb_id, t_sec, seq, description, row_number() over (partition by emb_id order by t_sec, seq) as n from q join tl on q.timeline_id = tl.timeline_id and abs(t_sec - t_emb) < 43200)
select q.emb_id, coalesce(string_agg(description, '; ' order by t_sec, n.seq) filter (where n <= 3), 'gameplay scene') as joined from q left join (select emb_id, t_sec, seq, description, n from n) n on q.emb_id = n.emb_id group by q.emb_id""")
def texts_near_embeddings(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    return joins.texts_near(tl.where("modality = 'error'").select("timeline_id", F.col("seq").alias("emb_id"), F.col("t_sec").alias("t_emb")), tl, DAY / 2)


@query(f"""with {TLS}, c as (select timeline_id, seq as clip_id, t_sec as s, t_sec + 86400 as e from tl where modality = 'purchase'), n as (select clip_id, t_sec, seq, description, row_number() over (partition by clip_id order by t_sec, seq) as n from c join tl on c.timeline_id = tl.timeline_id and t_sec between s and e)
select clip_id, string_agg(description, '; ' order by t_sec, seq) as joined from n where n <= 5 group by clip_id""")
def texts_within_clips(spark, sf_dir):
    tl = timeline(spark, sf_dir)
    return joins.texts_within(tl.where("modality = 'purchase'").select("timeline_id", F.col("seq").alias("clip_id"), F.col("t_sec").alias("start"), (F.col("t_sec") + DAY).alias("end")), tl, bucket=DAY)


def boxes(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = (k * 37) % 500, (k * 53) % 400
    return table(spark, sf_dir, "part").select(F.floor(k / 20).alias("frame_id"), k.alias("entity_id"), k.alias("rank"), G.box(x, y, x + 10 + k % 60, y + 10 + k % 45).alias("bbox"))


BOXES = """bx as (select p_partkey // 20 as frame_id, p_partkey as id, ((p_partkey * 37) % 500)::double as x1, ((p_partkey * 53) % 400)::double as y1, ((p_partkey * 37) % 500 + 10 + p_partkey % 60)::double as x2, ((p_partkey * 53) % 400 + 10 + p_partkey % 45)::double as y2 from part),
pr as (select a.frame_id, a.id as source_id, b.id as target_id, (b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 as dx, (b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2 as dy, least(a.x2, b.x2) - greatest(a.x1, b.x1) as w, least(a.y2, b.y2) - greatest(a.y1, b.y1) as h,
 (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab, a.x1 <= b.x1 and a.y1 <= b.y1 and a.x2 >= b.x2 and a.y2 >= b.y2 as inside from bx a join bx b on a.frame_id = b.frame_id and a.id < b.id)"""


@query(f"""with {BOXES} select frame_id, source_id, target_id, 'near' as relation_type, 0.8::double as confidence from pr where sqrt(dx * dx + dy * dy) < 50
union all select frame_id, source_id, target_id, case when abs(dx) > abs(dy) then case when dx > 0 then 'left_of' else 'right_of' end when dy > 0 then 'above' else 'below' end, 0.8 from pr
union all select frame_id, source_id, target_id, 'contains', 0.8 from pr where inside
union all select frame_id, source_id, target_id, 'collides_with', 0.9 from pr where w > 0 and h > 0 and w * h / (aa + ab - w * h) >= 0.3""")
def spatial_relations(spark, sf_dir):
    return graph.spatial_edges(boxes(spark, sf_dir))


def changes(spark, sf_dir):
    e = timeline(spark, sf_dir).where(F.col("modality").isin("view", "purchase"))
    return e.select(F.col("timeline_id").alias("source_id"), F.lit("item").alias("target_id"), F.lit("targets").alias("relation_type"), "t_sec", "seq", (F.col("modality") == "view").alias("is_start"))


#: An end that takes the balance of starts and ends to a new low below 0 closes nothing.
EDGES = f"""{TLS}, ch as (select timeline_id as source_id, 'item' as target_id, 'targets' as relation_type, t_sec, seq, modality = 'view' as is_start from tl where modality in ('view', 'purchase')),
bl as (select *, count(*) filter (where is_start) over w as s, count(*) filter (where not is_start) over w as e from ch window w as (partition by source_id order by t_sec, seq)),
lw as (select *, least(0, min(s - e) over (partition by source_id order by t_sec, seq)) as low from bl),
cl as (select *, low = coalesce(lag(low) over (partition by source_id order by t_sec, seq), 0) and not is_start as closes from lw),
ed as (select s.source_id, s.target_id, s.relation_type, s.s as k, s.seq, s.t_sec as start_time, e.t_sec as end_time from (select * from cl where is_start) s left join (select * from cl where closes) e on s.source_id = e.source_id and s.s = e.e + e.low)"""


def edges(spark, sf_dir):
    return joins.opened_and_closed(changes(spark, sf_dir))


@query(f"with {EDGES} select * from ed")
def interval_relationships(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"with {EDGES} select * from ed where end_time is null or end_time > 1000000")
def active_relationships(spark, sf_dir):
    return graph.active(edges(spark, sf_dir), 1e6)


@query(f"with {EDGES} select source_id as entity_id, count(*) as n_out, 0::bigint as n_in from ed group by 1 union all select target_id, 0, count(*) from ed group by 1")
def kb_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"with {EDGES}, x as (select source_id as entity_id, 'out' as direction, seq, relation_type || ' ' || target_id as line from ed union all select target_id, 'in', seq, source_id || ' ' || relation_type from ed) select entity_id, direction, line, row_number() over (partition by entity_id, direction order by seq)::int as k from x qualify k <= 5")
def relationship_summary(spark, sf_dir):
    return graph.relationship_summary(edges(spark, sf_dir))


@query(f"with {EDGES} select 'relation' as kind, relation_type as name, count(*) as n from ed group by 2 union all select 'active', relation_type, count(*) filter (where end_time is null) from ed group by 2 union all select 'category', kind, count(*) from (select arg_min(event_type, (ts, event_id)) as kind from events group by user_id) group by 2")
def kb_stats(spark, sf_dir):
    return graph.statistics(kb_entities(spark, sf_dir), edges(spark, sf_dir))


COS = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"


def cosine_sql(a: str, b: str) -> str:
    return f"round({COS.format(a=a, b=b)} / (sqrt({COS.format(a=a, b=a)}) * sqrt({COS.format(a=b, b=b)})), 6)"


@query(f"with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0), s as (select query_id, vec_id, {cosine_sql('q.e', 'x.embedding')} as similarity from q, embeddings x) select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank from s qualify rank <= 5")
def knn_region(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.similar_regions(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), e)


@query(f"select x.vec_id, {cosine_sql('q.embedding', 'x.embedding')} as similarity from embeddings x, (select embedding from embeddings where vec_id = 0) q order by similarity desc, vec_id limit 10")
def semantic_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.semantic_top(e, [float(v) for v in e.where("vec_id = 0").first()["embedding"]]).select("vec_id", "similarity")


@query(f"""with {TLS}, h as (select seq from tl where timeline_id = '7' and t_sec between 500000 and 1500000 and priority <> 3), s as (select x.vec_id as seq, {cosine_sql('q.embedding', 'x.embedding')} as similarity from embeddings x, (select embedding from embeddings where vec_id = 0) q order by 2 desc, 1 limit 5)
select seq, 0::int as part from h union all select seq, 1 from s where seq not in (select seq from h)""")
def hybrid_retrieve(spark, sf_dir):
    hits = retrieval.by_timestamp(timeline(spark, sf_dir).where("timeline_id = '7'"), 1e6, 5e5).select("seq")
    return retrieval.hybrid(hits, semantic_topk(spark, sf_dir).withColumnRenamed("vec_id", "seq")).select("seq", "part")


LOWER = "regexp_replace(regexp_replace(text, '^[\\s]+', ''), '[\\s]+$', '')"


@query(f"""with d as (select doc_id, {LOWER} as t from documents) select doc_id, case when t is null or t = '' then null when regexp_full_match(t, '[0-9]{{1,6}}') then 'damage' when contains(lower(t), 'hp') or contains(lower(t), 'health') or contains(t, '/') then 'health' when contains(lower(t), 'lv') or contains(lower(t), 'level') then 'level'
 when contains(t, ':') and regexp_matches(t, '[0-9]') then 'time' when contains(t, '$') or contains(t, 'gold') or contains(t, 'coins') then 'currency' else 'general' end as category from d""")
def ocr_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ocr_category(F.col("text")).alias("category"))


def _audio_sql() -> str:
    test = lambda ws: " or ".join(f"contains(lower(text), '{w}')" for w in ws)
    parts = [f"select doc_id, '{k}' as type, 0.8::double as confidence from documents where {test(ws)}" for k, ws in T.AUDIO_KEYWORDS.items()]
    every = " or ".join(test(ws) for ws in T.AUDIO_KEYWORDS.values())
    return " union all ".join([*parts, f"select doc_id, 'ambient', 0.5 from documents where not ({every}) and not contains(lower(text), 'silence')"])


@query(_audio_sql())
def audio_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.audio_types(F.col("text"))).alias("a")).select("doc_id", "a.type", "a.confidence")


@query("select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') then '{n.replace(chr(39), chr(39) * 2)}'" for p, n, _ in T.GAMES) + " end as game from conversations")
def game_detect(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.game_of(F.col("text"))["name"].alias("game"))


@query("select page_id, case " + " ".join("when " + " or ".join(f"contains(lower(url), '{w}')" for w in ws) + f" then '{n}'" for n, ws in T.SOURCES) + " else 'web' end as source from pages")
def source_of_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.source_of(F.col("url")).alias("source"))


# Questions and answers: phrases that the operators look for, each put before a turn of the conversations.
ASKED = ["at 5:30 what happened", "around 45 seconds", "1:05:30 boss fight", "what is it?", "and then he left", "that 5 items", "why?", "tell me more", "plain", "at 12.5s", ""]


def phrase(phrases: list[str], k) -> Column:
    return F.array(*[F.lit(p) for p in phrases])[F.pmod(k, F.lit(len(phrases))).cast("int")]


def phrase_sql(phrases: list[str], k: str) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + f"][({k}) % {len(phrases)} + 1]"


def asked(spark, sf_dir):
    """Every turn as a question; each second conversation asks the phrase alone."""
    q = phrase(ASKED, F.col("conv_id") + F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, q).otherwise(F.concat(q, F.lit(" "), F.col("text"))).alias("q"), "text")


ASKED_SQL = f"(select conv_id, turn, case when conv_id % 2 = 0 then {phrase_sql(ASKED, 'conv_id + turn')} else {phrase_sql(ASKED, 'conv_id + turn')} || ' ' || text end as q, text from conversations)"
SECONDS_SQL = r"""case when regexp_matches(lower(q), '\d{1,2}:\d{2}:\d{2}') then regexp_extract(q, '(\d{1,2}):(\d{2}):(\d{2})', 1)::double * 3600 + regexp_extract(q, '(\d{1,2}):(\d{2}):(\d{2})', 2)::double * 60 + regexp_extract(q, '(\d{1,2}):(\d{2}):(\d{2})', 3)::double
 when regexp_matches(q, '\d{1,2}:\d{2}') then regexp_extract(q, '(\d{1,2}):(\d{2})', 1)::double * 60 + regexp_extract(q, '(\d{1,2}):(\d{2})', 2)::double when regexp_matches(lower(q), 'at\s+\d') then regexp_extract(lower(q), 'at\s+(\d+(?:\.\d+)?)', 1)::double when regexp_matches(lower(q), 'around\s+\d') then regexp_extract(lower(q), 'around\s+(\d+(?:\.\d+)?)', 1)::double end"""


@query(f"select conv_id, turn, {SECONDS_SQL} as t_sec from {ASKED_SQL}")
def parse_query_time(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", T.query_seconds(F.col("q")).alias("t_sec"))


# Letters beyond ASCII are letters to the operators' word borders, and not to this engine's.
@query(rf"""with a as (select conv_id, turn, trim(regexp_replace(lower(q), '[^\x00-\x7F]', 'x', 'g'), ' ' || chr(9) || chr(10) || chr(13)) as q from {ASKED_SQL})
select conv_id, turn, regexp_matches(q, '\bwhat happened next\b|\bwhat about\b|\band then\b|\bafter that\b|\bbefore that\b|\bwhy did (he|she|they|it|the player)\b|\bwhat did (he|she|they|it|the player) do\b|\bcan you explain more\b')
 or regexp_matches(q, '\btell me more\b|\bwhat else\b|\bhow did that happen\b|\bwhy\?$|^why\b|^how\b|^what\b.*\bthat\b|\bthe same\b|\bit\b.*\?$') as follow_up from a""")
def follow_up(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", T.is_follow_up(F.col("q")).alias("follow_up"))


@query(f"""select conv_id, turn, round(least(1.0, greatest(0.0, case when turn >= 3 then 0.3 else turn * 0.1 end + case when length(text) > 50 then case when contains(lower(text), 'because') then 0.15 else 0.1 end else 0.05 end + case when ({SECONDS_SQL}) is null then 0.15 else 0.05 end)), 6)::double as score from {ASKED_SQL}""")
def confidence(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.round(T.confidence(F.col("turn"), F.col("q"), F.col("text")), 6).alias("score"))


RESPONSES = ["B. because", "b", "The ANSWER: (C)", "OPTION D", "yes, there is a glitch", "no visible glitch", "I know it is normal", "it is not clearly a glitch", "true", "", "two\nlines", "red", "**Answer:** some bug here", "**Answer:** normal", "Yes", "no", "correct", "a physics error without doubt", "0", "nothing wrong", "an issue, not fine"]
TRUTHS = ["B", "yes", "c", "no", "two", "true", "glitch", "normal", "red"]
OPTIONS = ["blue", "red", "green", "grey"]


def answers(spark, sf_dir):
    """Every turn as a response: each third is the phrase alone, the others go on with the turn's text; each second has options."""
    k = F.col("conv_id") * 7 + F.col("turn")
    r = phrase(RESPONSES, k)
    options = F.when(F.pmod(F.col("turn"), F.lit(2)) == 0, F.array(*[F.lit(o) for o in OPTIONS])).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.pmod(F.col("conv_id"), F.lit(3)) == 0, r).otherwise(F.concat(r, F.lit(" "), F.col("text"))).alias("response"), phrase(TRUTHS, F.col("conv_id") + F.col("turn") * 3).alias("truth"), options.alias("options"))


def listed(words: str, of: str) -> str:
    """Whether any of the words, given between semicolons, is in the text."""
    return "(" + " or ".join(f"contains({of}, '{w.strip()}')" for w in words.replace("'", "''").split(";")) + ")"


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ANSWERS_SQL = f"""an as (select conv_id, turn, case when conv_id % 3 = 0 then '' else ' ' || text end as tail, {phrase_sql(RESPONSES, 'conv_id * 7 + turn')} as head, {phrase_sql(TRUTHS, 'conv_id + turn * 3')} as truth, turn % 2 = 0 as has from conversations),
ap as (select conv_id, turn, truth, has, head || tail as response, trim(head || tail, {BLANK}) as r, lower(trim(head || tail, {BLANK})) as low, regexp_replace(upper(trim(head || tail, {BLANK})), '[^\\x00-\\x7F]', 'X', 'g') as up from an)"""
DENIED = listed("no glitch;no visible glitch;is not a glitch;isn't a glitch;normal gameplay;this is normal;nothing unusual;no clear indication;no indication of a glitch;not a glitch;no specific glitch;no obvious glitch;appears normal;no anomalies;looks normal;nothing abnormal;no visual evidence;no signs of;no physics error;no clipping", "low")
AFFIRMED = "there is a glitch;yes, there is;is a glitch;glitch detected;appears to be a glitch;clearly a glitch;this is a glitch;visible glitch;glitch in this;glitch can be seen;glitch is present;physics error;clipping error;texture error;animation bug".split(";")
NEGATED = r"\b(no|not|isn''t|aren''t|wasn''t|weren''t|don''t|doesn''t|didn''t|without|lacks?|absence)\b"
AFFIRMED_SQL = " ".join(
    f"when contains(low, '{p}') then case when len(list_filter(range(1, len(string_split(low, '{p}'))), lambda i: regexp_matches(right(array_to_string(string_split(low, '{p}')[1:i], '{p}'), 30), '{NEGATED}'))) > 0 then 'no' else 'yes' end"
    for p in AFFIRMED
)
SECTION = r"regexp_extract(low, '\*\*answer[:\s]*\*\*\s*([^\n]+)', 1)"
FIRST_LINE = "left(string_split(r, chr(10))[1], 200)"


@query(f"""with {ANSWERS_SQL} select conv_id, turn, case when response = '' then '' else coalesce(
    case when has then coalesce(nullif(regexp_extract(up, '^([A-D])\\b', 1), ''), nullif(regexp_extract(up, '[(\\[]([A-D])[)\\]]', 1), ''), case when contains(low, 'blue') then 'A' when contains(low, 'red') then 'B' when contains(low, 'green') then 'C' when contains(low, 'grey') then 'D' end) end,
    case when contains(low, 'yes') or contains(low, 'true') then 'yes' when contains(low, 'no') or contains(low, 'false') then 'no' else {FIRST_LINE} end) end as parsed,
case when response = '' then '' when has and regexp_matches(up, '^[A-D]\\b') then left(up, 1) when {DENIED} then 'no' {AFFIRMED_SQL} when starts_with(low, 'yes') then 'yes' when starts_with(low, 'no') then 'no'
    when {listed('yes;glitch;bug', SECTION)} then 'yes' when {listed('no;normal', SECTION)} then 'no' else {FIRST_LINE} end as glitch from ap""")
def answer_parse(spark, sf_dir):
    r, o = F.col("response"), F.col("options")
    return answers(spark, sf_dir).select("conv_id", "turn", T.parsed_answer(r, o).alias("parsed"), T.glitch_answer(r, o).alias("glitch"))


@query(f"""with {ANSWERS_SQL} select conv_id, turn, low = lower(truth) or (left(low, 1) in ('a', 'b', 'c', 'd') and left(lower(truth), 1) in ('a', 'b', 'c', 'd') and left(low, 1) = left(lower(truth), 1))
 or (not (left(low, 1) in ('a', 'b', 'c', 'd') and left(lower(truth), 1) in ('a', 'b', 'c', 'd')) and (low in ('yes', 'true', '1', 'correct') and lower(truth) in ('yes', 'true', '1', 'correct') or low in ('no', 'false', '0', 'incorrect') and lower(truth) in ('no', 'false', '0', 'incorrect'))) as phase2, low = lower(truth) as exact from ap""")
def score_answers(spark, sf_dir):
    r, t = F.col("response"), F.col("truth")
    return answers(spark, sf_dir).select("conv_id", "turn", T.correct_letters(r, t).alias("phase2"), T.correct_exact(r, t).alias("exact"))


@query(f"""with {ANSWERS_SQL}, k as (select *, lower(truth) as t, {listed('yes;glitch;bug;error;anomaly;issue;problem', 'low')} as pro, {listed('no;normal;correct;fine;nothing wrong', 'low')} and not contains(left(low, 50), 'not') as con from ap)
select conv_id, turn, low = t or (pro and not con and t in ('yes', 'true', '1', 'glitch', 'a')) or (con and not pro and t in ('no', 'false', '0', 'normal', 'b')) or (has and left(low, 1) in ('a', 'b', 'c', 'd') and left(low, 1) = left(t, 1)) as phase1,
 low = t or (left(low, 1) between 'a' and 'h' and left(t, 1) between 'a' and 'h' and left(low, 1) = left(t, 1)) as phase3 from k""")
def score_keywords(spark, sf_dir):
    r, t, o = F.col("response"), F.col("truth"), F.col("options")
    return answers(spark, sf_dir).select("conv_id", "turn", T.correct_keywords(r, t, o).alias("phase1"), T.correct_letters(r, t, "abcdefgh", variants=False).alias("phase3"))


def metrics(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderstatus").alias("model_config"), F.col("c_nationkey").cast("string").alias("benchmark"), F.col("o_orderpriority").alias("task_type"), (k % 3 == 0).alias("correct"), (k % 256).cast("int").alias("num_frames"), (1024 + k % 777).cast("int").alias("total_tokens"), (1000 + k % 701).cast("int").alias("input_tokens"), (k % 77).cast("int").alias("output_tokens"), (k % 500).cast("double").alias("perception_time"), (k % 90).cast("double").alias("retrieval_time"), (k % 333).cast("double").alias("generation_time"),
        (k % 1000 / 100).alias("total_time"), (F.col("o_custkey") % 45).cast("double").alias("peak_vram_gb"), ((k * 37) % 5400).cast("double").alias("video_duration_sec"),
    )


METRICS = "mt as (select o_orderstatus as model_config, c_nationkey::varchar as benchmark, o_orderpriority as task_type, o_orderkey % 3 = 0 as correct, (o_orderkey % 256)::int as num_frames, (1024 + o_orderkey % 777)::int as total_tokens, (1000 + o_orderkey % 701)::int as input_tokens, (o_orderkey % 77)::int as output_tokens, (o_orderkey % 500)::double as perception_time, (o_orderkey % 90)::double as retrieval_time, (o_orderkey % 333)::double as generation_time, (o_orderkey % 1000) / 100 as total_time, (o_custkey % 45)::double as peak_vram_gb, ((o_orderkey * 37) % 5400)::double as video_duration_sec from orders join customer on o_custkey = c_custkey)"


@query(f"with {METRICS} select model_config, benchmark, task_type, grouping(task_type)::int as is_total, count(*) as total, count(*) filter (where correct) as n_correct, round(avg(correct::int), 6) as accuracy, round(avg(num_frames), 6) as avg_num_frames, round(avg(input_tokens), 6) as avg_input_tokens, round(avg(output_tokens), 6) as avg_output_tokens, round(avg(total_tokens), 6) as avg_total_tokens, round(avg(perception_time), 6) as avg_perception_time, round(avg(retrieval_time), 6) as avg_retrieval_time, round(avg(generation_time), 6) as avg_generation_time, round(avg(total_time), 6) as avg_total_time, max(peak_vram_gb) as max_vram, round(sum(total_time), 4) as sum_time from mt group by grouping sets ((model_config, benchmark), (model_config, benchmark, task_type))")
def metrics_by_config(spark, sf_dir):
    return evaluation.aggregates(metrics(spark, sf_dir))


@query(f"with {METRICS} select benchmark, round(avg(correct::int) filter (where model_config = 'F'), 6) as \"F\", round(avg(correct::int) filter (where model_config = 'O'), 6) as \"O\", round(avg(correct::int) filter (where model_config = 'P'), 6) as \"P\" from mt group by benchmark")
def config_compare(spark, sf_dir):
    return evaluation.comparison(metrics(spark, sf_dir), ["F", "O", "P"])


@query(f"with {METRICS} select model_config, case when video_duration_sec >= 3600 then 4 when video_duration_sec >= 1800 then 3 when video_duration_sec >= 600 then 2 when video_duration_sec >= 300 then 1 else 0 end::int as bucket, count(*) as total, round(avg(correct::int), 6) as accuracy, round(avg(total_tokens), 6) as avg_tokens, round(avg(total_time), 6) as avg_time from mt group by 1, 2")
def duration_buckets(spark, sf_dir):
    return evaluation.duration_buckets(metrics(spark, sf_dir))


@query(f"with {METRICS} select task_type as category, grouping(task_type)::int as is_total, count(*) as total, count(*) filter (where correct) as n_correct, round(avg(correct::int), 6) as accuracy, round(avg(total_time), 6) as avg_latency, count(*) filter (where not correct) as n_errors from mt group by grouping sets ((), (task_type))")
def run_totals(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return evaluation.run_totals(m.select(F.col("task_type").alias("category"), "correct", F.col("total_time").alias("latency_sec"), F.when(~F.col("correct"), "wrong").alias("error")))


def samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("category"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") * 37 % 5400).cast("double")).alias("duration"))


SAMPLES = "sm as (select o_orderkey as sample_id, o_orderpriority as task, o_orderstatus as category, case when o_orderkey % 7 <> 0 then (o_orderkey * 37 % 5400)::double end as duration from orders)"


@query(f"with {SAMPLES} select count(*) as total, count(distinct task) as n_tasks, count(distinct category) as n_categories, round(avg(nullif(duration, 0)), 6) as avg_duration, min(nullif(duration, 0)) as min_duration, max(nullif(duration, 0)) as max_duration from sm")
def loader_stats(spark, sf_dir):
    return evaluation.loader_statistics(samples(spark, sf_dir))


@query(f"with {SAMPLES} select * from sm where task in ('1-URGENT', '2-HIGH') and category in ('F', 'O') and (duration is null or duration between 300 and 1800)")
def sample_filter(spark, sf_dir):
    return evaluation.filtered(samples(spark, sf_dir), ["1-URGENT", "2-HIGH"], ["F", "O"], 300, 1800)


@query(f"with {SAMPLES} select * from sm where coalesce(duration, 0) >= 600 and coalesce(duration, 0) <= 5000")
def sample_filter_known(spark, sf_dir):
    return evaluation.filtered(samples(spark, sf_dir), least=600, most=5000, keep_unknown=False)


@query(f"with {SAMPLES} select sample_id, least(floor(coalesce(duration, 0) * 4), 256)::bigint as frames, (1024 + least(floor(coalesce(duration, 0) * 4), 256) * 32)::bigint as input_tokens, round(0.1::double + coalesce(duration, 0) / 60 * 0.05::double, 9) as retrieval_time from sm")
def modelled_tokens(spark, sf_dir):
    frames, tokens, time = evaluation.modelled_tokens("duration")
    out = samples(spark, sf_dir).select("sample_id", frames, tokens, time)
    return out.withColumn("retrieval_time", F.round("retrieval_time", 9))


@query("with r as (select *, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n from conversations) select conv_id, count(*) as n_turns, least(count(*), 4) as n_kept, coalesce(string_agg(text[1:100], ' | ' order by turn) filter (where k <= n - 4), '') as summary from r group by conv_id")
def chat_window_summary(spark, sf_dir):
    return chat.window_summary(table(spark, sf_dir, "conversations"), 4)


@query("select conv_id, count(*) as n_turns, (arg_max(text, turn) filter (where role = 'user'))[1:100] as last_query, (arg_max(text, turn) filter (where role = 'assistant'))[1:100] as last_response from conversations group by conv_id")
def chat_last(spark, sf_dir):
    return chat.last_words(table(spark, sf_dir, "conversations")).drop("last_time")


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4")
def chat_recent(spark, sf_dir):
    return chat.recent(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query("select conv_id, turn, chars::bigint as chars from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as chars from conversations) where chars <= 2000")
def budgeted_context(spark, sf_dir):
    return TL.budgeted(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", 2000).select("conv_id", "turn", "chars")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def uncached_documents(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select item_id, text || chr(10) || 'A) yes' || chr(10) || 'B) no' || chr(10) || 'C) maybe' as prompt from benchmark")
def mcq_prompt(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.prompt(F.col("text"), F.array(F.lit("yes"), F.lit("no"), F.lit("maybe"))).alias("prompt"))


def called(spark, sf_dir):
    """Every turn with one call, another tool's call, two calls, a call over lines, or none."""
    call = lambda name, quote: F.concat(F.lit(f"<tool_call>{name}({quote}"), F.lit("turn "), F.col("conv_id").cast("string"), F.lit(f"{quote})</tool_call>"))
    known, other, text = call("search_game_knowledge", '"'), call("other", "'"), F.col("text")
    lines = F.concat(F.lit("<Tool_Call>\n search_game_knowledge ( 'a\nb' )\n</Tool_Call>"))
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    t = F.when(k == 0, F.concat(known, text)).when(k == 1, F.concat(text, other)).when(k == 2, F.concat(known, text, known)).when(k == 3, F.concat(text, lines)).otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))


@query(f"""select conv_id, turn, case (conv_id + turn) % 5 when 0 then 'turn ' || conv_id when 2 then 'turn ' || conv_id || ',turn ' || conv_id when 3 then 'a' || chr(10) || 'b' else '' end as calls, trim(text, {BLANK}) as rest from conversations""")
def tool_calls(spark, sf_dir):
    return called(spark, sf_dir).select("conv_id", "turn", F.array_join(T.tool_calls(F.col("t")), ",").alias("calls"), T.without_tool_calls(F.col("t")).alias("rest"))


@query("with m as (select item_id as media_id, length(text)::double as duration from benchmark) select media_id, k::int as k, k * 3.5::double as start, least(k * 3.5::double + 4, duration) as \"end\" from m, unnest(range(0, (floor((duration - 2) / 3.5) + 1)::bigint)) t(k) where duration >= 2")
def clip_windows(spark, sf_dir):
    return sampling.clips(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("media_id"), F.length("text").cast("double").alias("duration")))


@query("with m as (select item_id as media_id, length(text)::double as duration from benchmark) select media_id, k::int as k, k * 29.5::double as start, least(k * 29.5::double + 30, duration) as \"end\" from m, unnest(range(0, greatest(ceil(duration / 29.5), 1)::bigint)) t(k)")
def audio_chunks(spark, sf_dir):
    return sampling.audio_chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("media_id"), F.length("text").cast("double").alias("duration")))


@query("with l as (select event_id, user_id, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as d from events) select event_id as seq, case when d > 30 then 'high_action' when d > 15 then 'moderate' when d > 5 then 'low' else 'static' end as motion_type from l")
def motion_classes(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumnRenamed("duration", "value")
    return sampling.motion(rows).select("seq", "motion_type")


@query("with e as (select user_id, event_id, event_type from events), p as (select user_id, event_type, count(*) as c, min(event_id) as s from e group by 1, 2) select user_id, event_type as dominant from p qualify row_number() over (partition by user_id order by c desc, s) = 1")
def dominant_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("transcript"))
    return evaluation.dominant_type(e, "user_id")


@query("with x as (select user_id, event_id, event_type, value from events) select user_id as frame_id, event_type as label, concept, value as confidence from (select x.*, c.concept, row_number() over (partition by user_id order by event_id, c.k) as n from x join (values (0, 'pur'), (1, 'err')) c(k, concept) on contains(event_type, concept) where value >= 20) where n = 1")
def concept_hits(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("frame_id"), F.col("event_id").alias("det_no"), F.col("event_type").alias("label"), F.col("value").alias("confidence"))
    return joins.keyword_hits(d, "label", ["pur", "err"], 20.0)


def detections(spark, sf_dir):
    e = F.col("event_id")
    x, y = (e * 37 % 500).cast("double"), (e * 53 % 400).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("timeline_id"), F.floor(e / 50).alias("frame_idx"), (F.floor(e / 50) / 2.0).alias("t_sec"), (e % 50).cast("int").alias("det_no"), F.col("event_type").alias("entity_type"), F.col("event_type").alias("label"), x.alias("x1"), y.alias("y1"), (x + 250).alias("x2"), (y + 200).alias("y2"), F.col("value").alias("confidence"))


DETS = """det as (select user_id::varchar as timeline_id, event_id // 50 as frame_idx, (event_id // 50) / 2.0::double as t_sec, (event_id % 50)::int as det_no, event_type as kind, value as confidence,
    (event_id * 37 % 500)::double as x1, (event_id * 53 % 400)::double as y1, (event_id * 37 % 500)::double + 250 as x2, (event_id * 53 % 400)::double + 200 as y2, row_number() over (partition by user_id, event_type order by event_id) as k from events)"""


def matched_sql(may: str, first: int) -> str:
    """A detection at a time, of each timeline and kind: ``number`` of the live box e that it overlaps most, or the next one."""
    w, h = "(least(d.x2, e.x2) - greatest(d.x1, e.x1))", "(least(d.y2, e.y2) - greatest(d.y1, e.y1))"
    over = f"(case when {w} > 0 and {h} > 0 then {w} * {h} / ((d.x2 - d.x1) * (d.y2 - d.y1) + (e.x2 - e.x1) * (e.y2 - e.y1) - {w} * {h}) else 0 end)"
    hit = f"list_sort(list_transform(list_filter(r.live, lambda e: {may} and {over} > 0.3), lambda e: {{'o': -{over}, 'id': e.id}}))[1].id"
    box = "{'id': coalesce(hit, n)::int, 'f': frame_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
    return f"""r as (select distinct timeline_id, kind, 0::bigint as k, null::int as number, {first}::int as n, []::struct(id int, f bigint, x1 double, y1 double, x2 double, y2 double)[] as live from det
    union all select timeline_id, kind, k, coalesce(hit, n)::int, (n + (hit is null)::int)::int, list_append(list_filter(live, lambda e: e.id <> coalesce(hit, n) and frame_idx - e.f <= 40), {box})
    from (select d.timeline_id, d.kind, d.k, d.frame_idx, d.x1, d.y1, d.x2, d.y2, r.n, r.live, {hit} as hit from r join det d on d.timeline_id = r.timeline_id and d.kind = r.kind and d.k = r.k + 1))"""


@query(f"""with recursive {DETS}, {matched_sql("e.f < d.frame_idx and d.frame_idx - e.f <= 11", 1)}
select d.timeline_id, d.frame_idx, d.t_sec, d.det_no, d.kind as entity_type, printf('%s_%03d', d.kind, r.number) as entity_id, d.confidence from det d join r on d.timeline_id = r.timeline_id and d.kind = r.kind and d.k = r.k""")
def track_entities(spark, sf_dir):
    return stateful.track(detections(spark, sf_dir), every_frame=True)


@query(f"""with recursive {DETS}, {matched_sql("d.frame_idx - e.f <= 30", 0)},
seen as (select distinct d.timeline_id, printf('%s_%03d', d.kind, r.number) as entity_id, d.frame_idx from det d join r on d.timeline_id = r.timeline_id and d.kind = r.kind and d.k = r.k),
fr as (select distinct timeline_id, frame_idx from det), s as (select *, lead(frame_idx) over w as again, lag(frame_idx) over w as before from seen window w as (partition by timeline_id, entity_id order by frame_idx)),
g as (select s.timeline_id, s.entity_id, s.frame_idx as since, f.frame_idx, case when f.frame_idx - since <= 10 then 'occluded' when f.frame_idx - since <= 30 then 'lost' else 'terminated' end as state
    from s join fr f on f.timeline_id = s.timeline_id and f.frame_idx > s.frame_idx and (again is null or f.frame_idx < again)),
c as (select *, lag(state) over (partition by timeline_id, entity_id, since order by frame_idx) as was from g)
select timeline_id, frame_idx, entity_id, state from c where state is distinct from was
union all select timeline_id, frame_idx, entity_id, 'active' from s where before is null or exists (select 1 from fr f where f.timeline_id = s.timeline_id and f.frame_idx > s.before and f.frame_idx < s.frame_idx)""")
def entity_lifecycle(spark, sf_dir):
    return stateful.lifecycle(detections(spark, sf_dir))


@query(f"""with recursive {TLS}, c as (select timeline_id, t_sec, seq from tl where modality in ('error', 'purchase')),
f as (select timeline_id, min((t_sec, seq)) as p from c where t_sec >= 86400 group by timeline_id union all select f.timeline_id, (select min((c.t_sec, c.seq)) from c where c.timeline_id = f.timeline_id and c.t_sec - f.p[1] >= 86400) from f where f.p is not null)
select timeline_id, p[1] as t_sec, p[2]::bigint as seq from f where p is not null""")
def trigger_cooldown(spark, sf_dir):
    c = timeline(spark, sf_dir).where(F.col("modality").isin("error", "purchase")).select("timeline_id", "t_sec", "seq", F.lit("visual").alias("source"))
    return stateful.triggers(c, DAY).select("timeline_id", "t_sec", "seq")


from tidemark.plans import media, more, streams  # noqa: E402, F401  (these register further queries)
