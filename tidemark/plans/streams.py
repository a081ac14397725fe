"""Queries of the operators that streams share, and of the streams themselves, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import answering, caches
from tidemark.operators import timeline as TL
from tidemark.plans.driver import DAY, ORACLES, TLS, boxes, query, table, timeline
from tidemark.storage import new_path
from tidemark.streaming import in_order, timelines
from tidemark.streaming.knowledge import Knowledge


MOMENTS = f"""{TLS}, a as (select timeline_id, t_sec, seq, description as label, case modality when 'view' then 'context' when 'signup' then 'question' when 'error' then 'visual' when 'purchase' then 'audio' when 'click' then case when duration > 40 then 'force' else 'other' end end as kind from tl),
c as (select timeline_id, t_sec, seq, case kind when 'visual' then 0 else 1 end as rank from a where kind in ('visual', 'audio')),
f as (select timeline_id, min((t_sec, rank, seq)) as p from c where t_sec >= 86400 group by timeline_id
    union all select f.timeline_id, (select min((c.t_sec, c.rank, c.seq)) from c where c.timeline_id = f.timeline_id and c.t_sec - f.p[1] >= 86400) from f where f.p is not null),
fired as (select timeline_id, p[1] as t_sec, p[3]::bigint as seq from f where p is not null),
forced as (select timeline_id, t_sec, min(seq) as seq from a where kind = 'force' and not exists (select 1 from fired x where x.timeline_id = a.timeline_id and x.t_sec = a.t_sec) group by timeline_id, t_sec),
ans as (select a.* from a join (select * from fired union all select * from forced) x on a.timeline_id = x.timeline_id and a.t_sec = x.t_sec and a.seq = x.seq),
o as (select *, lag(t_sec) over (partition by timeline_id order by t_sec, seq) as prev from ans),
q as (select o.timeline_id, o.seq, arg_max(a.label, (a.t_sec, a.seq)) as left_open from o join a on a.kind = 'question' and a.timeline_id = o.timeline_id and a.t_sec <= o.t_sec and (prev is null or a.t_sec > prev) group by o.timeline_id, o.seq),
n as (select o.timeline_id, o.seq, max(a.t_sec) as newest from o join a on a.kind = 'context' and a.timeline_id = o.timeline_id and a.t_sec <= o.t_sec group by o.timeline_id, o.seq),
m as (select n.timeline_id, n.seq, least(count(*), 12) as n_context, newest - list_sort(list(a.t_sec), 'DESC')[least(count(*), 12)] as span from n join a on a.kind = 'context' and a.timeline_id = n.timeline_id and a.t_sec >= newest - 604800 and a.t_sec <= newest group by n.timeline_id, n.seq, newest)"""


def moments(rows):
    kind = (
        F.when(F.col("modality") == "view", "context").when(F.col("modality") == "signup", "question").when(F.col("modality") == "error", "visual").when(F.col("modality") == "purchase", "audio")
        .when(F.col("modality") == "click", F.when(F.col("duration") > 40, "force").otherwise("other"))
    )
    return rows.select("timeline_id", "t_sec", "seq", kind.alias("kind"), F.col("description").alias("label"))


@query(f"""with recursive {MOMENTS} select o.timeline_id, o.t_sec, o.seq, o.kind, o.label, coalesce(nullif(left_open, ''), case o.kind when 'force' then 'Describe what''s happening in this frame.'
    when 'visual' then 'A ' || o.label || ' was just detected. Describe what''s happening with it.' else 'An audio event ''' || o.label || ''' was detected. What''s happening?' end) as question, coalesce(n_context, 0) as n_context, span
from o left join q on q.timeline_id = o.timeline_id and q.seq = o.seq left join m on m.timeline_id = o.timeline_id and m.seq = o.seq""")
def asked_moments(spark, sf_dir):
    return answering.asked(moments(timeline(spark, sf_dir)), DAY, 7 * DAY, 12)


@query("""with recursive k as (select user_id::varchar as timeline_id, event_id as seq, event_type || '-' || floor(value / 20)::bigint as key, row_number() over (partition by user_id order by event_id) as n from events),
r as (select distinct timeline_id, 0::bigint as n, null::bigint as seq, null::varchar as key, false as hit, []::varchar[] as held from k
    union all select k.timeline_id, k.n, k.seq, k.key, list_contains(held, k.key), case when list_contains(held, k.key) then held when len(held) >= 5 then list_append(held[2:], k.key) else list_append(held, k.key) end
    from r join k on k.timeline_id = r.timeline_id and k.n = r.n + 1)
select timeline_id, seq, key, hit from r where n > 0""")
def frame_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").cast("string").alias("timeline_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit("-"), F.floor(F.col("value") / 20).cast("string")).alias("key"))
    return caches.lookups(frames, 5)


@query(f"""with {TLS}, k as (select *, max(t_sec) over (partition by timeline_id) as m from tl), c as (select timeline_id, seq, t_sec from k where t_sec >= m - 604800 qualify row_number() over (partition by timeline_id order by t_sec desc, seq desc) <= 12)
select timeline_id, max(t_sec) as newest, count(*)::int as n_context, string_agg(seq::varchar, ',' order by t_sec, seq) as seqs from c group by timeline_id""")
def streamed_context(spark, sf_dir):
    """The events as a stream, a file a micro-batch; of each timeline the context after its last one."""
    path = new_path(spark, "context")
    schema = table(spark, sf_dir, "events").schema
    rows = TL.events_timeline(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]"))
    timed = timelines.with_watermark(rows.withColumn("ts", F.timestamp_micros((F.col("t_sec") * 1_000_000 + 10**12).cast("long"))), "1000 days")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    writer = in_order.context(timed, 7 * DAY, 12).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    stream = in_order.started(writer, spark)
    stream.awaitTermination()
    out = spark.read.schema("timeline_id string, newest double, n_context int, seqs array<bigint>, batch int").option("recursiveFileLookup", True).parquet(f"{path}/rows")
    return out.groupBy("timeline_id").agg(F.max_by(F.struct("newest", "n_context", F.array_join("seqs", ",").alias("seqs")), "batch").alias("c")).select("timeline_id", "c.*")


@query(f"""with e0 as ({ORACLES["spatial_relations"]}), e as (select 'e' || source_id % 20 as source_id, 'e' || target_id % 20 as target_id, relation_type, frame_id::double as t from e0),
l as (select *, case when t - lag(t) over (partition by source_id, target_id, relation_type order by t) <= 1 then 0 else 1 end as s from e), k as (select *, sum(s) over (partition by source_id, target_id, relation_type order by t) as k from l)
select source_id, target_id, relation_type, min(t) as start_time, max(t) as end_time, count(*) as frames from k group by source_id, target_id, relation_type, k""")
def grown_relations(spark, sf_dir):
    """The frames' boxes in three batches that split every frame; what holds in consecutive frames."""
    knowledge = Knowledge(spark, new_path(spark, "knowledge"))
    place = F.pmod(F.col("entity_id"), F.lit(20))
    rows = boxes(spark, sf_dir).withColumn("place", place).select("frame_id", F.col("frame_id").cast("double").alias("t_sec"), F.concat(F.lit("e"), "place").alias("entity_id"), F.lit("box").alias("concept_label"), F.col("place").alias("rank"), "bbox")
    for number in range(3):
        knowledge.update(rows.where(F.pmod(F.xxhash64("frame_id", "entity_id"), F.lit(3)) == number), number)
    knowledge.compact()
    knowledge.clean()
    return knowledge.intervals()
