"""Joins on time: bands, intervals, nearest states, opened and closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ordered


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, before: float, after: float, strict: tuple[bool, bool] = (False, False), how: str = "inner") -> DataFrame:
    """Rows with -before <= right_t - left_t <= after (strict ends exclude) and equal keys.

    Time is cut into buckets as long as the band. A left row goes to the buckets that its band touches, a right row to its own, so that it is an equality join whose partitions are as small as a bucket, and no pair meets twice. ``how`` is inner or left.
    """
    size = float(before + after) or 1.0
    lo, hi = F.col(left_t) - before, F.col(left_t) + after
    a = left.withColumn("__b", F.explode(F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))))
    b = right.withColumn("__b", F.floor(F.col(right_t) / size).cast("bigint"))
    d = F.col(right_t) - F.col(left_t)
    inside = (d > -before if strict[0] else d >= -before) & (d < after if strict[1] else d <= after)
    pairs = a.join(b, [*keys, "__b"]).where(inside).drop("__b")
    if how == "inner":
        return pairs
    # A left row that no bucket joins stays once, without a right side.
    row = F.struct(*left.columns)
    alone = left.withColumn("__row", row).join(pairs.select(row.alias("__row")).distinct(), "__row", "left_anti").drop("__row")
    return pairs.unionByName(alone, allowMissingColumns=True)


def causal_links(causes: DataFrame, effects: DataFrame, window: float = 5.0) -> DataFrame:
    """Each cause with each effect that follows it within ``window`` seconds; (timeline_id, t_sec, seq, content, type) on both sides."""
    names = ("t_sec", "seq", "content", "type")
    a = causes.select("timeline_id", *[F.col(c).alias(f"cause_{c}") for c in names])
    b = effects.select("timeline_id", *[F.col(c).alias(f"effect_{c}") for c in names])
    out = band_join(a, b, ["timeline_id"], "cause_t_sec", "effect_t_sec", 0.0, window, strict=(True, False))
    line = F.format_string("[%.1fs] %s... → [%.1fs] %s...", "cause_t_sec", F.substring("cause_content", 1, 50), "effect_t_sec", F.substring("effect_content", 1, 50))
    return out.withColumn("time_delta", F.col("effect_t_sec") - F.col("cause_t_sec")).withColumn("formatted", line)


def classified(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(causes, effects) of a timeline by the words of its text; a text of several classes gives a row for each."""
    low = F.lower("description")
    kinds = F.array_compact(F.array(
        F.when((F.col("modality") == "ocr") & T.any_of(low, T.ATTACKS), "attack"), F.when((F.col("modality") == "ocr") & T.any_of(low, T.SKILLS), "skill"),
        F.when((F.col("modality") == "visual") & T.any_of(low, ("combat", "attack", "weapon")), "combat_visual"),
        F.when((F.col("modality") == "ocr") & T.any_of(low, T.EFFECTS), "effect"), F.when((F.col("modality") == "ocr") & T.any_of(low, T.VICTORIES), "victory"),
    ))
    rows = df.select("timeline_id", "t_sec", "seq", F.col("description").alias("content"), F.explode(kinds).alias("type"))
    return rows.where(F.col("type").isin("attack", "skill", "combat_visual")), rows.where(F.col("type").isin("effect", "victory"))


def nearest_state(queries: DataFrame, states: DataFrame, key: str, order: str = "seq", rows: int = ordered.ROWS) -> DataFrame:
    """For each query (key, query_id, t_query) the state (key, t_sec, order, ...) nearest in time; the first in the history wins ties.

    One sort of queries and states, and not their product. Queries without a time, or whose key has no state, have no row; states without a time are never the nearest.
    """
    kept = [c for c in states.columns if c != key]
    asked = queries.select(key, "query_id", "t_query").where(F.col(key).isNotNull())
    found = ordered.nearest(asked, states.where(F.col(key).isNotNull()), key, "t_query", "t_sec", order, rows=rows).where("state is not null")
    return found.select(key, "query_id", "t_query", *[F.col("state")[c].alias(c) for c in kept])


def nearest_frame(frames: DataFrame, t: float | None) -> DataFrame:
    """The frame (frame_idx, t_sec) nearest to t; without t the middle one."""
    if t is not None:
        return frames.orderBy(F.abs(F.col("t_sec") - t), "frame_idx").limit(1)
    return frames.orderBy("frame_idx").offset(frames.count() // 2).limit(1)


def joined_texts(rows: DataFrame, key: str, order: list[str], text: str, separator: str, most: int | None = None, fallback: str | None = None) -> DataFrame:
    """(key, joined): the first ``most`` texts of each key in order."""
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, text)))), lambda x: x[text])
    out = rows.groupBy(key).agg((F.slice(texts, 1, most) if most else texts).alias("t"))
    joined = F.array_join("t", separator)
    return out.select(key, (F.when(F.size("t") > 0, joined).otherwise(fallback) if fallback is not None else joined).alias("joined"))


def texts_near(embeddings: DataFrame, events: DataFrame, seconds: float = 2.0, most: int = 3, fallback: str = "gameplay scene") -> DataFrame:
    """(emb_id, joined): descriptions strictly within ``seconds`` of each embedding (timeline_id, emb_id, t_emb), the first ones, or the fallback."""
    near = band_join(embeddings, events.select("timeline_id", "t_sec", "seq", "description"), ["timeline_id"], "t_emb", "t_sec", seconds, seconds, (True, True))
    all_ = embeddings.select("emb_id").join(near.select("emb_id", "t_sec", "seq", "description"), "emb_id", "left")
    return joined_texts(all_, "emb_id", ["t_sec", "seq"], "description", "; ", most, fallback)


def texts_within(clips: DataFrame, events: DataFrame, separator: str = "; ", most: int | None = 5, fallback: str | None = None, bucket: float = 60.0) -> DataFrame:
    """(clip_id, joined): texts whose time lies in [start, end] of each clip (timeline_id, clip_id, start, end).

    Time is cut into buckets of ``bucket`` seconds times a power of two. A clip goes to the two or three buckets that it touches at the level where one is as long as the clip, an event to its own bucket at each level that clips have; so a long clip has no more rows than a short one.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(bucket)) / bucket))).cast("int")
    a = clips.where("start <= end").withColumn("__l", level)
    size = bucket * F.pow(F.lit(2.0), F.col("__l"))
    levels = a.select("__l").distinct()
    a = a.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / size).cast("bigint"), F.floor(F.col("end") / size).cast("bigint"))))
    b = events.select("timeline_id", "t_sec", "seq", "description").crossJoin(F.broadcast(levels)).withColumn("__b", F.floor(F.col("t_sec") / size).cast("bigint"))
    inside = a.join(b, ["timeline_id", "__l", "__b"]).where((F.col("t_sec") >= F.col("start")) & (F.col("t_sec") <= F.col("end")))
    all_ = clips.select("clip_id").join(inside.select("clip_id", "t_sec", "seq", "description"), "clip_id", "left")
    return joined_texts(all_, "clip_id", ["t_sec", "seq"], "description", separator, most, fallback)


def frames_with_detections(frames: DataFrame, detections: DataFrame, width: float, height: float) -> DataFrame:
    """Detections (video, t_sec, label, bbox) by the exact time of their frame (video, t_sec, ...); a frame without any has one that covers it."""
    full = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(width).alias("x2"), F.lit(height).alias("y2"))
    return frames.join(detections, ["video", "t_sec"], "left").withColumn("bbox", F.coalesce("bbox", full)).withColumn("label", F.coalesce("label", F.lit("full_frame")))


def opened_and_closed(changes: DataFrame) -> DataFrame:
    """Intervals from rows (source_id, target_id, relation_type, t_sec, seq, is_start): each end closes the first open start; one that finds none open closes nothing. Open ones have no end.

    Of a running balance of starts and ends, an end that makes a new low below 0 found none open, and the low counts those so far; so the k-th of the others closes the k-th start.
    """
    keys = ["source_id", "target_id", "relation_type"]
    w = W.partitionBy(*keys).orderBy("t_sec", "seq")
    n_starts, n_ends = F.count_if("is_start").over(w), F.count_if(~F.col("is_start")).over(w)
    low = changes.withColumn("s", n_starts).withColumn("e", n_ends).withColumn("low", F.least(F.lit(0), F.min(F.col("s") - F.col("e")).over(w)))
    starts = low.where("is_start").select(*keys, F.col("s").alias("k"), F.col("t_sec").alias("start_time"), "seq")
    effective = low.withColumn("before", F.coalesce(F.lag("low").over(w), F.lit(0))).where("not is_start and low = before")
    ends = effective.select(*keys, (F.col("e") + F.col("low")).alias("k"), F.col("t_sec").alias("end_time"))
    return starts.join(ends, [*keys, "k"], "left").select(*keys, "k", "seq", "start_time", "end_time")


def keyword_hits(detections: DataFrame, label: str, concepts: list[str], least: float = 0.8) -> DataFrame:
    """For each frame the first detection, then the first concept in the list, whose label contains it with enough confidence: (frame_id, label, concept, confidence)."""
    dim = F.broadcast(detections.sparkSession.createDataFrame(list(enumerate(concepts)), "k int, concept string"))
    hits = detections.join(dim, F.lower(F.col(label)).contains(F.lower("concept"))).where(F.col("confidence") >= least)
    return hits.groupBy("frame_id").agg(F.min(F.struct("det_no", "k", F.col(label).alias("label"), "concept", "confidence")).alias("h")).select("frame_id", "h.label", "h.concept", "h.confidence")


def missing(samples: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What is still to be done."""
    return samples.join(cached.select(key).distinct(), key, "left_anti")


def last_value_of(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Distinct keys, the last value counting."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
