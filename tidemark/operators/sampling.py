"""Windows over frames and audio: sampling, chunks, clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def every_nth(frames: DataFrame, video_fps: float, fps: float, guard: bool = True) -> DataFrame:
    """Every int(video_fps / fps)-th frame. Where that is 0, every frame with ``guard`` on, and an error without, as no frame can be picked."""
    step = int(video_fps / fps)
    if step < 1 and not guard:
        raise ValueError("fps is greater than the video's")
    return frames.where(F.col("frame_idx") % max(1, step) == 0).withColumn("t_sec", F.col("frame_idx") / video_fps)


def subsampled(frames: DataFrame, fps: float, wanted: float) -> DataFrame:
    """Every int(fps / wanted)-th of a video's frames, if fewer are wanted."""
    if not 0 < wanted < fps:
        return frames
    k = F.row_number().over(W.partitionBy("video").orderBy("t_sec", "frame_idx")) - 1
    return frames.withColumn("__k", k).where(F.col("__k") % int(fps / wanted) == 0).drop("__k")


def audio_chunks(media: DataFrame, length: float = 30.0, overlap: float = 0.5) -> DataFrame:
    """(media_id, k, start, end): chunks of ``length`` whose starts are length - overlap apart; the last may be short."""
    stride = length - overlap
    n = F.greatest(F.ceil(F.col("duration") / stride), F.lit(1)).cast("int")
    out = media.where("duration > 0").select("media_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return out.select("media_id", "k", (F.col("k") * stride).alias("start"), F.least(F.col("k") * stride + length, "duration").alias("end"))


def clips(media: DataFrame, length: float = 4.0, overlap: float = 0.5) -> DataFrame:
    """(media_id, k, start, end): clips whose starts are length - overlap apart, while at least half a clip is left."""
    stride = length - overlap
    n = (F.floor((F.col("duration") - length / 2) / stride) + 1).cast("int")
    out = media.where(F.col("duration") >= length / 2).select("media_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return out.select("media_id", "k", (F.col("k") * stride).alias("start"), F.least(F.col("k") * stride + length, "duration").alias("end"))


def uniform_frames(clip_rows: DataFrame, most: int = 16) -> DataFrame:
    """``frames``: at most ``most`` places spread evenly over n_frames, cut to whole ones."""
    k = F.least(F.col("n_frames"), F.lit(most))
    return clip_rows.withColumn("frames", F.when(k == 1, F.array(F.lit(0).cast("bigint"))).when(k > 1, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (F.col("n_frames") - 1) / (k - 1)))))


def frame_chunks(frames: DataFrame, length: int = 16, step: int = 8) -> DataFrame:
    """(video, chunk, n, mid_t): overlapping chunks of ``length`` frames, full ones only; the time is the middle frame's."""
    k = F.row_number().over(W.partitionBy("video").orderBy("t_sec", "frame_idx")) - 1
    rows = frames.withColumn("k", k).withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("k") - length) / step) + 1).cast("int"), F.floor(F.col("k") / step).cast("int"))))
    return rows.groupBy("video", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("k") == F.col("chunk") * step + length // 2, F.col("t_sec"))).alias("mid_t")).where(F.col("n") == length)


def padded_chunks(frames: DataFrame, length: int = 16) -> DataFrame:
    """(video, chunk, n, first_t, frames): chunks of ``length`` frames side by side; the last frame fills up the last chunk."""
    k = F.row_number().over(W.partitionBy("video").orderBy("t_sec", "frame_idx")) - 1
    rows = frames.withColumn("k", k).groupBy("video", F.floor(F.col("k") / length).alias("chunk"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.min("t_sec").alias("first_t"), F.transform(F.sort_array(F.collect_list(F.struct("k", "frame_idx"))), lambda x: x["frame_idx"]).alias("f"))
    return got.select("video", "chunk", "n", "first_t", F.concat("f", F.array_repeat(F.element_at("f", -1), F.lit(length) - F.size("f"))).alias("frames"))


def tumbling_chunks(media: DataFrame, length: float = 10.0, least: float = 1.0) -> DataFrame:
    """(media_id, k, start, end): chunks side by side; a last one under ``least`` seconds is left out."""
    n = F.ceil(F.col("duration") / length).cast("int")
    out = media.where("duration > 0").select("media_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return out.select("media_id", "k", (F.col("k") * length).alias("start"), F.least(F.col("k") * length + length, "duration").alias("end")).where(F.col("end") - F.col("start") >= least)


def trajectories(tracked: DataFrame) -> DataFrame:
    """(timeline_id, entity_id, n_points, centers): the centres of each entity's boxes in order of time; rows have (timeline_id, entity_id, t_sec, seq, bbox)."""
    at = F.struct("t_sec", "seq", ((F.col("bbox.x1") + F.col("bbox.x2")) / 2).alias("x"), ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("y"))
    out = tracked.groupBy("timeline_id", "entity_id").agg(F.sort_array(F.collect_list(at)).alias("p"))
    return out.select("timeline_id", "entity_id", F.size("p").alias("n_points"), F.transform("p", lambda p: F.struct(p["t_sec"].alias("t_sec"), p["x"].alias("x"), p["y"].alias("y"))).alias("centers"))


def motion(series: DataFrame, value: str = "value") -> DataFrame:
    """Class of each frame by how far its mean differs from the one before."""
    d = F.abs(F.col(value) - F.lag(value).over(W.partitionBy("timeline_id").orderBy("t_sec", "seq")))
    return series.withColumn("motion_score", d).withColumn("motion_type", F.when(d > 30, "high_action").when(d > 15, "moderate").when(d > 5, "low").otherwise("static"))


def numbered_ids(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """``entity_id``: kind_001, kind_002, ... in order."""
    return rows.withColumn("entity_id", F.format_string("%s_%03d", F.col(kind), F.row_number().over(W.partitionBy(kind).orderBy(*order))))


def time_ids(rows: DataFrame) -> DataFrame:
    """``entity_id``: type and tenth of a second; of rows that meet in one, the first stays."""
    t = F.translate(F.format_string("%.1f", F.col("t_sec")), ".", "_")
    keyed = rows.withColumn("entity_id", F.concat("type", F.lit("_"), t))
    return keyed.withColumn("__n", F.row_number().over(W.partitionBy("timeline_id", "entity_id").orderBy("seq"))).where("__n = 1").drop("__n")


def token_summary(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.sort_array(F.collect_set("level")).alias("levels"), F.sum("source_frame_count").alias("frames"))


def newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__n") <= most).drop("__n")


def hierarchy(df: DataFrame, levels: dict[str, float] | None = None) -> DataFrame:
    """(timeline_id, level, bucket, n, first_t, last_t): rollups of a timeline at several lengths in one pass."""
    levels = levels or {"fine": 5.0, "clip": 30.0, "scene": 300.0, "session": 3600.0}
    rows = df.select("timeline_id", "t_sec", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("t_sec") / v).alias("bucket")) for k, v in levels.items()])).alias("l"))
    return rows.groupBy("timeline_id", "l.level", "l.bucket").agg(F.count(F.lit(1)).alias("n"), F.min("t_sec").alias("first_t"), F.max("t_sec").alias("last_t"))
