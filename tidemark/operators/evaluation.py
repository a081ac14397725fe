"""Evaluation: answers scored, metrics grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edges of the duration buckets, in seconds.
DURATION_EDGES = (0, 300, 600, 1800, 3600)
#: What is averaged of each sample.
MEANS = ("num_frames", "input_tokens", "output_tokens", "total_tokens", "perception_time", "retrieval_time", "generation_time", "total_time")


def aggregates(metrics: DataFrame) -> DataFrame:
    """One row for each (model_config, benchmark), and one for each task of it: GROUPING SETS in one pass. ``task_type`` is null in the totals, which ``is_total`` marks."""
    mean = lambda c: F.round(F.avg(c), 6).alias(f"avg_{c}")
    return metrics.groupingSets([["model_config", "benchmark"], ["model_config", "benchmark", "task_type"]], "model_config", "benchmark", "task_type").agg(
        F.grouping("task_type").cast("int").alias("is_total"), F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        *[mean(c) for c in MEANS], F.max("peak_vram_gb").alias("max_vram"), F.round(F.sum("total_time"), 4).alias("sum_time"),
    )


def task_breakdown(metrics: DataFrame) -> DataFrame:
    """(model_config, benchmark, tasks): a map of each task's accuracy and counts."""
    per = metrics.groupBy("model_config", "benchmark", "task_type").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum(F.col("correct").cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return per.groupBy("model_config", "benchmark").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task_type", F.struct("accuracy", "correct", "total").alias("v"))))).alias("tasks"))


def comparison(metrics: DataFrame, configs: list[str]) -> DataFrame:
    """Accuracy of each config a column, a row for each benchmark."""
    return metrics.groupBy("benchmark").pivot("model_config", configs).agg(F.round(F.avg(F.col("correct").cast("double")), 6)).orderBy("benchmark")


def duration_buckets(metrics: DataFrame) -> DataFrame:
    """(model_config, bucket, total, accuracy, avg_tokens, avg_time) over half-open buckets of video length."""
    d = F.col("video_duration_sec")
    bucket = F.when(d >= DURATION_EDGES[-1], len(DURATION_EDGES) - 1)
    for k in range(len(DURATION_EDGES) - 2, -1, -1):
        bucket = bucket.when(d >= DURATION_EDGES[k], k)
    return metrics.withColumn("bucket", bucket).where("bucket is not null").groupBy("model_config", "bucket").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("total_tokens"), 6).alias("avg_tokens"), F.round(F.avg("total_time"), 6).alias("avg_time"))


def run_totals(results: DataFrame) -> DataFrame:
    """(category, total, n_correct, accuracy, avg_latency, n_errors), the whole under a null category."""
    return results.groupingSets([[], ["category"]], "category").agg(F.grouping("category").cast("int").alias("is_total"), F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("latency_sec"), 6).alias("avg_latency"), F.count("error").alias("n_errors"))


def loader_statistics(samples: DataFrame) -> DataFrame:
    """(total, n_tasks, n_categories, avg, min and max of durations other than 0)."""
    d = F.nullif(F.col("duration"), F.lit(0))
    return samples.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("task").alias("n_tasks"), F.count_distinct("category").alias("n_categories"), F.round(F.avg(d), 6).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"))


def loader_counts(samples: DataFrame) -> DataFrame:
    """(kind, name, n): samples of each task, and of each category."""
    both = F.explode(F.array(F.struct(F.lit("task").alias("kind"), F.col("task").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name"))))
    return samples.select(both.alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def preset_comparison(results: DataFrame) -> DataFrame:
    """A row for each preset of results (preset, correct, latency_sec, error): samples, accuracy, mean time and failures."""
    return results.groupBy("preset").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("latency_sec"), 6).alias("avg_latency"), F.count("error").alias("n_errors"))


def errors(results: DataFrame) -> DataFrame:
    """(sample_id, error) of the samples that failed."""
    return results.where("error is not null").select("sample_id", "error")


def filtered(samples: DataFrame, tasks: list[str] | None = None, categories: list[str] | None = None, least: float | None = None, most: float | None = None, keep_unknown: bool = True) -> DataFrame:
    """Filters of a loader; an unknown duration passes its bounds, or counts as 0 with ``keep_unknown`` off, where bounds of 0 are none."""
    if tasks:
        samples = samples.where(F.col("task").isin(tasks))
    if categories:
        samples = samples.where(F.col("category").isin(categories))
    d = F.col("duration") if keep_unknown else F.coalesce("duration", F.lit(0))
    for bound, test in ((least, lambda b: d >= b), (most, lambda b: d <= b)):
        if bound is not None and (keep_unknown or bound):
            samples = samples.where(test(bound) | d.isNull())
    return samples


def limited(samples: DataFrame, most: int, order: str, shuffle_seed: int | None = None) -> DataFrame:
    """The first ``most`` in file order, or by a seeded hash where a shuffle is asked for and there are more."""
    if shuffle_seed is None or samples.limit(most + 1).count() <= most:
        return samples.orderBy(order).limit(most)
    return samples.orderBy(F.xxhash64(F.lit(shuffle_seed), order), order).limit(most)


def modelled_tokens(duration: str = "video_duration_sec", fps: float = 4.0, most_frames: int = 256):
    """(frames, input tokens, retrieval time) of the long-video formula."""
    frames = F.least(F.floor(F.coalesce(F.col(duration), F.lit(0.0)) * fps), F.lit(most_frames))
    return frames.alias("frames"), (1024 + frames * 32).alias("input_tokens"), (0.1 + F.coalesce(F.col(duration), F.lit(0.0)) / 60 * 0.05).alias("retrieval_time")


def dominant_type(events: DataFrame, key: str) -> DataFrame:
    """(key, dominant): speech with any transcript, else the most frequent type (the first seen of equals), else silence. Rows: (key, seq, type, transcript)."""
    per = events.groupBy(key, "type").agg(F.count("type").alias("c"), F.min("seq").alias("s"), F.count(F.when(F.length("transcript") > 0, 1)).alias("spoken"))
    return per.groupBy(key).agg(F.when(F.sum("spoken") > 0, "speech").otherwise(F.coalesce(F.max_by(F.when(F.col("c") > 0, F.col("type")), F.struct("c", -F.col("s"))), F.lit("silence"))).alias("dominant"))
