"""What an evaluation leaves: samples, aggregates and a summary, all from one run of the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation
from tidemark.sources import feature_cache

#: What a saved sample has if its record lacks it.
DEFAULTS = {
    "confidence": 0.0, "num_frames": 0, "input_tokens": 0, "output_tokens": 0, "total_tokens": 0, "perception_time": 0.0, "retrieval_time": 0.0, "generation_time": 0.0, "total_time": 0.0,
    "peak_vram_gb": 0.0, "video_duration_sec": 0.0, "question": "", "answer_format": "",
}
#: What every record must have.
REQUIRED = {"sample_id": "string", "benchmark": "string", "task_type": "string", "model_config": "string", "correct": "boolean", "predicted": "string", "ground_truth": "string"}
TYPES = {float: "double", int: "int", str: "string"}


def summary_lines(totals: DataFrame) -> DataFrame:
    """(model_config, benchmark, line): a line for each config and benchmark of the aggregates; halves go to the even digit."""
    number = lambda c, digits: F.format_string(f"%.{digits}f", F.bround(F.col(c).cast("double"), digits))
    line = F.concat_ws(" | ", "model_config", "benchmark", F.col("total").cast("string"), F.concat(number("pct", 1), F.lit("%")), number("avg_total_tokens", 0), number("avg_total_time", 2), number("max_vram", 1))
    return totals.where("is_total = 1").withColumn("pct", F.col("accuracy") * 100).select("model_config", "benchmark", line.alias("line"))


def save_results(metrics: DataFrame, path: str) -> None:
    """Writes ``samples``, ``aggregates`` and ``summary`` below ``path``; the plan behind ``metrics`` runs once, and a reader sees all three or none."""
    feature_cache.write_outputs(metrics, path, {
        "samples": lambda d: d,
        "aggregates": evaluation.aggregates,
        "summary": lambda d: summary_lines(evaluation.aggregates(d)),
    })


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of JSON records, one a line: all fields typed, optional ones at their defaults where a record lacks them. A record without a required field ends the job, as does one that is no JSON."""
    schema = ", ".join([f"{c} {t}" for c, t in REQUIRED.items()] + [f"{c} {TYPES[type(v)]}" for c, v in DEFAULTS.items()])
    rows = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    must = [F.when(F.col(f"r.{c}").isNotNull(), F.col(f"r.{c}")).otherwise(F.raise_error(F.concat(F.lit(f"no {c}: "), F.col("value"))).cast(t)).alias(c) for c, t in REQUIRED.items()]
    return rows.select(*must, *[F.coalesce(f"r.{c}", F.lit(v)).alias(c) for c, v in DEFAULTS.items()])
