"""Features kept by video, so that perception runs once: tables that only grow, and an index whose last word on a video counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import storage

INDEX = "video_hash string, video_path string, saved_at double, version string, n_rows bigint, deleted boolean, part bigint"


class FeatureCache:
    """The cache under ``folder``, for one writer at a time and any number of readers.

    A save writes its features, then its index rows; it is there once Spark has committed the index part. What is saved or invalidated later replaces what was saved before, and ``clean`` removes what nothing names. Rows are found by joining on ``video_hash`` (loaders.path_key or loaders.file_key).
    """

    def __init__(self, spark: SparkSession, folder: str, version: str = "1.0"):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _parts(self) -> list[int]:
        found = [p for p in storage.names(self.spark, f"{self.folder}/index") if p.startswith("part=")]
        return sorted(int(p[5:]) for p in found if storage.exists(self.spark, f"{self.folder}/index/{p}/_SUCCESS"))

    def index(self) -> DataFrame:
        """(video_hash, video_path, saved_at, version, n_rows, part) of every cached video."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], INDEX).drop("deleted")
        rows = self.spark.read.schema(INDEX).parquet(f"{self.folder}/index").where(F.col("part").isin(parts))
        last = rows.groupBy("video_hash").agg(F.max_by(F.struct("video_path", "saved_at", "version", "n_rows", "part", "deleted"), "part").alias("r"))
        return last.select("video_hash", "r.*").where("not deleted").drop("deleted")

    def save(self, features: DataFrame, saved_at: float) -> None:
        """Features (video_hash, video_path, ...); those of a video replace all that it had. Every save has the same columns."""
        part = max(self._parts(), default=-1) + 1
        kept = storage.staged(features, "features", f"{self.folder}/features/part={part}")
        rows = kept.groupBy("video_hash").agg(F.min("video_path").alias("video_path"), F.count(F.lit(1)).alias("n_rows"))
        self._commit(rows.select("video_hash", "video_path", F.lit(float(saved_at)).alias("saved_at"), F.lit(self.version).alias("version"), "n_rows", F.lit(False).alias("deleted")), part)

    def _commit(self, rows: DataFrame, part: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/index/part={part}")

    def has(self, videos: DataFrame) -> DataFrame:
        """``videos`` (video_hash, ...) with ``cached``."""
        known = self.index().select("video_hash", F.lit(True).alias("__cached"))
        return videos.join(known, "video_hash", "left").select(*videos.columns, F.coalesce("__cached", F.lit(False)).alias("cached"))

    def load(self, videos: DataFrame | None = None) -> DataFrame:
        """Features of ``videos`` (video_hash), or all, with ``stale`` where another version has written them; no rows if none was ever saved, so ask ``has`` first."""
        index = self.index()
        if videos is not None:
            index = index.join(videos.select("video_hash").distinct(), "video_hash", "left_semi")
        parts = [r["part"] for r in index.select("part").distinct().collect()]  # one for each save, which prunes the folders
        if not parts:
            return self.spark.createDataFrame([], "video_hash string, video_path string, stale boolean")
        rows = self.spark.read.option("basePath", f"{self.folder}/features").parquet(*[f"{self.folder}/features/part={p}" for p in parts]).withColumn("part", F.col("part").cast("bigint"))
        return rows.join(index.select("video_hash", "part", (F.col("version") != self.version).alias("stale")), ["video_hash", "part"]).drop("part")

    def invalidate(self, videos: DataFrame) -> None:
        """Forgets ``videos`` (video_hash); those that aren't cached don't matter."""
        gone = self.index().join(videos.select("video_hash").distinct(), "video_hash", "left_semi")
        rows = gone.select("video_hash", "video_path", "saved_at", "version", F.lit(0).cast("bigint").alias("n_rows"), F.lit(True).alias("deleted"))
        self._commit(rows, max(self._parts(), default=-1) + 1)

    def statistics(self) -> DataFrame:
        return self.index().agg(F.count(F.lit(1)).alias("num_cached_videos"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("num_rows"), F.count_if(F.col("version") != self.version).alias("num_stale"))

    def clean(self) -> None:
        """Removes features that the index no longer names."""
        kept = {r["part"] for r in self.index().select("part").distinct().collect()}
        for name in storage.names(self.spark, f"{self.folder}/features"):
            if name.startswith("part=") and int(name[5:]) not in kept:
                storage.removed(self.spark, f"{self.folder}/features/{name}")


def write_outputs(rows: DataFrame, path: str, outputs: dict) -> None:
    """Several outputs of one run: the rows are computed once and written, and every output, a function of them, is written from there as Parquet; a marker comes last, and nothing is read without it."""
    path = path.rstrip("/")
    stage = storage.staged(rows, "stage", f"{path}/stage")
    for name, make in outputs.items():
        make(stage).write.mode("overwrite").parquet(f"{path}/{name}")
    rows.sparkSession.createDataFrame([(n,) for n in outputs], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/committed")


def read_output(spark: SparkSession, path: str, name: str) -> DataFrame:
    path = path.rstrip("/")
    if not storage.exists(spark, f"{path}/committed/_SUCCESS"):
        raise ValueError(f"{path} is not complete")
    return spark.read.parquet(f"{path}/{name}")
