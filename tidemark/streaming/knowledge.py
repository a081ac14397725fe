"""A knowledge base that grows by micro-batches: entities, their states, the edges of every frame and the intervals that they make.

Each batch adds its own part of every table, and a reader merges the parts: sums and extremes for entities, unions for states and edges, islands of time for intervals. So a batch writes what is new and rewrites nothing, rows may come in any order and any split, and the tables equal those of one batch. ``compact`` merges the parts into one.

A version is a manifest that names its parts. It is written after them, and is there once Spark's writer has committed it; a reader takes the last one, and a batch that is tried again writes the same parts over and names them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions import geometry as G
from tidemark.operators import graph

STATES = "frame_id bigint, t_sec double, entity_id string, concept_label string, rank bigint, bbox struct<x1:double,y1:double,x2:double,y2:double>"
ENTITIES = "entity_id string, first struct<t_sec:double,rank:bigint,concept_label:string>, last_seen double, n_states bigint"
EDGES = "frame_id bigint, t_sec double, source_id string, target_id string, relation_type string, confidence double"
INTERVALS = "source_id string, target_id string, relation_type string, start_time double, end_time double, frames bigint"
PAIR = ["source_id", "target_id", "relation_type"]


class Knowledge:
    """The tables under ``folder``, which driver and executors share. ``span`` is the seconds of a folder of states: what a batch reads back are the folders that its rows fall in. ``timeout`` is the longest gap within an interval."""

    def __init__(self, spark: SparkSession, folder: str, near: float = G.NEAR_PIXELS, timeout: float = 1.0, span: float = 3600.0):
        self.spark, self.folder, self.near, self.timeout, self.span = spark, folder.rstrip("/"), near, timeout, span

    def version(self) -> int:
        """The last version, 0 at the start."""
        done = [int(v) for v in storage.names(self.spark, f"{self.folder}/manifests") if v.isdigit() and storage.exists(self.spark, f"{self.folder}/manifests/{v}/_SUCCESS")]
        return max(done, default=0)

    def parts(self) -> list[str]:
        """Names of the parts of the last version, in order."""
        last = self.version()
        return [r["part"] for r in self.spark.read.schema("k int, part string").json(f"{self.folder}/manifests/{last}").orderBy("k").collect()] if last else []

    def _commit(self, parts: list[str]) -> None:
        rows = self.spark.createDataFrame(list(enumerate(parts)), "k int, part string")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/{self.version() + 1}")

    def _read(self, name: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, part string").parquet(f"{self.folder}/{name}").where(F.col("part").isin(parts)).drop("part")

    def update(self, batch: DataFrame, number: int) -> None:
        """Takes in states (``STATES``; ``rank`` is the order of registration), for foreachBatch. A batch number counts once; repeated rows count each, as in one batch."""
        part, parts = f"b{number}", self.parts()
        if any(p == part or p.startswith("c") and number <= int(p.split("-")[1]) for p in parts):
            return
        names = [c.split()[0] for c in STATES.replace("struct<x1:double,y1:double,x2:double,y2:double>", "struct").split(", ")]
        bucket = F.floor(F.col("t_sec") / self.span).alias("bucket")
        new = storage.staged(batch.select(*names, bucket), "states", f"{self.folder}/incoming/{part}")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/states/part={part}")
        first = F.min(F.struct("t_sec", "rank", "concept_label")).alias("first")
        new.groupBy("entity_id").agg(first, F.max("t_sec").alias("last_seen"), F.count(F.lit(1)).alias("n_states")).write.mode("overwrite").parquet(f"{self.folder}/entities/part={part}")
        # Pairs of which one at least is new, among all states of the frames that the batch has.
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # one for each span of the batch's time
        old = self._read("states", f"{STATES}, bucket bigint", parts).where(F.col("bucket").isin(touched)).join(new.select("frame_id").distinct(), "frame_id", "left_semi")
        both = new.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False)))
        edges = storage.staged(frame_edges(both, self.near), "edges", f"{self.folder}/edges/part={part}")
        intervals(edges, self.timeout).write.mode("overwrite").parquet(f"{self.folder}/intervals/part={part}")
        self._commit([*parts, part])
        storage.removed(self.spark, f"{self.folder}/incoming/{part}")

    def states(self) -> DataFrame:
        return self._read("states", STATES, self.parts())

    def entities(self) -> DataFrame:
        """(entity_id, concept_label, first_seen, last_seen, n_states)."""
        merged = self._entities(self.parts())
        return merged.select("entity_id", "first.concept_label", F.col("first.t_sec").alias("first_seen"), "last_seen", "n_states")

    def _entities(self, parts: list[str]) -> DataFrame:
        return self._read("entities", ENTITIES, parts).groupBy("entity_id").agg(F.min("first").alias("first"), F.max("last_seen").alias("last_seen"), F.sum("n_states").alias("n_states"))

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES, self.parts())

    def intervals(self) -> DataFrame:
        """(source_id, target_id, relation_type, start_time, end_time, frames): what holds in frames at most ``timeout`` apart."""
        return merged_intervals(self._read("intervals", INTERVALS, self.parts()), self.timeout)

    def compact(self) -> None:
        """Makes one part of all. Parts that it replaces stay until ``clean``, for those who read an older version."""
        parts = self.parts()
        if not parts:
            return
        last = max(int(p.split("-")[1]) if p.startswith("c") else int(p[1:]) for p in parts)
        part = f"c-{last}-{self.version() + 1}"
        self._read("states", f"{STATES}, bucket bigint", parts).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/states/part={part}")
        self._entities(parts).write.mode("overwrite").parquet(f"{self.folder}/entities/part={part}")
        self._read("edges", EDGES, parts).write.mode("overwrite").parquet(f"{self.folder}/edges/part={part}")
        merged_intervals(self._read("intervals", INTERVALS, parts), self.timeout).write.mode("overwrite").parquet(f"{self.folder}/intervals/part={part}")
        self._commit([part])

    def clean(self) -> None:
        """Removes what the last version doesn't name."""
        kept = set(self.parts())
        for name in ("states", "entities", "edges", "intervals"):
            for found in storage.names(self.spark, f"{self.folder}/{name}"):
                if found.startswith("part=") and found.removeprefix("part=") not in kept:
                    storage.removed(self.spark, f"{self.folder}/{name}/{found}")


def frame_edges(states: DataFrame, near: float = G.NEAR_PIXELS) -> DataFrame:
    """``EDGES`` of all pairs of a frame; where states have ``new``, of those pairs that have a new side."""
    t = states.groupBy("frame_id").agg(F.min("t_sec").alias("t_sec"))
    # A pair of old states has been looked at when the later of them came.
    pairs = graph.spatial_edges(states, near, "new" if "new" in states.columns else None)
    return pairs.join(t, "frame_id").select(*[c.split()[0] for c in EDGES.split(", ")])


def intervals(edges: DataFrame, timeout: float) -> DataFrame:
    """``INTERVALS`` of edges of frames."""
    each = edges.select(*PAIR, F.col("t_sec").alias("start_time"), F.col("t_sec").alias("end_time"), F.lit(1).cast("bigint").alias("frames"))
    return merged_intervals(each, timeout)


def merged_intervals(parts: DataFrame, timeout: float) -> DataFrame:
    """Intervals of one relation that overlap, or are at most ``timeout`` apart, as one."""
    w = W.partitionBy(*PAIR).orderBy("start_time", "end_time")
    reached = F.max("end_time").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_time") - reached <= timeout, 0).otherwise(1)).over(w)
    return parts.withColumn("k", island).groupBy(*PAIR, "k").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("frames").alias("frames")).drop("k")
