"""The knowledge graph: entities, their states, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G


def entities(states: DataFrame) -> DataFrame:
    """(entity_id, concept_label, category, first_seen, last_seen, n_states) from states (entity_id, concept_label, category, t_sec, seq); the first row names the entity."""
    first = F.struct("t_sec", "seq")
    return states.groupBy("entity_id").agg(F.min_by("concept_label", first).alias("concept_label"), F.min_by("category", first).alias("category"), F.min("t_sec").alias("first_seen"), F.max("t_sec").alias("last_seen"), F.count(F.lit(1)).alias("n_states"))


def latest_state(states: DataFrame) -> DataFrame:
    """The state of greatest time of each entity; the first to come wins ties."""
    kept = [c for c in states.columns if c != "entity_id"]
    best = states.groupBy("entity_id").agg(F.max_by(F.struct(*kept), F.struct("t_sec", -F.col("seq"))).alias("s"))
    return best.select("entity_id", *[F.col(f"s.{c}").alias(c) for c in kept])


def history(states: DataFrame, entity_id: str, start: float | None = None, end: float | None = None) -> DataFrame:
    out = states.where(F.col("entity_id") == entity_id)
    out = out if start is None else out.where(F.col("t_sec") >= start)
    return out if end is None else out.where(F.col("t_sec") <= end)


def attribute_changes(states: DataFrame, value: str) -> DataFrame:
    """(entity_id, t_sec, old_value, new_value) where the value differs from the one before; nothing comes before the first, which is null."""
    old = F.lag(value).over(W.partitionBy("entity_id").orderBy("t_sec", "seq"))
    return states.withColumn("old_value", old).where(~F.col(value).eqNullSafe(F.col("old_value"))).select("entity_id", "t_sec", "old_value", F.col(value).alias("new_value"))


def text_changes(detections: DataFrame, pattern: str) -> DataFrame:
    """Of each timeline's frames (timeline_id, frame_idx, det_no, t_sec, text) the first text that contains the pattern, where it differs from the last one."""
    hit = detections.where(F.lower("text").contains(pattern.lower()))
    first = hit.groupBy("timeline_id", "frame_idx").agg(F.min(F.struct("det_no", "t_sec", "text")).alias("d")).select("timeline_id", "frame_idx", "d.t_sec", "d.text")
    return first.withColumn("old_text", F.lag("text").over(W.partitionBy("timeline_id").orderBy("frame_idx"))).where(~F.col("text").eqNullSafe(F.col("old_text")))


def last_states(states: DataFrame, most: int = 100) -> DataFrame:
    """The newest states of each entity by arrival."""
    w = W.partitionBy("entity_id").orderBy(F.desc("seq"))
    return states.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def spatial_edges(states: DataFrame, near: float = G.NEAR_PIXELS, new: str | None = None) -> DataFrame:
    """(frame_id, source_id, target_id, relation_type, confidence) of all pairs of a frame, in the order of their registration ``rank``; states have (frame_id, entity_id, rank, bbox). Pairs meet within a frame only. With ``new``, a boolean column, only pairs that have a new side."""
    fresh = F.col(new) if new else F.lit(True)
    a = states.select("frame_id", F.col("entity_id").alias("source_id"), F.col("rank").alias("ra"), F.col("bbox").alias("ba"), fresh.alias("na"))
    b = states.select("frame_id", F.col("entity_id").alias("target_id"), F.col("rank").alias("rb"), F.col("bbox").alias("bb"), fresh.alias("nb"))
    pairs = a.join(b, "frame_id").where("ra < rb and (na or nb)")
    kinds = F.concat(F.transform(G.relations(F.col("ba"), F.col("bb"), near), lambda r: F.struct(r.alias("r"), F.lit(0.8).alias("c"))), F.when(G.collides(F.col("ba"), F.col("bb")), F.array(F.struct(F.lit("collides_with").alias("r"), F.lit(0.9).alias("c")))).otherwise(F.array().cast("array<struct<r:string,c:double>>")))
    return pairs.select("frame_id", "source_id", "target_id", F.explode(kinds).alias("k")).select("frame_id", "source_id", "target_id", F.col("k.r").alias("relation_type"), F.col("k.c").alias("confidence"))


def episodes(edges: DataFrame, timeout: float) -> DataFrame:
    """Edges of frames (with t_sec) collapsed to intervals: a gap over ``timeout`` starts another."""
    keys = ["source_id", "target_id", "relation_type"]
    w = W.partitionBy(*keys).orderBy("t_sec")
    part = F.sum(F.when(F.col("t_sec") - F.lag("t_sec").over(w) <= timeout, 0).otherwise(1)).over(w)
    return edges.withColumn("k", part).groupBy(*keys, "k").agg(F.min("t_sec").alias("start_time"), F.max("t_sec").alias("end_time"), F.count(F.lit(1)).alias("n_frames"))


def active(edges: DataFrame, t: float | None = None) -> DataFrame:
    """Open edges, and for a time other than 0 those that end after it."""
    return edges.where(F.col("end_time").isNull() | (F.col("end_time") > t) if t else F.col("end_time").isNull())


def edges_of(edges: DataFrame, entity_id: str, as_source: bool = True, as_target: bool = True) -> DataFrame:
    """Outgoing, then incoming (``part`` 0 and 1); an edge to itself is both."""
    out = [edges.where(F.col(c) == entity_id).withColumn("part", F.lit(k)) for k, (c, on) in enumerate((("source_id", as_source), ("target_id", as_target))) if on]
    return out[0].unionByName(out[1]) if len(out) == 2 else out[0]


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, n_out, n_in)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("entity_id")).agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def overview(nodes: DataFrame, states: DataFrame, edges: DataFrame) -> DataFrame:
    """Every entity with its latest time and its numbers of edges."""
    last = latest_state(states).select("entity_id", F.col("t_sec").alias("latest_t"))
    return nodes.join(last, "entity_id", "left").join(degrees(edges), "entity_id", "left").select(*nodes.columns, "latest_t", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): entities by category, relationships by type, and how many of each are open."""
    parts = nodes.groupBy(F.lit("category").alias("kind"), F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    types = edges.groupBy(F.lit("relation").alias("kind"), F.col("relation_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    open_ = edges.groupBy(F.lit("active").alias("kind"), F.col("relation_type").alias("name")).agg(F.count_if(F.col("end_time").isNull()).alias("n"))
    return parts.unionByName(types).unionByName(open_)


def export_lines(nodes: DataFrame, edges: DataFrame, most_entities: int = 20, most_edges: int = 30) -> DataFrame:
    """(line_no, line): the entities seen last and the edges started last."""
    e = nodes.orderBy(F.desc("last_seen"), "entity_id").limit(most_entities).withColumn("k", F.row_number().over(W.orderBy(F.desc("last_seen"), "entity_id")))
    r = edges.orderBy(F.desc("start_time"), "seq").limit(most_edges).withColumn("k", F.row_number().over(W.orderBy(F.desc("start_time"), "seq")))
    head = nodes.sparkSession.createDataFrame([(0, "## Entities"), (1000, "## Relationships")], "line_no int, line string")
    lines = e.select(F.col("k").cast("int").alias("line_no"), F.concat(F.lit("- "), "entity_id", F.lit(" ("), "category", F.lit(")")).alias("line"))
    return head.unionByName(lines).unionByName(r.select((F.col("k") + 1000).cast("int").alias("line_no"), F.concat_ws(" ", F.lit("-"), "source_id", "relation_type", "target_id").alias("line")))


def graph_tables(nodes: DataFrame, edges: DataFrame, now: float | None = None, active_for: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """The graph as two tables, of any size: nodes (id, label, category, first_seen, last_seen), with ``now`` those seen within ``active_for`` seconds of it, and all edges (source, target, type, start_time, end_time)."""
    kept = nodes if now is None else nodes.where(F.col("last_seen") >= now - active_for)
    return (
        kept.select(F.col("entity_id").alias("id"), F.col("concept_label").alias("label"), "category", "first_seen", "last_seen"),
        edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"), "start_time", "end_time"),
    )


def as_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: arrays of nodes and of edges as JSON. For graphs that fit a row; use the tables otherwise."""
    n = nodes.agg(F.to_json(F.sort_array(F.collect_list(F.struct("entity_id", "category")))).alias("nodes"))
    return n.join(F.broadcast(edges.agg(F.to_json(F.sort_array(F.collect_list(F.struct("source_id", "target_id", "relation_type")))).alias("edges"))))


def relationship_summary(edges: DataFrame, most: int = 5) -> DataFrame:
    """(entity_id, direction, k, line): the first edges of each entity by insertion, out and in."""
    both = edges.select(F.col("source_id").alias("entity_id"), F.lit("out").alias("direction"), "seq", F.concat_ws(" ", "relation_type", "target_id").alias("line")).unionByName(edges.select(F.col("target_id").alias("entity_id"), F.lit("in").alias("direction"), "seq", F.concat_ws(" ", "source_id", "relation_type").alias("line")))
    return both.withColumn("k", F.row_number().over(W.partitionBy("entity_id", "direction").orderBy("seq"))).where(F.col("k") <= most).drop("seq")
