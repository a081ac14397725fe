"""Retrieval by time and by vector, and the prompt that is built of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import timeline as TL
from tidemark.operators import vector_index


def semantic_top(rows: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", order: str = "vec_id") -> DataFrame:
    """The k rows of greatest cosine with one query vector; ties by ``order``. The limit is taken a partition first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("similarity", F.round(V.cosine(F.col(vector), q), 6)).orderBy(F.desc("similarity"), order).limit(k or 10)


def similar_regions(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest candidates of every query (query_id, query_vec), by the exact index of cells."""
    return vector_index.nearest(queries, candidates, k)[0]


def by_timestamp(timeline: DataFrame, t: float, half: float = 30.0, include_low: bool = False) -> DataFrame:
    return TL.around(timeline, t, 2 * half, include_low=include_low)


def hybrid(time_hits: DataFrame, semantic_hits: DataFrame, key: str = "seq", more: int = 5) -> DataFrame:
    """Hits by time, then the first ``more`` semantic ones that are not among them; ``part`` keeps the order."""
    top = semantic_hits.orderBy(F.desc("similarity"), key).limit(more)
    rest = top.join(time_hits.select(key), key, "left_anti")
    return time_hits.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)), allowMissingColumns=True)


def near_embeddings(embeddings: DataFrame, t: float | None, seconds: float = 30.0, first: dict[str, int] | None = None) -> DataFrame:
    """Embeddings (modality, t0, emb_id) strictly within ``seconds``; without a time the first of each modality."""
    if t is not None:
        return embeddings.where(F.abs(F.col("t0") - t) < seconds)
    most = first or {"visual": 20, "temporal": 10, "audio": 10}
    ranked = embeddings.withColumn("__n", F.row_number().over(W.partitionBy("modality").orderBy("t0", "emb_id")))
    cap = F.lit(0)
    for name, n in most.items():
        cap = F.when(F.col("modality") == name, n).otherwise(cap)
    return ranked.where(F.col("__n") <= cap).drop("__n")


def region_text(regions: DataFrame, key: str) -> DataFrame:
    """(key, text): a header and a line for each region (label, confidence, seq)."""
    line = F.concat(F.lit("- "), "label", F.lit(" (confidence: "), F.format_string("%.2f", F.col("confidence")), F.lit(")"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    return regions.groupBy(key).agg(F.concat(F.lit("Detected regions:\n"), lines).alias("text"))


def context_text(rows: DataFrame, key: str, budget: int = 20_000) -> DataFrame:
    """(key, context): lines in order of time while they fit the budget; the line that does not gives way to a mark."""
    line = T.verbose(F.col("t_sec"), F.col("entity_id"), F.col("modality"), F.col("description"))
    w = W.partitionBy(key).orderBy("t_sec", "seq").rowsBetween(W.unboundedPreceding, 0)
    kept = rows.withColumn("line", line).withColumn("chars", F.sum(F.length("line")).over(w))
    over = F.min(F.when(F.col("chars") > budget, F.struct("t_sec", "seq"))).over(W.partitionBy(key))
    cut = kept.withColumn("over", over).withColumn("line", F.when(F.struct("t_sec", "seq") == F.col("over"), "... (truncated)").otherwise(F.col("line"))).where(F.col("over").isNull() | (F.struct("t_sec", "seq") <= F.col("over")))
    return cut.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_sec", "seq", "line"))), lambda x: x["line"]), "\n").alias("context"))


def messages(system: str, context: Column, question: Column, history: Column | None = None) -> Column:
    """Two messages, system and user: what was said, what was seen, the question."""
    user = F.concat_ws("\n\n", F.when(F.length(history) > 0, F.concat(F.lit("Conversation:\n"), history)) if history is not None else F.lit(None), F.when(F.length(context) > 0, F.concat(F.lit("Timeline:\n"), context)), F.concat(F.lit("Question: "), question))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
