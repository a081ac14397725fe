"""Exact nearest neighbours by cosine, over vectors that lie in cells around centroids.

The angle between vectors obeys the triangle inequality: a vector of a cell is at least as far from a query as the query's angle to the centroid leaves beyond the cell's ring of angles. A query first looks at a few cells near it; its k-th best there is what any other cell has to beat, and those that can't are never scored. What is scored is scored as matrices, a block of a cell against the queries that reach it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import storage
from tidemark.functions import vectors as V

#: Vectors that the centroids are fitted on, at most; of a block; queries that share a copy of the blocks.
SAMPLE, BLOCK, CHUNK = 20_000, 20_000, 50_000
#: What sums in another order may differ by, in a similarity and in an angle.
LEEWAY, TURN = 2e-6, 1e-6


def _units(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors; zeros for what is null, of another length, zero or not finite."""
    out = np.zeros((len(column), d))
    for k, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == d and None not in v:
            v = np.array(v, float)
            size = np.sqrt(v @ v)
            if np.isfinite(size) and size > 0:
                out[k] = v / size
    return out


def centroids(vectors: DataFrame, vector: str, order: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 6) -> np.ndarray:
    """Unit centroids of at most ``sample`` vectors, those of least hash: about as many as the root of their number."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(order), order).select(vector).limit(sample).toArrow().column(vector).combine_chunks()
    lengths = [len(v) for v in rows.to_pylist()]
    d = max(set(lengths), key=lengths.count) if lengths else 0
    x = _units(rows, d)
    x = np.unique(x[x.any(1)], axis=0) if d else x
    if not len(x):
        return np.zeros((0, d))
    n = min(cells or max(1, int(len(x) ** 0.5)), len(x))
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _with_cell(centres: np.ndarray, at: int):
    """Each vector's cell, the one behind the last for vectors without a direction, and its angle."""

    def run(batches):
        for b in batches:
            u = _units(b.column(at), centres.shape[1])
            cell, angle = np.full(len(u), len(centres), np.int32), np.zeros(len(u))
            real = u.any(1)
            if real.any():
                a = _angles(u[real], centres)
                cell[real], angle[real] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    return run


def _routes(centres: np.ndarray, rings: dict[int, tuple[float, float]], probes: int, first: bool, at: int, floor: int | None):
    """Rows of queries, once for each cell that they reach: at first the ``probes`` nearest ones, then those others that may beat ``floor``."""
    full = [c for c in rings if c < len(centres)]
    low, high = (np.array([rings[c][k] for c in full]) for k in (0, 1))

    def run(batches):
        for b in batches:
            u = _units(b.column(at), centres.shape[1])
            rows, cells = [], []
            floors = b.column(floor).to_numpy(zero_copy_only=False) if floor is not None else None
            a = _angles(u, centres[full]) if full else np.zeros((len(u), 0))
            for k, angles in enumerate(a):
                near = np.argsort(angles, kind="stable")[:probes]
                if first:
                    own = list(near)
                else:
                    best = np.cos(np.maximum(0, np.maximum(angles - high, low - angles) - TURN))
                    best[near] = -99
                    own = list(np.flatnonzero(best >= floors[k] - LEEWAY) if u[k].any() else np.setdiff1d(np.arange(len(full)), near))
                found = [full[c] for c in own] + ([len(centres)] if first and len(centres) in rings else [])
                rows += [k] * len(found)
                cells += found
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in b.columns), pa.array(cells, pa.int32())], [*b.schema.names, "cell"])

    return run


def _scored(k: int, d: int, columns: list[str]):
    """Of a block and a chunk of queries the pairs that may be among a query's k best. Of equal similarities the k least ids are enough."""

    def run(key, block: pa.Table, queries: pa.Table) -> pa.Table:
        x, q = _units(block.column("vector").combine_chunks(), d), _units(queries.column("query_vec").combine_chunks(), d)
        ids = block.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        left, right, sims = [], [], []
        for at in range(0, len(q), 256) if len(x) else ():
            s = (q[at : at + 256] @ x.T)[:, order]
            kth = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
            for row, (values, least) in enumerate(zip(s, kth)):
                near = np.flatnonzero(values >= least - LEEWAY)
                if len(near) > k:  # by similarity, then id; the k first of each similarity
                    near = near[np.argsort(values[near], kind="stable")]
                    new = np.flatnonzero(np.diff(values[near], prepend=-9) != 0)
                    near = near[np.arange(len(near)) - np.repeat(new, np.diff(np.append(new, len(near)))) < k]
                left += [at + row] * len(near)
                right += order[near].tolist()
                sims += values[near].tolist()
        q_rows, x_rows = queries.take(pa.array(left, pa.int64())), block.take(pa.array(right, pa.int64()))
        return pa.table([q_rows.column("query_id"), q_rows.column("query_vec"), x_rows.column("vec_id"), x_rows.column("vector"), pa.array(sims, pa.float64())], names=columns)

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, cells: int | None = None, probes: int = 3, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, similarity, rank) of the k nearest candidates (vec_id, embedding) of every query (query_id, query_vec), and one row with ``share``, the share of all pairs that was scored.

    Exact: similarity is the cosine rounded to six digits, ties go to the least vec_id. The centroids come from a bounded sample and only decide how much is scored. Vectors that are null, zero, of another length or not finite have similarity 0 with all. Repeated rows count each. A large cell has many blocks, so many equal vectors are spread; of a block each query takes its k best. The cells' number and rings pass the driver, vectors don't.
    """
    spark = candidates.sparkSession
    src = candidates.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"))
    asked = queries.select("query_id", F.col("query_vec").cast(src.schema["vector"].dataType).alias("query_vec"))
    centres = centroids(src, "vector", "vec_id", cells, sample)
    d = centres.shape[1]
    schema = T.StructType([*src.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = storage.staged(src.mapInArrow(_with_cell(centres, 1), schema), "vector-cells")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    rings = {c: (r["low"], r["high"]) for c, r in stats.items()}
    blocks = F.array(*[F.lit(-(-stats[c]["n"] // block) if c in stats else 1) for c in range(len(centres) + 1)])
    chunks = max(1, -(-asked.count() // chunk))
    spread = placed.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id", "vector"), blocks[F.col("cell")]).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"))
    pair = T.StructType([*asked.schema.fields, *src.schema.fields, T.StructField("sim", T.DoubleType())])

    def scored(routed: DataFrame) -> DataFrame:
        rows = routed.select("query_id", "query_vec", "cell", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("c"))
        key: list[Column] = [F.col("cell"), F.col("b").cast("bigint"), F.col("c").cast("bigint")]
        return spread.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_scored(k, d, pair.names), pair)

    route = T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])
    near = storage.staged(asked.mapInArrow(_routes(centres, rings, probes, True, 1, None), route), "vector-routes")
    first = storage.staged(scored(near), "vector-pairs")
    w = W.partitionBy("query_id").orderBy(F.desc("sim"))
    best = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("sim")).otherwise(-9.0).alias("floor"))
    floors = asked.join(best, "query_id", "left").select("query_id", "query_vec", F.coalesce("floor", F.lit(-9.0)).alias("floor"))
    route2 = T.StructType([*floors.schema.fields, T.StructField("cell", T.IntegerType())])
    far = storage.staged(floors.mapInArrow(_routes(centres, rings, probes, False, 1, 2), route2).select("query_id", "query_vec", "cell"), "vector-routes")
    pairs = first.unionByName(scored(far)).join(best, "query_id", "left").where(F.col("sim") >= F.coalesce("floor", F.lit(-9.0)) - LEEWAY)
    exact = V.cosine(F.col("vector"), F.col("query_vec"))
    ranked = pairs.select("query_id", "vec_id", F.round(F.when(F.isnan(exact), 0.0).otherwise(exact), 6).alias("similarity"))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    result = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    sizes = F.array(*[F.lit(stats[c]["n"] if c in stats else 0) for c in range(len(centres) + 1)])
    total = sum(r["n"] for r in stats.values()) or 1
    share = near.unionByName(far).agg((F.sum(sizes[F.col("cell")]) / total).alias("s")).select((F.coalesce("s", F.lit(0.0)) / max(1, asked.count())).alias("share"))
    return result, share
