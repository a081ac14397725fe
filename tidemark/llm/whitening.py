"""Embedding whitening: singular values of the centred rows, total variance from exact deviations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Directions whose singular value is below this share of the greatest have no variance that doubles can tell from rounding.
LEAST_SHARE = 1e-6
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_steps(entry: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """A vector's entry as a long."""
    return F.floor(entry.cast("double") * scale) + F.lit(shift).cast("bigint")


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): every vector without null and non-finite entries, its entries as longs."""
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return src.where(F.col("v").isNotNull() & sound).select("vec_id", F.transform("v", lambda c: whole_steps(c)).alias("x"))


def _row_matrix(rows: DataFrame, array: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(array).alias("v")), "v"))


def _projected(n: int, sums: list[int], axes: np.ndarray):
    """(vec_id, deviation, w) of batches of (vec_id, x): the exact sum of (n x - S)^2, and the centred vector on each axis."""
    total = np.array(sums, np.int64)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(total))
            off = n * x - total
            most = int(np.abs(off).max(initial=0))
            if most * most * len(total) < 1 << 63:
                deviation = pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([sum(int(c) ** 2 for c in row) for row in off], pa.decimal128(38, 0))
            w = (off / n) @ axes
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.FixedSizeListArray.from_arrays(w.ravel(), w.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound vector and component.

    The rows, centred by their exact sums, are a distributed matrix A; MLlib's computeSVD gives its right singular vectors, which are the covariance's eigenvectors, and singular values s, whose eigenvalues are s^2 / n. The trace is the sum of the rows' exact deviations over n^3. ``identity_error`` is measured on the whitened rows: their Gramian, centred before it is multiplied, over n.

    Only d numbers and a matrix of d x d pass the driver, whatever the number of rows. Vectors that are null or hold null or non-finite entries are dropped. Shorter vectors count as ending in zeros, empty ones as zeros. Repeated rows and null ids stay, a result for each. Components without variance (``LEAST_SHARE``) are left out, so equal vectors, a single vector or an empty table give no rows. A deviation past 64 bits is null. Of equal eigenvalues the order and directions are as the decomposition gives them. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(fit_list(vectors, id_col, vector_col), "whitening-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("least")).first()
    n, d = size["n"], size["d"] or 0
    if not d:
        return spark.createDataFrame([], SCHEMA)
    if size["least"] < d:
        zero = F.array_repeat(whole_steps(F.lit(0.0)), F.lit(d) - F.size("x"))
        rows = rows.withColumn("x", F.concat("x", zero))
    sums = [r["s"] for r in rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("s")).orderBy("k").collect()]
    total = F.array(*[F.lit(s) for s in sums])
    centred = rows.select(F.zip_with("x", total, lambda c, s: (c * F.lit(n) - s).cast("double") / n).alias("c"))
    # Over half of the components: MLlib then decomposes the Gramian on the driver, in double precision, and doesn't iterate.
    svd = _row_matrix(centred, "c").computeSVD(min(d, max(most, d // 2 + 1)), computeU=False, rCond=LEAST_SHARE)
    singular = np.array(svd.s.toArray())[:most]
    singular = singular[singular > LEAST_SHARE * max(singular.max(initial=0), 1e-300)]
    if not len(singular):
        return spark.createDataFrame([], SCHEMA)
    eigen = singular**2 / n
    axes = np.array(svd.V.toArray())[:, : len(eigen)] / np.sqrt(eigen)
    white = written(rows.mapInArrow(_projected(n, sums, axes), "vec_id bigint, deviation decimal(38,0), w array<double>"), "whitening-white")
    trace = float(white.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("t")).first()["t"]) / n**3
    means = _row_matrix(white, "w").computeColumnSummaryStatistics().mean()
    level = F.array(*[F.lit(float(m)) for m in means])
    gram = _row_matrix(white.select(F.zip_with("w", level, lambda c, m: c - m).alias("w")), "w").computeGramianMatrix().toArray()
    error = float(np.abs(gram / n - np.eye(len(eigen))).max())
    explained = F.array(*[F.lit(float(e / trace)) for e in eigen])
    return white.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(error).alias("identity_error")
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
