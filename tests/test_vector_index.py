"""The exact index of cells against every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import vector_index


def every_pair(queries, candidates, k):
    sim = V.cosine(F.col("embedding"), F.col("query_vec"))
    pairs = candidates.crossJoin(queries).select("query_id", "vec_id", F.round(F.when(F.isnan(sim), 0.0).otherwise(sim), 6).alias("similarity"))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return sorted(map(tuple, pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize(("seed", "spread", "kwargs"), [(1, 0.05, {}), (2, 3.0, {"cells": 5, "probes": 1}), (3, 0.3, {"block": 17, "chunk": 7, "sample": 50}), (4, 0.05, {"cells": 1})])
def test_every_pair(spark, seed, spread, kwargs):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, 16))
    x = heads[rng.integers(0, 12, 300)] + spread * rng.normal(size=(300, 16))
    x[100:200] = x[100]  # a third of the rows is one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(500, None), (501, [0.0] * 16), (502, [1.0] * 3), (503, [math.nan] * 16), (504, [1.0] * 15 + [None]), (7, x[7].tolist())]
    candidates = frame(spark, rows + odd)
    queries = candidates.where("vec_id % 9 = 0 or vec_id >= 500").withColumnRenamed("vec_id", "query_id").withColumnRenamed("embedding", "query_vec")
    queries = queries.where("query_id <> 7").unionByName(spark.createDataFrame([(900, (-x[3]).tolist())], queries.schema))
    got, share = vector_index.nearest(queries, candidates, 5, **kwargs)
    assert sorted(map(tuple, got.collect())) == every_pair(queries, candidates, 5)
    if spread < 0.1 and not kwargs:
        assert share.first().share < 0.7


def test_few_and_none(spark):
    candidates = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    queries = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, query_vec array<float>")
    assert sorted(map(tuple, vector_index.nearest(queries, candidates, 5)[0].collect())) == [(7, 1, 0.707107, 1), (7, 2, 0.707107, 2)]
    for q, c in ((queries, candidates.where("vec_id < 0")), (queries.where("query_id < 0"), candidates)):
        got, share = vector_index.nearest(q, c)
        assert got.collect() == [] and share.first().share == 0.0
    only = frame(spark, [(3, None), (4, None)])
    assert sorted(map(tuple, vector_index.nearest(queries, only, 1)[0].collect())) == [(7, 3, 0.0, 1)]
