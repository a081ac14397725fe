"""The knowledge base in any split into batches, against one batch."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.streaming import knowledge


def states(seed, n=160):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        f, e = r.randint(0, 40), r.randint(0, 6)
        x, y = float(r.randint(0, 300)), float(r.randint(0, 300))
        rows.append((f, f * 0.75, f"e{e}", f"label{r.randint(0, 2)}", e, (x, y, x + 120, y + 90)))
    return list({(x[0], x[2]): x for x in rows}.values())


def tables(k):
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    return {name: key(getattr(k, name)()) for name in ("states", "entities", "edges", "intervals")}


@pytest.mark.parametrize("seed", [1])
def test_any_split(spark, tmp_path, seed):
    rows = states(seed)
    df = spark.createDataFrame(rows, knowledge.STATES)
    whole = knowledge.Knowledge(spark, str(tmp_path / "whole"), 150.0, 2.0, 10.0)
    whole.update(df, 0)
    want = tables(whole)
    # The one batch is the batch operators.
    edges = graph.spatial_edges(df, 150.0).join(df.select("frame_id", "t_sec").distinct(), "frame_id")
    assert want["edges"] == sorted(map(str, map(tuple, edges.select("frame_id", "t_sec", "source_id", "target_id", "relation_type", "confidence").collect())))
    episodes = graph.episodes(edges, 2.0)
    assert want["intervals"] == sorted(map(str, map(tuple, episodes.select("source_id", "target_id", "relation_type", "start_time", "end_time", "n_frames").collect())))
    random.Random(seed).shuffle(rows)
    k = knowledge.Knowledge(spark, str(tmp_path / "split"), 150.0, 2.0, 10.0)
    cuts = [0, 3, 40, 41, 100, len(rows)]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(rows[a:b], knowledge.STATES)
        k.update(part, number)
        if number == 2:
            k.update(part, number)  # tried again after its version was there
            k.compact()
            k.update(part, number)
    assert tables(k) == want
    k.compact()
    k.clean()
    assert tables(k) == want and len(k.parts()) == 1


def test_a_batch_that_failed_is_not_seen(spark, tmp_path):
    rows = states(3)
    k = knowledge.Knowledge(spark, str(tmp_path / "k"), 150.0, 2.0, 10.0)
    k.update(spark.createDataFrame(rows[:60], knowledge.STATES), 0)
    before = tables(k)
    commit, k._commit = k._commit, lambda parts: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        k.update(spark.createDataFrame(rows[60:], knowledge.STATES), 1)
    assert tables(k) == before
    k._commit = commit
    k.update(spark.createDataFrame(rows[60:], knowledge.STATES), 1)
    one = knowledge.Knowledge(spark, str(tmp_path / "one"), 150.0, 2.0, 10.0)
    one.update(spark.createDataFrame(rows, knowledge.STATES), 0)
    assert tables(k) == tables(one)


def test_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame(states(4), knowledge.STATES)
    for p in range(3):
        df.where(F.pmod(F.xxhash64("frame_id", "entity_id"), F.lit(3)) == p).coalesce(1).write.parquet(str(tmp_path / f"in/{p}"))
    k, one = knowledge.Knowledge(spark, str(tmp_path / "k")), knowledge.Knowledge(spark, str(tmp_path / "one"))
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = rows.writeStream.foreachBatch(k.update).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    one.update(df, 0)
    assert q.exception() is None and k.version() == 3 and tables(k) == tables(one)


def test_empty(spark, tmp_path):
    k = knowledge.Knowledge(spark, str(tmp_path / "k"))
    k.compact()
    assert k.version() == 0 and k.entities().collect() == []
    k.update(spark.createDataFrame([], knowledge.STATES), 0)
    assert k.version() == 1 and k.intervals().collect() == []
