"""Shared helpers of the training-text operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the polynomial over word hashes, and of the final mix.
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Keys that only prune are cut to this many bits: less to shuffle, and a clash of two costs work, not results.
KEY_BITS = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one where it is unset and there are no other machines.

    What is written there stays until the folder's owner clears it: results are read from it lazily, so that no operator knows when it is done with.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Shuffle files of what is run go as it ends, not when the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Groups and texts go to Python workers in batches of so many bytes; else a whole group lies outside the JVM's heap at once, and twice while its buffer grows.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def under(spark: SparkSession, settings: dict[str, str]):
    """The settings hold for what is planned and run within."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with under(df.sparkSession, FREED):
        return df.select("*").checkpoint()  # a plan made here, so that it is under the setting


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: computed once, and no lost executor recomputes it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with under(df.sparkSession, FREED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the folder of a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(broadcast, make):
    """What ``make`` gives of a broadcast value, made once a worker process and not once a task."""
    held = vars(broadcast)
    if "_made" not in held:
        held["_made"] = make(broadcast.value)
    return held["_made"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; A-Z lower-cased if asked."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, mixed so that its order is as good as random."""
    if len(hashes) < n:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for j in range(1, n):
            out = out * _MULT + hashes[j : len(hashes) - n + 1 + j]
    return mixed(out)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Powers of an odd number and of its inverse: a word's hash is its bytes' polynomial, taken from running sums and shifted back.
_BASE = 0xD6E8FEB86659FD93
_SPAN = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


class Tokens:
    """The words of a column of texts, as arrays over all of them: ``starts`` and ``ends`` in ``data``, ``first`` word of each text (and the end), ``hashes``."""

    def __init__(self, column: pa.Array, lower: bool = True):
        column = column.cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        self.data = _LOWER[raw] if lower else raw
        word = ~_WHITE[self.data]
        edge = offsets[(offsets > 0) & (offsets < len(raw))]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[edge], after[edge - 1] = False, False
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self._white_after = ~word & before

    @property
    def hashes(self) -> np.ndarray:
        """64 bits of each word; made in spans, so that one very long text needs no more memory than others."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(out):
                low = self.starts[at]
                end = max(at + 1, int(np.searchsorted(self.ends, low + _SPAN, "right")))
                own = self.data[low : self.ends[end - 1]].astype(np.uint64) + np.uint64(1)
                held = self._tables(len(own))
                sums = np.zeros(len(own) + 1, np.uint64)
                np.cumsum(own * held[0][: len(own)], out=sums[1:])
                a, b = self.starts[at:end] - low, self.ends[at:end] - low
                out[at:end] = (sums[b] - sums[a]) * held[1][a] + (b - a).astype(np.uint64)
                at = end
        return mixed(out)

    _held: tuple | None = None

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self._held is None or len(self._held[0]) < n:
            self._held = _powers(_BASE, max(n, _SPAN)), _powers(pow(_BASE, -1, 1 << 64), max(n, _SPAN))
        return self._held

    def left(self) -> np.ndarray:
        """Words from each word to its text's end, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words of each text by single spaces, and where each starts and ends there; texts lie one behind the other."""
        keep = ~_WHITE[self.data] | self._white_after
        text = np.where(_WHITE[self.data], np.uint8(32), self.data)[keep].tobytes()
        starts = (np.cumsum(keep) - 1)[self.starts]
        return text, starts, starts + (self.ends - self.starts)


def shingle_set(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; with fewer words, the whole sequence as one; empty without words."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens)
    if len(tokens) < n:
        return mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64))
    return np.unique(gram_hashes(h, n))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array a row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def slices(batches, column: int = 1, most: int = 4 << 20):
    """Record batches cut to at most about ``most`` bytes of text each, so that work arrays stay small."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


#: Edges that a task of a round takes.
TASK_EDGES = 1 << 16


def components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node that it reaches.

    Labels take the least of the neighbours' and then their label's label, until none changes. Each round pre-aggregates before it shuffles, and has as many tasks as its edges ask for: a task of few edges still leaves its files and log behind in every stage of every round.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a is not null and b is not null and a <> b").distinct())
    tasks = min(partitions(both.sparkSession), 1 + both.count() // task_edges)
    both = both.coalesce(tasks)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")).coalesce(tasks))
    for _ in range(rounds):
        met = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component").coalesce(tasks)
        near = met.groupBy("node").agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new")).coalesce(tasks)
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        after = checkpointed(least.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component")).coalesce(tasks))
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


#: Bits of a filter over ids: 4 MB whatever the data; as it fills up, it only lets more pass to the join that follows it.
FILTER_BITS, FILTER_ROW = 1 << 25, 1 << 13


def id_place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of the places of ``ids`` (one column, doc_id), built a row at a time by the executors."""

    def row(key, rows):
        bits = np.zeros(FILTER_ROW, np.uint8)
        bits[rows.column("place").to_numpy() % FILTER_ROW] = 1
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    places = ids.select(id_place(F.col("doc_id")).alias("place")).distinct().select(F.floor(F.col("place") / FILTER_ROW).alias("row"), "place")
    table = np.zeros((FILTER_BITS // FILTER_ROW, FILTER_ROW // 8), np.uint8)
    for r in places.groupBy("row").applyInArrow(row, "row bigint, bits binary").collect():  # 4 MB in one job, not a job a partition
        table[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def passing(batch: pa.RecordBatch, table: np.ndarray, column: int) -> pa.RecordBatch:
    """The rows of a batch whose place, in ``column``, is set in the filter."""
    at = batch.column(column).to_numpy()
    return batch.filter(pa.array((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
