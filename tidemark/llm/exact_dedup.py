"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its own bytes says so, each chunk is known by a 128-bit hash, and a text becomes its ordered list of chunk identifiers. Chunks are deduplicated once over the whole corpus and an identifier counts as verified only if no second content has its hash; contents that do share a hash get an identifier of their own each. After that only recipes move, never texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_WINDOW = 16  # bytes that the rolling hash sees; below the least chunk, so no cut depends on what precedes the text
_RNG = np.random.default_rng(20240501)
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
LEAST, MEAN, MOST = 512, 4096, 32768


def cuts(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + 1
    ends, start = [], 0
    while n - start > least:
        at = np.searchsorted(marks, start + least)
        end = min(int(marks[at]) if at < len(marks) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _hash(chunk: bytes, bits: int) -> bytes:
    h = xxhash.xxh3_128_digest(chunk)
    return h if bits >= 128 else (int.from_bytes(h, "big") % (1 << bits)).to_bytes(16, "big")


def _chunk_rows(bits: int):
    """(hash, chunk) of every chunk; one that a slice of the batch has given already is left out."""

    def run(batches):
        for b in slices(batches, 0):
            ids, chunks = [], []
            seen: dict[bytes, bytes] = {}
            for t in b.column(0).to_pylist():
                data = (t or b"").lower()
                at = 0
                for end in cuts(data):
                    key = _hash(chunk := data[at:end], bits)
                    if seen.get(key) != chunk:
                        seen[key] = chunk
                        ids.append(key)
                        chunks.append(chunk)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(chunks, pa.binary())], ["h", "chunk"])

    return run


def _recipe_rows(bits: int):
    def run(batches):
        for b in slices(batches):
            recipes, shas = [], []
            for t in b.column(1).to_pylist():
                data, at, out = (t or b"").lower(), 0, []
                for end in cuts(data):
                    out.append(_hash(data[at:end], bits))
                    at = end
                recipes.append(b"".join(out))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(recipes, pa.binary()), pa.array(shas, pa.string()), *b.columns[2:]], ["doc_id", "recipe", "text_sha256", "row_key"][: b.num_columns + 1])

    return run


def _entry_rows(bits: int):
    """(row key, position, hash, chunk) of every chunk."""

    def run(batches):
        for b in slices(batches):
            rows: list[tuple] = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, at = (t or b"").lower(), 0
                for k, end in enumerate(cuts(data)):
                    rows.append((key, k, _hash(data[at:end], bits), data[at:end]))
                    at = end
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["row_key", "k", "h", "chunk"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row: texts are equal when identical after lower-casing A-Z.

    The largest id of equal texts stays. A null text is the empty text; rows that repeat an id with an equal text are one document and share its verdict; rows with a null id stay only where no equal text has an id. Empty tables give no rows; other columns are ignored. ``hash_bits`` below 128 exists to test clashing hashes.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    chunks = src.select("text").mapInArrow(_chunk_rows(hash_bits), "h binary, chunk binary").distinct()
    clashing = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    recipes = src.mapInArrow(_recipe_rows(hash_bits), "doc_id bigint, recipe binary, text_sha256 string")
    if not clashing.isEmpty():
        recipes = _refined(src, clashing, hash_bits)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A second key makes the join shuffle both sides for itself, so that a large group's partition can be split.
    spread = F.xxhash64("recipe")
    return recipes.withColumn("spread", spread).join(groups.withColumn("spread", spread), ["recipe", "spread"]).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def _refined(src: DataFrame, clashing: DataFrame, bits: int) -> DataFrame:
    """Recipes in which a hash shared by different contents is told apart by the content's own sha256."""
    src = src.withColumn("row_key", F.xxhash64("doc_id", "text"))
    recipes = src.mapInArrow(_recipe_rows(bits), "doc_id bigint, recipe binary, text_sha256 string, row_key bigint")
    entries = src.select("row_key", "text").mapInArrow(_entry_rows(bits), "row_key bigint, k int, h binary, chunk binary")
    shared = clashing.withColumn("clash", F.lit(True))
    ids = entries.join(shared, "h", "left").select("row_key", "k", F.when(F.col("clash"), F.concat("h", F.unhex(F.sha2("chunk", 256)))).otherwise(F.col("h")).alias("id"))
    per_row = ids.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("k", "id"))).alias("e")).select("row_key", F.expr("unhex(array_join(transform(e, x -> hex(x.id)), ''))").alias("full"))
    return recipes.join(per_row, "row_key", "left").select("doc_id", F.coalesce("full", F.lit(b"")).alias("recipe"), "text_sha256")


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of ``docs`` with equal texts one: that of the largest id, of rows that share the id too the least; a row without an id only where no equal text has one.

    Rows whose id no other row has are picked by id alone, so that their texts are not hashed again; the others by id and text.
    """
    verdicts = exact_dedup(docs, id_col, text_col)
    ids = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    key = F.col(id_col).cast("bigint")
    own = [F.col(c) for c in docs.columns]
    single = ids.where("doc_id is not null and n = 1 and kept").select(F.col("doc_id").alias("__id"))
    plain = docs.join(single, key == F.col("__id"), "left_semi")
    shared = ids.where("doc_id is null or n > 1").select(F.col("doc_id").alias("__id"))
    if shared.isEmpty():
        return plain
    low = F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    kept = verdicts.where("kept").select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__text")).distinct()
    odd = docs.withColumn("__sha", low).join(shared, key.eqNullSafe(F.col("__id")), "left_semi").join(kept, key.eqNullSafe(F.col("__kept")) & (F.col("__sha") == F.col("__text")))
    return plain.unionByName(odd.groupBy("__kept", "__sha").agg(F.min(F.struct(*own)).alias("__row")).select("__row.*"))


ORACLE = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as n from documents),
g as (select n, max(doc_id) as keep_id, count(*) as group_size from t group by n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.n) as text_sha256 from t join g on t.n = g.n
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
