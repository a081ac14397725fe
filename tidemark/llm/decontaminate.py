"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity says little and containment is searched for: the share of an item's shingles that a document has. Items are partitioned by the size of their shingle set. In a partition every item is sketched by the least values of one hash over its shingles, as many as make it certain that a document with the containment asked for has at least one of them: ``size - ceil(threshold * size) + 1``. Documents are probed with all their shingle hashes, partition by partition, and a partition is skipped where the document has fewer shingles than its least item needs. The search so has full recall, which banded sketches of long documents have not. Each candidate is verified by comparing the shingles' own words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, once, slices, word_hashes, words

THRESHOLD = 0.8
SHINGLE = 5
#: Text of test items that is searched for at once; more of it is taken in blocks.
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint, containment double"


def shingles(tokens: list[bytes], n: int = SHINGLE) -> list[bytes]:
    """The n-word shingles in order; with fewer words, the whole sequence as one."""
    return [b" ".join(tokens[k : k + n]) for k in range(len(tokens) - n + 1)] if len(tokens) >= n else [b" ".join(tokens)] if tokens else []


def _hashes(tokens: list[bytes], n: int) -> np.ndarray:
    if not tokens:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens)
    if len(tokens) >= n:
        return gram_hashes(h, n)
    return np.concatenate([gram_hashes(h, len(tokens)) ^ np.uint64(len(tokens))])


class Index:
    """Sketches of one block of test items, by power-of-two sizes of their shingle sets."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float, n: int):
        self.n, self.threshold = n, threshold
        self.items: list[tuple[int, frozenset[bytes], int]] = []
        parts: dict[int, list[tuple[int, int]]] = {}
        self.least: dict[int, int] = {}
        short: set[int] = set()
        for item_id, text in items:
            tokens = words(text)
            own = frozenset(shingles(tokens, n))
            if not own:
                continue
            need = math.ceil(threshold * len(own) - 1e-9)
            sketch = np.unique(_hashes(tokens, n))[: len(own) - need + 1]
            part = len(own).bit_length()
            parts.setdefault(part, []).extend((int(h), len(self.items)) for h in sketch)
            self.least[part] = min(self.least.get(part, need), need)
            if len(tokens) < n:
                short.add(len(tokens))
            self.items.append((item_id, own, need))
        self.short = sorted(short)
        self.parts = {}
        for part, pairs in parts.items():
            pairs.sort()
            self.parts[part] = (np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs]))

    def search(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(place of item, its shingles, shared ones) for the items that the text contains."""
        tokens = words(text)
        if not tokens:
            return []
        own = word_hashes(tokens)
        h = np.concatenate([gram_hashes(own, self.n), *(gram_hashes(own, k) ^ np.uint64(k) for k in self.short)])  # an item of fewer words is one shingle of that length
        found: set[int] = set()
        for part, (keys, of) in self.parts.items():
            if len(h) >= self.least[part]:
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = np.unique(h[keys[at] == h])
                for a, b in zip(np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")):
                    found.update(of[a:b].tolist())
        out = []
        if found:
            held = {b" ".join(tokens[i : i + k]) for k in (self.n, *self.short) for i in range(len(tokens) - k + 1)}
            for k in sorted(found):
                _, item, need = self.items[k]
                shared = len(item & held)
                if shared >= need:
                    out.append((k, len(item), shared))
        return out


def _searcher(items, threshold: float, n: int):
    def run(batches):
        index = once(items, lambda own: Index(own, threshold, n))
        for b in slices(batches):
            rows = [(d, index.items[k][0], size, shared, shared / size) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, size, shared in index.search(t)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for every document that has at least ``threshold`` of an item's shingles.

    Shingles are of lower-cased words (A-Z); an item of fewer words than a shingle is one shingle and is found where those words follow each other. Items or documents without words, or null, match nothing; repeated rows on either side give a row each; ids may be null. The items are sent to the workers in blocks of at most ``block_bytes`` of text, each searched for in one scan of the documents.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for k in range(blocks):
        own = [(r["item_id"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        found = src.mapInArrow(_searcher(spark.sparkContext.broadcast(own), threshold, shingle), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id has no contained item; rows with a null id are judged by themselves through their text."""
    bad = contained_items(docs.where("doc_id is not null"), benchmark, threshold, shingle).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(bad, "doc_id", "left_anti").select(docs.columns)
    if docs.where("doc_id is null").isEmpty():
        return named
    loose = docs.where("doc_id is null").withColumn("__key", F.xxhash64("text"))
    own = contained_items(loose.drop("doc_id").withColumnRenamed("__key", "doc_id"), benchmark, threshold, shingle).select(F.col("doc_id").alias("__key")).distinct()
    return named.unionByName(loose.join(own, "__key", "left_anti").select(docs.columns))


ORACLE = r"""
with low as (select doc_id as id, 0 as side, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where text is not null
  union all select item_id, 1, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark where text is not null),
i as (select id, w, least(len(w), 5) as k from low where side = 1 and len(w) > 0),
q as (select distinct id as item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) as g from i),
n as (select item_id, count(*) as n from q group by item_id),
d as (select distinct id as doc_id, s.k, unnest(list_transform(range(1, len(w) - s.k + 2), lambda j: array_to_string(w[j:j + s.k - 1], ' '))) as g from low, (select distinct k from i) s where side = 0 and len(w) >= s.k),
m as (select d.doc_id, q.item_id, count(*) as c from q join d on q.g = d.g and q.k = d.k group by d.doc_id, q.item_id)
select doc_id, m.item_id, n.n as n_item_shingles, c as n_shared, c::double / n.n as containment from m join n on m.item_id = n.item_id where c >= ceil(0.8 * n.n - 1e-9)
"""


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
