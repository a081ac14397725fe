"""Token ids in files of fixed-width packed blocks.

A file table has one row a block: ``shard`` and ``block`` order the blocks, ``first`` is the place of the block's first id within its shard, ``ends`` are the places in the block where its documents end, and ``packed`` holds each id in the least bits that the vocabulary needs, most significant bit first. A block's ids unpack in a few numpy operations; any id is found from its block's offset and its place times the width. The container is Parquet, so that writes are committed as Spark's are and any store that Spark reaches can hold them.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, slices

#: Ids in a block, about; a document is never cut, so one long document is one longer block.
BLOCK_IDS = 1 << 12
#: Words whose ids a worker remembers, at most.
REMEMBERED = 1_000_000
FILE_SCHEMA = "shard int, block int, first bigint, n_ids int, width int, ids array<bigint>, ends array<int>, packed binary"


def width_of(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width % 8 == 0 and width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, n: int, width: int, start: int = 0) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a block, read without what lies before them."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(data, f">u{size}", n, start * size).astype(np.uint32)
    low, high = start * width, (start + n) * width
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[low // 8 : -(-high // 8)])[low % 8 : low % 8 + n * width]
    return (bits.reshape(n, width).astype(np.uint32) << np.arange(width - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32) if n else np.empty(0, np.uint32)


#: White space that a fast split at single spaces does not look at more closely.
_RARE_SPACE = tuple("\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_SPACES = ("  ", *(x for c in "\t\n\v\f\r" for x in (f" {c}", f"{c} ")))
#: Letters up to here are letters in every Unicode version, so that the library's pre-tokenizer and str.isalpha agree.
_OLD = "\u024f"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def unsure(text: str) -> bool:
    """A space is a sure cut of byte-level BPE only between two characters that are not white space."""
    return text[:1] in ("", " ") or text[-1] == " " or any(x in text for x in _SPACES) or any(x in text for x in (_RARE_SPACE[:4] if text.isascii() else _RARE_SPACE))


class Words(dict):
    """Ids, as bytes, of words that follow ``lead`` (a space, or nothing); what is missing is encoded once and remembered.

    Byte-level BPE looks at letters, marks and line ends apart, so a word of letters with ASCII marks behind it, or with one line end inside, is put together from parts; any other word goes to the library as it stands.
    """

    def __init__(self, encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        out = self.found(word)
        if len(self) < REMEMBERED:  # what came first stays: it holds the frequent words
            self[word] = out
        return out

    def found(self, word: str) -> bytes:
        if word.isalpha():
            return self.encoder.piece(self.lead + word) if word.isascii() or max(word) <= _OLD else self.encoder.whole(self.lead + word)
        head = word.rstrip(_MARKS)
        if head.isalpha():
            return self[head] + self.encoder.bare[word[len(head) :]]
        if "\n" in word:
            first, _, rest = word.partition("\n")
            if first and rest and not first[-1].isspace() and not rest[0].isspace():
                return self[first] + self.encoder.line_end + self.encoder.bare[rest]
        return self.encoder.whole(self.lead + word)


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each word once where its tokenizer is plain byte-level BPE."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's other core is another task's
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made["pre_tokenizer"] or {}
        self.plain = made["normalizer"] is None and made["model"].get("type", "BPE") == "BPE" and not made["model"].get("dropout") and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        self.added = [t["content"] for t in made["added_tokens"]]
        # Byte-level BPE shows every byte as a printable character: those that are not printable come after the others.
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.line_end = self.whole("\n")
        self.words, self.bare = Words(self, " "), Words(self, "")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece."""
        known = "\u0120" + text[1:] if text.isascii() and text[0] == " " else text.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(known)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.plain or unsure(text) or any(a in text for a in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.bare[first] + b"".join(map(self.words.__getitem__, rest))

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The encoder that this worker process has made for an earlier task, or a new one."""
        import tokenizers

        held = vars(tokenizers).setdefault("_encoders_by_path", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]


def _encoder(path: str, end_id: int, width: int):
    def run(batches):
        from pyspark import TaskContext
        encode = Encoder.of_worker(path)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held, end = 0, int(end_id).to_bytes(4, "little")

        def full():
            nonlocal block, first, ids, docs, held
            flat = np.concatenate(ids)
            ends = np.cumsum([len(x) for x in ids]).tolist()
            kinds = {"shard": pa.int32(), "block": pa.int32(), "first": pa.int64(), "n_ids": pa.int32(), "width": pa.int32(), "ids": pa.list_(pa.int64()), "ends": pa.list_(pa.int32()), "packed": pa.binary()}
            values = (shard, block, first, len(flat), width, docs, ends, pack(flat, width))
            row = pa.RecordBatch.from_pydict({n: pa.array([v], k) for (n, k), v in zip(kinds.items(), values)})
            block, first, ids, docs, held = block + 1, first + len(flat), [], [], 0
            return row

        for b in slices(batches, 1, 1 << 20):
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(np.frombuffer(encode(t or "") + end, "<u4"))
                docs.append(doc)
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield full()
        if ids:
            yield full()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int = 50257, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, in ascending id order, each document closed by ``end_id``.

    A null text is the empty text and gives the end alone; a null id comes first; rows of one id follow each other in the order of their texts. An empty table writes a table without blocks. Strings of special tokens in a text become those tokens, as in the library's plain encoding. The range exchange moves each text once; the tokenizer runs once a text, on one thread a task.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions(spark)
    ordered = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encoder(tokenizer, end_id, max(width_of(vocabulary), width_of(end_id + 1))), FILE_SCHEMA).write.parquet(path)


#: Place of ``packed`` in what read_blocks gives: the key of its join comes first, then the rest of the file's columns.
PACKED = 7


def _reader(batches):
    for b in slices(batches, PACKED):
        for base, first, width, ids, ends, packed in zip(*(b.column(k).to_pylist() for k in ("base", "first", "width", "ids", "ends", "packed"))):
            flat = unpack(packed, ends[-1], width).astype("<u4")
            starts = [0, *ends[:-1]]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array([base + first + s for s in starts], pa.int64()), "n_tokens": pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), "ids_crc32": pa.array([zlib.crc32(flat[s:e].tobytes()) for s, e in zip(starts, ends)], pa.int64())})


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file table, each with ``base``: the ids in all earlier shards (one row a shard goes to the driver's plan)."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    bases, base = [], 0
    for r in totals:
        bases.append((r["shard"], base))
        base += r["n"]
    return blocks.join(F.broadcast(spark.createDataFrame(bases, "shard int, base bigint")), "shard")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return read_blocks(spark, path).mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(place, id) of ``n`` ids from global place ``start`` on: only the blocks that have them are read, and of those only their part is unpacked."""

    def cut(batches):
        for b in batches:
            for at, count, width, packed in zip(*(b.column(k).to_pylist() for k in ("at", "n_ids", "width", "packed"))):
                low, high = max(start - at, 0), min(start + n - at, count)
                yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(at + low, at + high)), "id": pa.array(unpack(packed, high - low, width, low).astype(np.int64))})

    at = F.col("base") + F.col("first")
    return read_blocks(spark, path).withColumn("at", at).where((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start)).mapInArrow(cut, "place bigint, id bigint")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
