"""Phrase collocations from vertical positional lists.

Texts are cut into blocks of words with positions. A phrase has, in each block, the list of positions where it starts; phrases of one more word come from merging that list with the postings of the words that follow. A block sends a phrase's list length once, keys are summed by buckets of their hash, and the sums go back to the blocks, which keep the lists of frequent phrases only. So what moves is one number a phrase and block, and no task holds more than a block or a bucket.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, mixed, partitions, slices, written

#: Words of a block, about; a longer text has a block of its own.
BLOCK_WORDS = 1 << 20
GAP = b"\xff"  # stands between pieces; no UTF-8 text has it
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

BLOCKS = "block bigint, langs array<string>, lang_of binary, words binary, counts binary, codes binary"
KEYS = "block bigint, bucket int, keys binary, counts binary"
SUMS = "block bigint, level int, bucket int, sums binary, owned binary"
PHRASES = "lang string, phrase binary, words int, a bigint, k int, l bigint, r bigint, score bigint, dropped boolean"


def _packed(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(cell: bytes) -> bytes:
    return pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), "zstd", asbytes=True)


def _array(cell: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_unpacked(cell), kind)


class _Codes(dict):
    """Numbers of words, given as they come; 0 is the gap."""

    def __init__(self, names: list):
        self.names = names

    def __missing__(self, word):
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with a gap between pieces."""
    return text.translate(_TO).replace(b"\n", b" \xff ").split()


def _block(block: int, langs: list, lang_of: np.ndarray, words: list[bytes], counts: np.ndarray, codes: np.ndarray) -> pa.Table:
    """One block: its languages, its words with their language and count (of the block, later of all), and its positions' words from 1, 0 where there is none."""
    return pa.table({
        "block": pa.array([block], pa.int64()), "langs": pa.array([langs], pa.list_(pa.string())), "lang_of": pa.array([_packed(lang_of.astype("<i4"))], pa.binary()), "words": pa.array([_packed(b" ".join(words))], pa.binary()),
        "counts": pa.array([_packed(counts.astype("<i8"))], pa.binary()), "codes": pa.array([_packed(codes.astype("<i4"))], pa.binary()),
    })


def _blocks(block_words: int):
    def run(batches):
        names: list = [None]
        lang_of: list[int] = [0]
        codes: dict[str, _Codes] = {}
        held: list[np.ndarray] = []
        total = 0

        def flush():
            at = np.concatenate(held)
            yield from _block(uuid.uuid4().int >> 65, list(codes), np.array(lang_of[1:]), names[1:], np.bincount(at, minlength=len(names))[1:], at).to_batches()

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                own = codes.get(lang)
                if own is None:
                    own = codes[lang] = _Codes(names)
                    own[GAP] = 0
                    own.number = len(codes) - 1
                found = tokens(text)
                at = np.fromiter(map(own.__getitem__, found), "<i4", len(found))
                lang_of += [own.number] * (len(names) - len(lang_of))
                held += [at, np.zeros(1, "<i4")]
                total += len(at) + 1
                if total >= block_words:
                    yield from flush()
                    names, lang_of, codes, held, total = [None], [0], {}, [], 0
        if total:
            yield from flush()

    return run


def _words(row: dict) -> list[bytes]:
    return _unpacked(row["words"]).split(b" ") if len(row["words"]) > 8 and int.from_bytes(row["words"][:8], "little") else []


def _word_keys(row: dict) -> np.ndarray:
    """128 bits of each word and its language."""
    seeds = [xxhash.xxh3_64_intdigest(lang.encode()) for lang in row["langs"]]
    digests = b"".join(xxhash.xxh3_128_digest(w, seeds[g]) for g, w in zip(_array(row["lang_of"], "<i4").tolist(), _words(row)))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


class Candidates:
    """A block's candidates of one level, in the order of their buckets, in which their sums come back.

    The first half of a key's 128 bits is its bucket, the second half tells it from others of the bucket.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, buckets: int):
        bucket = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.ends = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        self.keys, self.counts = keys, counts

    def rows(self, block: int) -> pa.Table:
        keys, counts = self.keys[self.order, 1], self.counts[self.order].astype("<i8")
        full = np.flatnonzero(np.diff(self.ends))
        cut = [slice(self.ends[b], self.ends[b + 1]) for b in full]
        return pa.table({
            "block": pa.array(np.full(len(full), block), pa.int64()), "bucket": pa.array(full, pa.int32()),
            "keys": pa.array([keys[c].tobytes() for c in cut], pa.binary()), "counts": pa.array([_packed(counts[c]) for c in cut], pa.binary()),
        })

    def answered(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(sums, owned) of each candidate, from the rows of its buckets in order."""
        sums, owned = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), bool)
        if answers:
            parts = [_array(r["sums"], "<i8") for r in answers]
            sums[self.order] = np.concatenate(parts)
            owned[self.order] = np.concatenate([np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=len(p)) for r, p in zip(answers, parts)])
        return sums, owned


class Lists:
    """One block's lists of frequent phrases, level by level, from a block that has frequent words only.

    ``at[m]`` has for each position the number of the frequent phrase of m words that starts there, or -1; ``sums[m]``, ``owned[m]`` and ``first[m]`` have by number the phrase's frequency, whether this block is the one to report it, and a place of it.
    """

    def __init__(self, row: dict, buckets: int):
        self.row, self.buckets = row, buckets
        word = np.append(_array(row["codes"], "<i4") - 1, np.int32(-1))
        self.at, self.sums, self.owned, self.first = [None, word], [None, _array(row["counts"], "<i8")], [None, None], [None, None]
        self.word_keys = self.kept_keys = _word_keys(row)

    def extend(self) -> None:
        """Candidates of one more word: the list of a frequent phrase, merged with the postings of the frequent word behind it where the phrase one word on is frequent too."""
        m = len(self.at) - 1
        at, word = self.at[m], self.at[1]
        places = np.flatnonzero(at >= 0)
        places = places[places + m < len(at)]
        places = places[(at[places + 1] >= 0) & (word[places + m] >= 0)]
        n_words = max(1, len(self.sums[1]))
        distinct, first, numbers, counts = np.unique(at[places].astype(np.int64) * n_words + word[places + m], return_index=True, return_inverse=True, return_counts=True)
        with np.errstate(over="ignore"):
            keys = mixed(self.kept_keys[distinct // n_words] * _MULT + self.word_keys[distinct % n_words])
        self.places, self.numbers, self.places_of = places, numbers, places[first]
        self.candidates = Candidates(keys, counts, self.buckets)

    def keep(self, answers: list[dict]) -> None:
        """The candidates that are frequent."""
        sums, owned = self.candidates.answered(answers)
        frequent = sums > 0
        new = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        at = np.full(len(self.at[1]), -1, np.int32)
        at[self.places] = new[self.numbers]
        self.at.append(at)
        self.sums.append(sums[frequent])
        self.owned.append(owned[frequent])
        self.first.append(self.places_of[frequent])
        self.kept_keys = self.candidates.keys[frequent]

    def phrases(self, least_words: int, share: int):
        """The phrases that this block reports: (lang, phrase, words, a, k, l, r, score, False), and (lang, part, ..., True) for parts of theirs that stand in them ``share`` per cent of their times."""
        words, langs, lang_of, most = _words(self.row), self.row["langs"], _array(self.row["lang_of"], "<i4"), len(self.at) - 1
        for m in range(least_words, most + 1):
            for number in np.flatnonzero(self.owned[m]):
                p = int(self.first[m][number])
                a, codes = int(self.sums[m][number]), self.at[1][p : p + m]
                text, lang = [words[c] for c in codes], langs[lang_of[codes[0]]]
                cut = None
                for k in range(1, m):
                    left, right = int(self.sums[k][self.at[k][p]]), int(self.sums[m - k][self.at[m - k][p + k]])
                    score = 2_000_000 * a // (left + right)
                    if cut is None or score < cut[3]:
                        cut = (k, left, right, score)
                yield lang, b" ".join(text), m, a, *cut, False
                for j in range(least_words, m):
                    for o in range(m - j + 1):
                        if 100 * a >= share * int(self.sums[j][self.at[j][p + o]]):
                            yield lang, b" ".join(text[o : o + j]), j, None, None, None, None, None, True


def _row(blocks: pa.Table) -> dict:
    return blocks.to_pylist()[0]


def _answers(sums: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list] = {}
    for r in sums.sort_by([("level", "ascending"), ("bucket", "ascending")]).to_pylist():
        out.setdefault(r["level"], []).append(r)
    return out


def _built(blocks: pa.Table, sums: pa.Table, buckets: int, upto: int) -> Lists:
    """A block's lists of the frequent phrases to ``upto`` words."""
    lists, answers = Lists(_row(blocks), buckets), _answers(sums)
    for level in range(2, upto + 1):
        lists.extend()
        lists.keep(answers.get(level, []))
    return lists


def _frequent_words(buckets: int):
    """The block with its frequent words only, their counts those of all blocks."""

    def run(key, blocks: pa.Table, sums: pa.Table) -> pa.Table:
        row, words = _row(blocks), _words(_row(blocks))
        total, _ = Candidates(_word_keys(row), _array(row["counts"], "<i8"), buckets).answered(_answers(sums).get(1, []))
        kept = np.flatnonzero(total)
        new = np.zeros(len(words) + 1, np.int32)
        new[kept + 1] = np.arange(1, len(kept) + 1)
        return _block(row["block"], row["langs"], _array(row["lang_of"], "<i4")[kept], [words[k] for k in kept], total[kept], new[_array(row["codes"], "<i4")])

    return run


def _summed(level: int, least: int):
    """The sums of a bucket's keys over all blocks, 0 below ``least``; of the blocks of a key the least owns it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        parts = [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]
        counts = np.concatenate([_array(c, "<i8") for c in rows.column("counts").to_pylist()])
        _, first, number = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, number, counts)
        totals[totals < least] = 0
        sums, owned = totals[number], np.zeros(len(counts), bool)
        owned[first] = totals > 0
        ends = np.cumsum([0, *map(len, parts)])
        cut = [slice(a, b) for a, b in zip(ends, ends[1:])]
        return pa.table({
            "block": rows.column("block"), "level": pa.array([level] * len(cut), pa.int32()), "bucket": rows.column("bucket"),
            "sums": pa.array([_packed(sums[c]) for c in cut], pa.binary()), "owned": pa.array([np.packbits(owned[c]).tobytes() for c in cut], pa.binary()),
        })

    return run


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, share: int = 80, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, phrase, words, a, k, l, r, score, dropped) and word totals (lang, n).

    Every phrase of 2 to ``longest`` words with at least ``least`` occurrences has one row with ``dropped`` false; rows with ``dropped`` true name phrases that a longer candidate contains at least ``share`` per cent of the times. Everything is counted over whole texts, by language; a null language is ``und``. Null and empty texts have no words, repeated rows count each, empty tables give no rows, and other columns are ignored. A very long text makes a long block.
    """
    buckets = 2 * partitions(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def words(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from Candidates(_word_keys(row), _array(row["counts"], "<i8"), buckets).rows(row["block"]).to_batches()

    def counted(batches):
        for b in batches:
            for row in b.to_pylist():
                n = np.bincount(_array(row["lang_of"], "<i4"), _array(row["counts"], "<i8"), len(row["langs"]))
                yield pa.RecordBatch.from_pydict({"lang": pa.array(row["langs"], pa.string()), "n": pa.array(n.astype(np.int64))})

    def pairs(batches):
        for b in batches:
            for row in b.to_pylist():
                lists = Lists(row, buckets)
                lists.extend()
                yield from lists.candidates.rows(row["block"]).to_batches()

    def longer(level):
        def run(key, blocks, sums):
            lists = _built(blocks, sums, buckets, level - 1)
            lists.extend()
            return lists.candidates.rows(key[0].as_py())

        return run

    def reported(key, blocks, sums):
        out = list(_built(blocks, sums, buckets, longest).phrases(2, share))
        cols = list(zip(*out)) if out else [[]] * 9
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=[x.split()[0] for x in PHRASES.split(", ")])

    def sums_of(keys, level):
        return written(keys.groupBy("bucket").applyInArrow(_summed(level, least), SUMS), f"phrase-sums-{level}")

    all_words = written(src.mapInArrow(_blocks(block_words), BLOCKS), "phrase-words")
    totals = written(all_words.select("langs", "lang_of", "counts").mapInArrow(counted, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    counts = sums_of(all_words.select("block", "langs", "lang_of", "words", "counts").mapInArrow(words, KEYS), 1)
    blocks = written(all_words.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_frequent_words(buckets), BLOCKS), "phrase-blocks")
    forget(all_words)
    forget(counts)
    tables = [sums_of(blocks.mapInArrow(pairs, KEYS), 2)]
    for level in range(3, longest + 1):
        sums = reduce(DataFrame.unionByName, tables)
        tables.append(sums_of(blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(longer(level), KEYS), level))
    sums = reduce(DataFrame.unionByName, tables)
    found = written(blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(reported, PHRASES), "phrases")
    for table in (blocks, *tables):
        forget(table)
    return found.withColumn("phrase", F.col("phrase").cast("string")), totals


def _first(rows: DataFrame, key: str, order: list[Column], most: int, spread: Column) -> DataFrame:
    """The first ``most`` rows of each key with their ``rank``: first in many parts of a key, then in a few, then in all."""
    for parts in (partitions(rows.sparkSession), 16, 1):
        w = W.partitionBy(key, F.pmod(spread, F.lit(parts))).orderBy(*order) if parts > 1 else W.partitionBy(key).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)
    return rows


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, share: int = 80, most: int = 2000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words, k): each language's first phrases by score, then frequency, then wording.

    ``score`` is floor(2000000 a / (l + r)) at the cut (after k words) where it is least. Phrases that a longer candidate contains at least ``share`` per cent of the times are left out. See ``frequent_phrases`` for nulls and other cases.
    """
    found, totals = frequent_phrases(docs, lang_col, text_col, least, longest, share, block_words)
    gone = found.where("dropped").select("lang", "phrase")
    kept = found.where("not dropped").join(gone, ["lang", "phrase"], "left_anti")
    best = _first(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, F.xxhash64("phrase"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "k")


ORACLE = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, m, ws[i:i + m - 1] as ph from w, (select unnest([1, 2, 3, 4]) as m), unnest(range(1, greatest(len(ws) - m + 2, 1)::bigint)) as u(i)),
f as (select lang, m, ph, count(*) as a from g group by lang, m, ph having count(*) >= 30),
t as (select lang, count(*) as n from g where m = 1 group by lang),
c as (select f.lang, f.m, f.ph, f.a, k, x.a as l, y.a as r, (2000000 * f.a::hugeint // (x.a + y.a))::bigint as score from f, unnest(range(1, f.m)) as u(k)
    join f x on x.lang = f.lang and x.ph = f.ph[1:k] join f y on y.lang = f.lang and y.ph = f.ph[k + 1:f.m] where f.m > 1),
b as (select lang, m, ph, a, arg_min({'k': k, 'l': l, 'r': r, 'score': score}, (score, k)) as s from c group by lang, m, ph, a),
d as (select distinct q.lang, q.ph[o:o + j - 1] as ph, q.a from b q, unnest([2, 3]) as v(j), unnest(range(1, 4)) as u(o) where j < q.m and o + j - 1 <= q.m),
e as (select b.* from b where not exists (select 1 from d where d.lang = b.lang and d.ph = b.ph and 100 * d.a >= 80 * b.a))
select lang, row_number() over (partition by lang order by s.score desc, a desc, array_to_string(ph, ' ')) as rank, array_to_string(ph, ' ') as phrase, a, s.l as l, s.r as r, n, s.score as score, m::int as words, s.k::int as k
from e join t using (lang) qualify rank <= 2000
"""


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
