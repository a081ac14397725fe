"""Substring dedup over prefix-partitioned suffix trees.

Every word starts a suffix, and a window of words that recurs is a node of the suffix tree at that depth. Three steps keep the work in proportion to what recurs.

Of each window only the n-gram of least hash within it, its seed, can open a group, and windows that are equal have equal seeds; so a seed that one document alone has rules out all its windows. What is left is grouped by the seed, each place with the words around it that its windows cover, its region. A group is one subtree: the suffixes of its distinct regions are sorted, neighbours' common words are counted, and the runs that share at least a window are the subtree's internal nodes of that depth, each with the least document below it. Where a seed has more places than a group may hold, its prefix is lengthened to the whole window, at which depth a node is one key and partial aggregation finds its least document for any number of places.

Texts are moved once, compressed, to the places found in them and again, by the same exchange, to the windows that go; the seeds that recur are found and fetched by keys alone. A text that equals an earlier document's goes as a whole and has no part in the groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BITS, Tokens, gram_hashes, lists, partitions, slices, written

WINDOW, SEED = 13, 5
#: Places under one seed, at most, that are made a subtree in memory.
GROUP_SUFFIXES = 32_768


def owners(hashes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """For each window, where the seed starts that it belongs to: the leftmost of its least n-grams."""
    span = window - seed + 1
    grams = gram_hashes(hashes, seed)
    if len(grams) < span:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def seed_size(window: int) -> int:
    """Shorter windows have shorter seeds."""
    return min(SEED, window)


def _places(tokens: Tokens, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, the seed of each, keys of all n-grams): windows are places among all words, those that stay within a text."""
    h, seed = tokens.hashes, seed_size(window)
    own = owners(h, window, seed)
    at = np.flatnonzero(tokens.left()[: len(own)] >= window)
    return at, own[at], gram_hashes(h, seed) >> np.uint64(64 - KEY_BITS)


def _seeds(window: int, placed: bool):
    """(doc_id, key) of every seed; with ``placed`` the row and the seed's place in its text too."""

    def run(batches):
        for b in slices(batches, 2, 1 << 20):
            t = Tokens(b.column(2), lower=False)
            _, own, keys = _places(t, window)
            at = own[np.flatnonzero(np.diff(own, prepend=-1))]
            text = np.searchsorted(t.first, at, "right") - 1
            cols = {"doc_id": b.column(0).take(pa.array(text)), "key": pa.array(keys[at].astype(np.int64))}
            if placed:
                cols |= {"row": b.column(1).take(pa.array(text)), "place": pa.array((at - t.first[text]).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _packed(batches):
    """Texts by zstandard: they are most of what is shuffled."""
    import zstandard

    own = zstandard.ZstdCompressor(3)
    for b in slices(batches, 2):
        packed = [own.compress(t or b"") for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "row", "packed"])


def unpacked(b: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its third column's texts."""
    import zstandard

    own = zstandard.ZstdDecompressor()
    return b.set_column(2, "text", pa.array([own.decompress(t) for t in b.column(2).to_pylist()], pa.binary()))


REGION = "prefix bigint, doc_id bigint, row bigint, first int, region binary"


def _regions(window: int):
    """The text around each recurring seed: all windows that belong to it."""

    def run(batches):
        for b in map(unpacked, slices(batches, 2, 1 << 19)):
            t = Tokens(b.column(2), lower=False)
            windows, own, keys = _places(t, window)
            found = b.column(3)
            text = np.repeat(np.arange(len(b)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = t.first[text] + found.flatten().to_numpy(zero_copy_only=False)
            lo, hi = windows[np.searchsorted(own, at, "left")], windows[np.searchsorted(own, at, "right") - 1]
            joined, starts, ends = t.joined()
            regions = [joined[x:y] for x, y in zip(starts[lo].tolist(), ends[hi + window - 1].tolist())]
            kept = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int64)), b.column(0).take(kept), b.column(1).take(kept), pa.array((lo - t.first[text]).astype(np.int32)), pa.array(regions, pa.binary())], ["prefix", "doc_id", "row", "first", "region"])

    return run


def common_words(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nodes(regions: dict[bytes, int], window: int) -> list[tuple[int, int, list[tuple[bytes, int]]]]:
    """The subtree's internal nodes of depth ``window`` or more that no other such node lies above: (words shared, least document, suffixes (region, word it starts at)).

    ``regions`` has the least document of each distinct region. A suffix shorter than a window can't reach the depth.
    """
    suffixes = sorted((tokens[k:], region, k) for region, tokens in ((r, r.split(b" ")) for r in regions) for k in range(len(tokens) - window + 1))
    out: list[tuple[int, int, list[tuple[bytes, int]]]] = []
    before: list[bytes] = []
    for tokens, region, k in suffixes:
        shared = common_words(before, tokens)
        if shared >= window:
            depth, least, below = out[-1]
            out[-1] = (min(depth, shared), min(least, regions[region]), below)
            below.append((region, k))
        else:
            out.append((len(tokens), regions[region], [(region, k)]))
        before = tokens
    return out


def subtree(rows: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(doc_id, row, first, mask) of the windows that start in an earlier document too; rows are (doc_id, row, first, region), and bit k of the mask is the window at first + k."""
    least: dict[bytes, int] = {}
    for doc, _, _, region in rows:
        if least.setdefault(region, doc) > doc:
            least[region] = doc
    if len(least) == 1:  # one region has no node but its own leaves
        ((region, low),) = least.items()
        whole = (1 << (region.count(b" ") + 2 - window)) - 1
        return [(doc, row, first, whole) for doc, row, first, _ in rows if doc > low]
    lows: dict[bytes, list[int]] = {r: [0] * (r.count(b" ") + 2 - window) for r in least}
    for _, low, below in nodes(least, window):
        for region, k in below:
            lows[region][k] = low
    out = []
    for doc, row, first, region in rows:
        mask = sum(1 << k for k, low in enumerate(lows[region]) if low < doc)
        if mask:
            out.append((doc, row, first, mask))
    return out


REPEAT = "doc_id bigint, row bigint, first int, mask bigint"


def _subtrees(window: int):
    """Rows come sorted by prefix; one prefix's rows are held at a time."""

    def run(batches):
        prefix, held, out = None, [], []

        def batch():
            cols = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "row", "first", "mask"])

        for b in batches:
            for p, *row in zip(*(b.column(k).to_pylist() for k in range(5))):
                if p != prefix:
                    if len(held) > 1:
                        out += subtree(held, window)
                    prefix, held = p, []
                held.append(tuple(row))
            if len(out) > 10_000:
                yield batch()
                out = []
        if len(held) > 1:
            out += subtree(held, window)
        yield batch()

    return run


def _paths(window: int):
    """Each window of a region as a prefix of full length, by a 128-bit hash."""

    def run(batches):
        for b in slices(batches, 4):
            rows = []
            for _, doc, row, first, region in zip(*(b.column(k).to_pylist() for k in range(5))):
                tokens = region.split(b" ")
                rows += [(xxhash.xxh3_128_digest(b" ".join(tokens[k : k + window])), doc, row, first + k) for k in range(len(tokens) - window + 1)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["path", "doc_id", "row", "first"])

    return run


def copies(named: DataFrame) -> DataFrame:
    """(doc_id, row) of the texts that an earlier document has as a whole."""
    keyed = named.select("doc_id", "row", F.sha2("text", 256).alias("sha")).withColumn("spread", F.xxhash64("sha"))
    groups = keyed.groupBy("sha", "spread").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    return keyed.join(groups, ["sha", "spread"]).where("doc_id > lo").select("doc_id", "row").distinct()


def repeats(named: DataFrame, packed: DataFrame, keys: list[str], window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(doc_id, row, first, mask): windows of ``named`` (doc_id, row, text) that start in a document of smaller id too; first is -1 where that is known of the whole text.

    ``packed`` has the same rows with compressed texts, and ``keys`` are the columns that tell rows apart.
    """
    seeds = named.mapInArrow(_seeds(window, False), "doc_id bigint, key bigint")
    counts = seeds.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    shared = written(counts.select("key", (F.col("n") > group_suffixes).alias("long")), "seeds")
    hits = named.mapInArrow(_seeds(window, True), "doc_id bigint, key bigint, row bigint, place int").join(shared, "key")
    whole = written(copies(named), "copies")

    def regions(of: DataFrame) -> DataFrame:
        # A left join and a test, as an anti-join would be pushed below the aggregate and shuffle every place.
        at = of.groupBy(*keys).agg(F.array_sort(F.collect_list("place")).alias("at")).join(whole.select(*keys, F.lit(True).alias("gone")), keys, "left").where("gone is null")
        return packed.join(at, keys).select("doc_id", "row", "packed", "at").mapInArrow(_regions(window), REGION)

    short = regions(hits.where("not long")).repartition(partitions(named.sparkSession), "prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees(window), REPEAT)
    short = short.union(whole.select("doc_id", "row", F.lit(-1), F.lit(0).cast("bigint")))
    if shared.where("long").isEmpty():
        return short
    paths = regions(hits.where("long")).mapInArrow(_paths(window), "path binary, doc_id bigint, row bigint, first int")
    least = paths.groupBy("path").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("path", F.xxhash64("path").alias("spread"), "lo")
    full = paths.withColumn("spread", F.xxhash64("path")).join(least, ["path", "spread"]).where("lo < doc_id").select("doc_id", "row", "first", F.lit(1).cast("bigint").alias("mask"))
    return short.union(full)


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text binary"


def _cut(window: int, text_out: bool):
    def run(batches):
        for b in map(unpacked, slices(batches, 2, 1 << 19)):
            t = Tokens(b.column(2), lower=False)
            edge = np.zeros(len(t.starts) + 1, np.int64)
            gone = np.zeros(len(t.starts), bool)
            firsts, masks = b.column(3), b.column(4)
            n = firsts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if n.sum():
                first, mask = (x.flatten().to_numpy(zero_copy_only=False) for x in (firsts, masks))
                text, k = np.repeat(np.arange(len(b)), n), 0
                at = t.first[text] + first
                for whole in text[(first < 0) & (t.counts[text] >= window)].tolist():
                    edge[t.first[whole]] += 1
                    edge[t.first[whole + 1]] -= 1
                while mask.any():
                    own = at[mask & 1 == 1] + k
                    np.add.at(edge, own, 1)
                    np.add.at(edge, own + window, -1)
                    mask, k = mask >> 1, k + 1
                gone = np.cumsum(edge[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False), np.minimum(t.first[:-1], len(gone)), dtype=np.int64) * (t.counts > 0)
            joined, starts, ends = t.joined()
            kept = []
            for lo, hi, out in zip(t.first[:-1].tolist(), t.first[1:].tolist(), removed.tolist()):
                if out == hi - lo:
                    kept.append(b"")
                elif not out:
                    kept.append(joined[starts[lo] : ends[hi - 1]])
                else:
                    stay = np.flatnonzero(~gone[lo:hi]) + lo
                    cut = np.flatnonzero(np.diff(stay) != 1) + 1
                    kept.append(b" ".join([joined[starts[x[0]] : ends[x[-1]]] for x in np.split(stay, cut)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept if text_out else [None] * len(kept), pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, text_out: bool = True, group_suffixes: int = GROUP_SUFFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row: words covered by a ``window`` that also starts in a document of smaller id are removed.

    Words are runs without ASCII white space, unchanged; what is kept is joined by single spaces (null with ``text_out`` off). Windows are judged on the input. A null text has no words; a row with a null id loses nothing and causes no loss; rows that repeat an id do not remove from each other; texts below a window's length stay whole; other columns are ignored; an empty table gives no rows. ``window`` is from 1 to 60 words.
    """
    if not 1 <= window <= 60:
        raise ValueError("window must be from 1 to 60 words")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # Only rows that share an id need more than the id to be told apart.
    single = src.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    src = src.select("doc_id", (F.lit(0).cast("bigint") if single else F.xxhash64("text")).alias("row"), "text")
    keys = ["doc_id"] if single else ["doc_id", "row"]
    named, loose = src.where("doc_id is not null"), src.where("doc_id is null")
    packed = named.mapInArrow(_packed, "doc_id bigint, row bigint, packed binary").where("doc_id is not null and row is not null")
    found = repeats(named, packed, keys, window, group_suffixes)
    if not single:  # rows that are equal in id and text were all found
        found = found.distinct()
    found = found.groupBy(*keys).agg(F.collect_list("first").alias("firsts"), F.collect_list("mask").alias("masks"))
    cut = packed.join(found, keys, "left").select("doc_id", "row", "packed", "firsts", "masks").mapInArrow(_cut(window, text_out), OUT)
    none = F.array().cast("array<int>").alias("firsts"), F.array().cast("array<bigint>").alias("masks")
    return cut.union(loose.mapInArrow(_packed, "doc_id bigint, row bigint, packed binary").select("doc_id", "row", "packed", *none).mapInArrow(_cut(window, text_out), OUT))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
m as (select g, min(doc_id) as lo from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join m on win.g = m.g where m.lo < doc_id),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select p.doc_id, count(*) as kept, string_agg(word, ' ' order by p.p) as t from p left join gone on p.doc_id = gone.doc_id and p.p = gone.p where gone.p is null group by p.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join k on d.doc_id = k.doc_id
"""


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), text_out=False).drop("kept_text")
