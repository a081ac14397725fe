"""Language-model scoring with a log-frequency Bloom filter.

Word counts are exact. Counts of all word pairs are quantised to a logarithmic level q; the pairs from a level ``least`` on are held in a Bloom filter that has the entries (pair, least) to (pair, q), and a reader probes level after level until one is missing. The filter is built in segments, one bounded bit array a task, and broadcast. Pairs below that level, those seen once at the least, are joined at the same levels. A word's probability after another is the pair's count with the word's own probability as a Dirichlet prior.

Words and pairs move as packed arrays and not as rows. A pair belongs to a segment of the data by its own hash where its second word is frequent, so that no segment is hot, and by its second word where that is rare, so that the word's exact count and the pair's meet in one place.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, Tokens, id_crc, mixed, once, slices, under, words, written

#: Words whose counts are sent to workers, by falling count.
HEAD = 100_000
#: Training tokens a segment of the data, about; pairs, and heads of pairs, that a worker holds before it sends them.
SEGMENT_TOKENS, HELD_PAIRS, HELD_HEADS = 1 << 20, 4_000_000, 1_000_000
#: Counted pairs that are cut into segments at once.
PACKED_PAIRS = 1 << 19
#: Bytes of packed arrays in a row, and of rows in a batch that a worker gives back, about: whole batches lie outside the JVM's heap, and there they add up over tasks; rows over half a megabyte lie apart in the heap and keep it from shrinking.
ROW_BYTES, BATCH_BYTES = 1 << 17, 1 << 20
#: Bytes of text that are worked on at once, and in pieces where a word takes many arrays.
SLICE, PIECE = 2 << 20, 1 << 19
#: Frequent words are looked up by so many first bits of their hashes.
BUCKET_BITS = 18
#: The filter: bits an entry, bits a segment, segments at most in a broadcast (64 MB); probes an entry; base of the levels; least count of a pair.
ENTRY_BITS, SEGMENT_BITS, MAX_SEGMENTS, PROBES, BASE, LEAST = 12, 1 << 20, 512, 5, 1.5, 1
PRIOR = 200.0
END = b""  # the end of a text, which no word equals
END_HASH = np.uint64(0x8F3A5D1C27B94E60)
LOW = np.uint64(0xFFFFFFFF)


def level_of(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, LEAST) / LEAST) / math.log(BASE) + 1e-9).astype(np.int64)


def value_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for, the middle of the counts that it has; 0 for none."""
    q = np.maximum(level, 1)
    least, beyond = np.ceil(LEAST * BASE ** (q - 1.0) - 1e-6), np.ceil(LEAST * BASE ** (q + 0.0) - 1e-6)
    return np.where(level > 0, np.sqrt(least * (beyond - 1)), 0.0)


def places(codes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Bit places of entries within their segment: one row an entry."""
    with np.errstate(over="ignore"):
        h = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(level).astype(np.uint64))
        step = mixed(h) | np.uint64(1)
        return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) >> np.uint64(20)) % np.uint64(SEGMENT_BITS)


def segment_of(codes: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(codes.astype(np.uint64)) >> np.uint64(11)) % np.uint64(segments)


def filled(codes: np.ndarray, counts: np.ndarray, least: int = 1) -> np.ndarray:
    """Packed bits of one segment, for pairs of level ``least`` and more."""
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    level = level_of(counts)
    for q in range(least, int(level.max(initial=0)) + 1):
        bits[places(codes[level >= q], q).ravel()] = 1
    return np.packbits(bits)


def probed(table: np.ndarray, codes: np.ndarray, least: int = 1) -> np.ndarray:
    """Levels of pairs: probes of level ``least``, ``least`` + 1, ... until one is missing. ``table`` has the packed bits of a segment in each row."""
    level = np.zeros(len(codes), np.int64)
    if not len(table):
        return level
    flat, alive = table.ravel(), np.arange(len(codes))
    own = codes.astype(np.uint64)
    seg = segment_of(own, len(table)) * np.uint64(SEGMENT_BITS)
    q = least
    while len(alive):
        with np.errstate(over="ignore"):
            h = mixed(own[alive] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q))
            step = mixed(h) | np.uint64(1)
            for probe in range(PROBES):
                at = ((h + step * np.uint64(probe)) >> np.uint64(20)) % np.uint64(SEGMENT_BITS) + seg[alive]
                hit = (flat[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
                alive, h, step = alive[hit], h[hit], step[hit]
        level[alive] = q
        q += 1
    return level


def _word_counts(batches):
    counts: Counter = Counter()

    def row():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for b in slices(batches, 0):
        for t in b.column(0).to_pylist():
            counts.update(words(t))
            counts[END] += 1
        if len(counts) > 300_000:
            yield row()
            counts.clear()
    yield row()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, the first byte of every value before the second, so that like bytes lie together for compression."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))


def unpacked(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def hashes_of(column) -> np.ndarray:
    """64 bits of each word of a column of words, the end of a text included."""
    tokens = Tokens(column, lower=False)
    out = np.full(len(column), END_HASH)
    out[tokens.counts > 0] = tokens.hashes
    return out


def tokens_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: the hashes of all words and ends, where each text starts, and a code of each token with the one before it (the first with an end): 32 bits of either's hash."""
    tokens = Tokens(column)
    n = len(column)
    ends = tokens.first[1:] + np.arange(n)
    h = np.full(len(tokens.starts) + n, END_HASH)
    word = np.ones(len(h), bool)
    word[ends] = False
    h[word] = tokens.hashes
    starts = tokens.first[:-1] + np.arange(n)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = END_HASH
    return h, starts, (before & ~LOW) | (h >> np.uint64(32))


def within(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and which of them it has."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def data_segment(codes: np.ndarray, frequent: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each pair: by the pair where its second word is frequent, by that word otherwise."""
    return ((mixed(np.where(frequent, codes, codes & LOW)) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32)


def cut(segment: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of each segment's elements, in their order."""
    order, own, edges = sorted_by(segment)
    return [(s, order[a:b]) for s, a, b in zip(own, edges, edges[1:])]


def sorted_by(segment: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """The order by segment, the segments, and where each starts in the order (and the end)."""
    narrow = segment.astype(np.uint16) if len(segment) and segment.max() < 1 << 16 else segment  # sorted by radix
    order = np.argsort(narrow, kind="stable")
    held = segment[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, np.int64)
    return order, held[first].tolist(), [*first.tolist(), len(held)]


PART = "segment int, kind int, size int, data binary"


def _part(rows: list[tuple[int, int, int, bytes]]):
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["segment", "kind", "size", "data"])


def _cut_rows(segment: int, kind: int, *columns: np.ndarray):
    """Arrays of a segment in rows of a bounded size."""
    step = max(1, ROW_BYTES // sum(c.itemsize for c in columns))
    for k in range(0, len(columns[0]), step):
        own = [c[k : k + step] for c in columns]
        yield segment, kind, len(own[0]), packed(*own)


def _batches(rows):
    """Rows in batches of a bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= BATCH_BYTES:
            yield _part(held)
            held, size = [], 0
    if held:
        yield _part(held)


def _table(rows) -> pa.Table:
    """Rows as a table of bounded batches, which go back to Spark one by one."""
    return pa.Table.from_batches(_batches(rows), _part([]).schema)


def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of arrays, and how often each is there. The list is emptied and one copy is sorted in place, so that a worker holds the values twice at most."""
    values = np.concatenate(held)
    held.clear()
    values.sort()
    first = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)
    return values[first[:-1]], np.diff(first).astype(np.uint32)


def _pair_counts(state):
    """Distinct pairs with their counts, packed by segment."""

    def run(batches):
        halves, segments = state.value
        held, n = [], 0

        def rows():
            codes, counts = counted(held)
            for k in range(0, len(codes), PACKED_PAIRS):
                c, own = codes[k : k + PACKED_PAIRS], counts[k : k + PACKED_PAIRS]
                for s, at in cut(data_segment(c, within(c & LOW, halves)[1], segments)):
                    yield from _cut_rows(s, 0, c[at], own[at])

        for b in slices(batches, 0, SLICE):
            held.append(tokens_of(b.column(0))[2])
            n += len(held[-1])
            if n > HELD_PAIRS:
                yield from _batches(rows())
                n = 0
        if held:
            yield from _batches(rows())

    return run


def _parts(table, kind: int, *kinds) -> list[np.ndarray]:
    """The arrays of all rows of a kind, put together. Bytes are read where they lie: only those of the kind are copied."""
    rows = [unpacked(d.as_buffer(), n, *kinds) for k, n, d in zip(table.column("kind").to_pylist(), table.column("size").to_pylist(), table.column("data")) if k == kind]
    return [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, k) for k in kinds]


def _summed(key, rows):
    """A segment's pairs with their counts over all texts, in rows of a bounded size."""
    codes, counts = _parts(rows, 0, np.uint64, np.uint32)
    codes, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(at, counts, len(codes)).astype(np.int64)
    return _table(_cut_rows(key[0].as_py(), 0, codes, counts))


def _pairs_in(batch):
    for s, n, d in zip(*(batch.column(c).to_pylist() for c in ("segment", "size", "data"))):
        yield s, *unpacked(d, n, np.uint64, np.int64)


def _level_sizes(batches):
    sizes: Counter = Counter()
    for b in batches:
        for _, _, counts in _pairs_in(b):
            own = np.bincount(level_of(counts))
            sizes.update({q: int(own[q]) for q in np.flatnonzero(own).tolist()})
    yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int32()), pa.array(list(sizes.values()), pa.int64())], ["level", "pairs"])


def _for_filter(segments: int, least: int):
    """The filter's pairs, by its segments."""

    def run(batches):
        for b in batches:
            own = [(c[keep], n[keep]) for _, c, n in _pairs_in(b) for keep in [level_of(n) >= least]]
            codes, counts = (np.concatenate(x) for x in zip(*own)) if own else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield from _batches(row for s, at in cut(segment_of(codes, segments).astype(np.int32)) for row in _cut_rows(s, 0, codes[at], counts[at]))

    return run


def _segments(least: int):
    def run(key, rows):
        codes, counts = _parts(rows, 0, np.uint64, np.int64)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([filled(codes, counts, least).tobytes()], pa.binary())})

    return run


def _below(level: int):
    """The pairs below a level, in their segments."""

    def run(batches):
        for b in batches:
            yield from _batches(row for s, c, n in _pairs_in(b) for keep in [level_of(n) < level] for row in _cut_rows(s, 0, c[keep], n[keep]))

    return run


def _context_totals(batches):
    """What the quantised counts of the pairs after each word add up to, by the half of a code that stands for the word."""
    held, n = [], 0

    def rows():
        heads, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        after = np.bincount(at, np.concatenate([v for _, v in held]), len(heads))
        return pa.RecordBatch.from_arrays([pa.array(heads.astype(np.int64)), pa.array(after)], ["head", "after"])

    for b in batches:
        for _, codes, counts in _pairs_in(b):
            if not len(codes):
                continue
            heads = codes >> np.uint64(32)  # a row's codes are sorted, so each head's are neighbours
            first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
            held.append((heads[first], np.add.reduceat(value_of(level_of(counts)), first)))
            n += len(first)
            if n > HELD_HEADS:
                yield rows()
                held, n = [], 0
    if held:
        yield rows()


def _headed(batches):
    """Words' hashes and counts, with the half of a pair's code that each gives as the word before."""
    for b in batches:
        h = hashes_of(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(32)).astype(np.int64)), pa.array(h.view(np.int64)), b.column(1)], ["head", "word", "count"])


def _frequent(halves):
    """The words that are sent to workers: those whose half of a code is a frequent word's."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(within(b.column(0).to_numpy().view(np.uint64) >> np.uint64(32), halves.value[0])[1]))

    return run


def _rare(halves):
    """All other words, packed by segment."""

    def run(batches):
        for b in batches:
            word, count, after = (b.column(k).to_numpy() for k in range(3))
            word = word.view(np.uint64)
            half = word >> np.uint64(32)
            keep = ~within(half, halves.value[0])[1]
            word, count, after, half = word[keep], count[keep], after[keep], half[keep]
            of = cut(data_segment(half, np.zeros(len(half), bool), halves.value[1]))
            yield from _batches(row for s, at in of for row in _cut_rows(s, 1, word[at], count[at], after[at]))

    return run


class Model:
    """What every worker gets: hashes and counts of the frequent words, the total of pairs after each, and the pair filter."""

    def __init__(self, word: np.ndarray, count: np.ndarray, after: np.ndarray, table: np.ndarray, least: int, total: int, distinct: int, prior: float, segments: int):
        order = np.argsort(word)
        self.word, self.counts = word[order], count[order]
        self.bucket = np.searchsorted(self.word, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        self.longest = int(np.diff(np.append(self.bucket, len(word))).max())
        self.log = np.log10(self.counts + 1.0) - math.log10(total + distinct + 1)
        self.before = math.log10(prior) - np.log10(prior + after[order])
        self.table, self.least, self.prior, self.segments = table, least, prior, segments

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Counts of pairs by the filter; 0 where the join is to tell them, as it is of what the filter has at a raised least level only: most of those hits are pairs below it, told falsely."""
        level = probed(self.table, codes, self.least)
        level[level < joined_below(self.least)] = 0
        return value_of(np.arange(int(level.max(initial=0)) + 1))[level]

    def frequent(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words by their hashes, and which of them are there; a bucket's words are compared one after the other."""
        at = self.bucket[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.int64)
        np.minimum(at, len(self.word) - 1, out=at)
        hit = self.word[at] == h
        rest = np.flatnonzero(~hit)
        for _ in range(1, self.longest):
            at[rest] = np.minimum(at[rest] + 1, len(self.word) - 1)
            found = self.word[at[rest]] == h[rest]
            hit[rest[found]] = True
            rest = rest[~found]
        return at, hit


#: What a text's segment gets of it: of pairs of frequent words that the filter lacks (code, place of the word in the model), of other words (code, word, count of the pair), of the text itself (id, whether it has one, tokens, known, base, gain); each with the text's number.
SENT = {2: (np.uint64, np.uint32, np.int64), 3: (np.uint64, np.uint64, np.float64, np.int64), 4: (np.int64, np.bool_, np.int64, np.float64, np.float64, np.float64, np.int64)}


def joined_below(least: int) -> int:
    """Pairs below this level are joined: those that the filter has not, and once it has no room for all that are seen twice, those of its least level too, so that no false hit gives a pair the count of that level."""
    return least + (least > 2)


def _asked(m: Model, batch, own: np.ndarray) -> dict[int, list[np.ndarray]]:
    """What is sent of a batch of texts (id, text) with the numbers ``own``: by kind the segment of each element and its columns."""
    h, starts, codes = tokens_of(batch.column(1))
    sizes = np.diff(np.append(starts, len(h)))
    at, frequent = m.frequent(h)
    pair = m.found(codes)
    base = np.where(frequent, m.log[at], 0.0)
    gain = np.where(frequent, np.log10(1 + pair / (m.prior * 10.0**base)) + m.before[at], 0.0)
    known = (frequent & (m.counts[at] > 0)).astype(float)
    base_sum, gain_sum, known_sum = (np.add.reduceat(x, starts) for x in (base, gain, known))
    of, segment = np.repeat(own, sizes), data_segment(codes, frequent, m.segments)
    out = {}
    for kind, pick, columns in ((2, frequent & (pair == 0), (codes, at.astype(np.uint32), of)), (3, ~frequent, (codes, h, pair, of))):
        out[kind] = [c[pick] for c in (segment, *columns)]
    ids = batch.column(0)
    out[4] = [(own % m.segments).astype(np.int32), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), sizes, known_sum, base_sum, gain_sum, own]
    return out


def _scores(state):
    """What a text's frequent words and their pairs give, and what is still to be looked up, packed by segment."""

    def run(batches):
        from pyspark import TaskContext

        m = once(state, lambda v: Model(*v))
        uid = TaskContext.get().partitionId() << 36
        for b in slices(batches, 1, SLICE):
            held: dict[int, list] = {kind: [] for kind in SENT}
            for piece in slices([b], 1, PIECE):
                for kind, columns in _asked(m, piece, uid + np.arange(piece.num_rows)).items():
                    held[kind].append(columns)
                uid += piece.num_rows
            for kind in SENT:
                segment, *columns = (np.concatenate(c) for c in zip(*held.pop(kind)))
                order, segments, edges = sorted_by(segment)
                columns = [c[order] for c in columns]
                yield from _batches(row for s, a, e in zip(segments, edges, edges[1:]) for row in _cut_rows(s, kind, *(c[a:e] for c in columns)))

    return run


#: What a text's bucket gets: sums that a segment adds to it (known, base, gain), and the text itself (id, whether it has one, tokens); each with the text's number.
ADDED = {5: (np.int64, np.uint32, np.float64, np.float64), 6: (np.int64, np.int64, np.bool_, np.int64)}
RESULT = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, gain double"


def _looked_up(logs, total: int, distinct: int, prior: float, buckets: int):
    """A segment's words and pairs meet their counts; what they add to the texts, packed by the texts' buckets: a text meets most segments, so that a row each would outgrow the input."""

    def run(key, asked, told):
        codes, counts = _parts(told, 0, np.uint64, np.int64)
        order = np.argsort(codes)
        codes, worth = codes[order], value_of(level_of(counts[order]))
        word, count, after = _parts(told, 1, np.uint64, np.int64, np.float64)
        order = np.argsort(word)
        word, count, after = word[order], count[order], after[order]

        def of(values, table, found):
            at, hit = within(values, table)
            return np.where(hit, found[at], 0) if len(table) else np.zeros(len(values))

        code2, place2, uid2 = _parts(asked, 2, *SENT[2])
        base2 = logs.value[place2]
        gain2 = np.log10(1 + of(code2, codes, worth) / (prior * 10.0**base2))
        code3, word3, pair3, uid3 = _parts(asked, 3, *SENT[3])
        c = of(word3, word, count)
        base3 = np.log10(c + 1) - math.log10(total + distinct + 1)
        pair3 = np.where(pair3 > 0, pair3, of(code3, codes, worth))
        gain3 = np.log10(1 + pair3 / (prior * 10.0**base3)) + math.log10(prior) - np.log10(prior + of(word3, word, after))
        ids, valid, sizes, known4, base4, gain4, uid4 = _parts(asked, 4, *SENT[4])
        uid, at = np.unique(np.concatenate([uid2, uid3, uid4]), return_inverse=True)
        none = np.zeros(len(uid2))
        known, base, gain = (np.bincount(at, np.concatenate(x), len(uid)) for x in ((none, c > 0, known4), (none, base3, base4), (gain2, gain3, gain4)))

        def rows():
            for kind, columns in ((5, (uid, known.astype(np.uint32), base, gain)), (6, (uid4, ids, valid, sizes))):
                for bucket, of in cut((mixed(columns[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)):
                    yield from _cut_rows(bucket, kind, *(x[of] for x in columns))

        return _table(rows())

    return run


def _totals(key, rows):
    """The texts of a bucket, one row each."""
    uid, ids, valid, sizes = _parts(rows, 6, *ADDED[6])
    order = np.argsort(uid)
    of, *added = _parts(rows, 5, *ADDED[5])
    at = np.searchsorted(uid[order], of)
    known, base, gain = (np.bincount(at, x, len(uid)) for x in added)
    return pa.table([pa.array(ids[order], mask=~valid[order]), pa.array(sizes[order]), pa.array(known.astype(np.int64)), pa.array(base), pa.array(gain)], names=[x.split()[0] for x in RESULT.split(", ")])


def capacity(entries: list[tuple[int, int]], segments: int = MAX_SEGMENTS) -> int:
    """The least level whose pairs, with those above, a broadcast filter of so many segments has room for, from (level, pairs)."""
    left, room = 0, segments * SEGMENT_BITS // ENTRY_BITS
    for level, pairs in sorted(entries, reverse=True):
        left += level * pairs
        if left > room:
            return level + 1
    return 1


def lm_scores(docs: DataFrame, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts whose id's crc32 mod 7 is not 2 are learnt from. Words are lower-cased (A-Z) runs without ASCII white space, and every text ends with one more token; a null text is that token alone, and a null id counts as the empty text in ``held_out``. base_score is the sum of log10((c + 1) / (N + V + 1)); score is the model's log10 probability. Repeated rows are scored alike, one row each; with nothing to learn from, every count is 0; an empty table gives no rows.

    Every pair of words counts. Those seen once, and those that a filter of ``max_segments`` has no room for, are joined at the same levels; once the filter is full, so are the pairs of its least level. What a false hit adds is therefore not a count that grows with the input; while every pair that is seen twice has room, about one in 200 of the pairs seen once or never may count as seen twice. Words are told apart by 64 bits where their counts are looked up.
    """
    with under(docs.sparkSession, SMALL_BATCHES):
        return _lm_scores(docs, prior, id_col, text_col, max_segments)


def _lm_scores(docs: DataFrame, prior: float, id_col: str, text_col: str, max_segments: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    train = src.where(id_crc(F.col("doc_id")) % 7 != 2).select("text")
    counts = written(train.mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("count")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    top = hashes_of(counts.orderBy(F.desc("count"), "word").limit(HEAD).select("word").toArrow().column(0).combine_chunks())
    segments = max(1, -(-total // SEGMENT_TOKENS))
    halves = sc.broadcast((np.unique(np.append(top, END_HASH) >> np.uint64(32)), segments))
    pairs = written(train.mapInArrow(_pair_counts(halves), PART).groupBy("segment").applyInArrow(_summed, PART), "pairs")
    sizes = [(r["level"], r["pairs"]) for r in pairs.mapInArrow(_level_sizes, "level int, pairs bigint").groupBy("level").agg(F.sum("pairs").alias("pairs")).collect()]
    least = max(2, capacity(sizes, max_segments))
    entries = sum((q - least + 1) * n for q, n in sizes if q >= least)
    table = np.zeros((-(-entries * ENTRY_BITS // SEGMENT_BITS), SEGMENT_BITS // 8), np.uint8)
    if entries:
        for r in pairs.mapInArrow(_for_filter(len(table), least), PART).groupBy("segment").applyInArrow(_segments(least), "segment int, bits binary").toLocalIterator():
            table[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    after = pairs.mapInArrow(_context_totals, "head bigint, after double").groupBy("head").agg(F.sum("after").alias("after"))
    counts = written(counts.mapInArrow(_headed, "head bigint, word bigint, count bigint").join(after, "head", "left").select("word", "count", F.coalesce("after", F.lit(0.0)).alias("after")), "model")
    head = counts.mapInArrow(_frequent(halves), "word bigint, count bigint, after double").toArrow()
    word, count, after = (head.column(k).to_numpy() for k in range(3))
    word = word.view(np.uint64)
    if END_HASH not in word:
        word, count, after = np.append(word, END_HASH), np.append(count, 0), np.append(after, 0.0)
    state = (word, count, after, table, least, total, distinct, prior, segments)
    logs = sc.broadcast(Model(*state).log)  # all that the second step needs: its workers don't hold the filter
    state = sc.broadcast(state)
    told = pairs.mapInArrow(_below(joined_below(least)), PART).union(counts.mapInArrow(_rare(halves), PART))
    found = src.mapInArrow(_scores(state), PART).groupBy("segment").cogroup(told.groupBy("segment")).applyInArrow(_looked_up(logs, total, distinct, prior, segments), PART)
    sums = written(found.groupBy("segment").applyInArrow(_totals, RESULT), "scores")
    for b in (halves, logs, state):  # nothing asks for them any more; else they wait for the driver to collect its garbage
        b.destroy()
    return sums.select("doc_id", (id_crc(F.col("doc_id")) % 7 == 2).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
