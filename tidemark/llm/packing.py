"""Variable-capacity best-fit packing: several permitted sequence lengths, chosen jointly.

A sequence of s tokens costs ``s * (1 + s / QUADRATIC)``: a linear part, and attention's quadratic one. Documents are dealt into groups of bounded size by a hash of their id. In a group pieces go in by falling length, each to the open bin that it leaves least room in. Where none has room, a bin is opened of the size that costs least a token that it will hold; what it will hold is read off the group's remaining lengths, the largest that still fit taken one after another. Each bin is at last cut down to the least permitted size for its contents.

Which sizes may be opened is chosen for all of a group's bins together: the group is packed once for every set of sizes that has the largest in use, and the set of the least total cost after the cutting down counts. Only ids and lengths move.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, words

SIZES = (256, 512, 1024, 2048, 4096)
#: The length from which attention's part of the cost outweighs the linear one.
QUADRATIC = 16_384
#: Documents in a group, about: large enough that its last bins weigh nothing, small enough for one task.
GROUP_ROWS = 8192
SCHEMA = "doc_id bigint, piece int, piece_start bigint, piece_tokens int, bin_group bigint, bin int, bin_size int, bin_start int, bin_used int"


def cost(size: int) -> float:
    return size * (1 + size / QUADRATIC)


class Remaining:
    """The lengths not placed yet, which fall: those from a place on."""

    def __init__(self, lengths: list[int]):
        self.falling = [-n for n in lengths]
        self.total = [0, *accumulate(lengths)]

    def fill(self, room: int, at: int) -> int:
        """Tokens that lengths from ``at`` on put into ``room``, the largest that fits first, then what follows it, and so on."""
        took = 0
        while room > 0:
            at = bisect_left(self.falling, -room, at)
            end = bisect_right(self.total, self.total[at] + room) - 1
            if end <= at:
                break
            put = self.total[end] - self.total[at]
            took, room, at = took + put, room - put, end
        return took


def opened(length: int, at: int, remaining: Remaining, sizes: tuple[int, ...]) -> int:
    """The size of least cost a token held, for a piece that fits no open bin and lengths from ``at`` on to come; of equal ones the smaller."""
    return min((s for s in sizes if s >= length), key=lambda s: (cost(s) / (length + remaining.fill(s - length, at)), s))


def packed_with(lengths: list[int], sizes: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, where it starts there, tokens used in each bin); ``lengths`` fall and only ``sizes`` are opened."""
    remaining = Remaining(lengths)
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    used: list[int] = []
    bins, starts = [], []
    for k, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(used), opened(n, k + 1, remaining, sizes)
            used.append(0)
        bins.append(b)
        starts.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, starts, used


def best_fit(pieces: list[tuple[int, ...]], sizes: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """(bin, final size, start in bin, tokens used in bin) for each (length, ...) of ``pieces``, which fall in length; ``sizes`` rise."""
    lengths = [p[0] for p in pieces]
    least = next((s for s in sizes if lengths and s >= lengths[0]), sizes[-1])
    best, total = ([], [], []), float("inf")
    final = lambda u: sizes[bisect_left(sizes, u)]
    for k in range(len(sizes) + 1):
        for allowed in combinations(sizes, k):
            if allowed and allowed[-1] >= least:
                tried = packed_with(lengths, allowed)
                c = sum(cost(final(u)) for u in tried[2])
                if c < total:
                    best, total = tried, c
    return [(b, final(best[2][b]), start, best[2][b]) for b, start in zip(*best[:2])]


def _packed(sizes: tuple[int, ...]):
    most = sizes[-1]

    def group(keys, rows):
        docs = sorted(zip(rows.column("n_tokens").to_pylist(), rows.column("doc_id").to_pylist()), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        pieces = [(min(most, n - s), -1 if d is None else d, k, s, d) for n, d in docs for k, s in enumerate(range(0, n, most))]
        pieces.sort(key=lambda p: (-p[0], p[4] is not None, p[1], p[2]))
        bins = best_fit(pieces, sizes)
        g = keys[0].as_py()
        cols = list(zip(*((p[4], p[2], p[3], p[0], g, b, s, at, u) for p, (b, s, at, u) in zip(pieces, bins)))) or [[]] * 9
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return group


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): words of the whole text and one end mark."""

    def count(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words(t, lower=False)) + 1 for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "doc_id bigint, n_tokens bigint")


def best_fit_packing(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row a piece: where in which bin it lies, and the bin's size after downsizing.

    ``lengths`` has (doc_id, n_tokens). A document longer than the largest size is cut into pieces of that size and a rest; lengths that are null or below 1 give no piece. Repeated ids are packed once a row, ties go by id; null ids are packed too. An empty table gives no rows. Columns beside the two are ignored. (bin_group, bin) names a bin.
    """
    sizes = tuple(sorted(sizes))
    rows = lengths.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens >= 1")
    groups = max(1, -(-rows.count() // group_rows))
    # Rows that share an id, or have none, are dealt apart by where they are read, so that no group outgrows a task.
    spread = F.xxhash64("doc_id", F.monotonically_increasing_id())
    return rows.withColumn("bin_group", F.pmod(spread, F.lit(groups))).groupBy("bin_group").applyInArrow(_packed(sizes), SCHEMA)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(word_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
