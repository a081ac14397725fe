"""Work along time when one key may hold any share of the rows.

A key's rows are cut into pieces by time, so many that a piece has about ``rows`` of them. Windows run within a piece; what crosses a border is carried by a second pass over one row a piece. Keys that are small stay whole, and the big table is shuffled once, by (key, piece).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a piece, about: what one task sorts.
ROWS = 200_000


def name(of: str) -> str:
    """A column name that no table has."""
    return f"__{of}_{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, keys: list[str], t: str, piece: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``piece``: the piece of its key's time that a row lies in, from 0. Equal times share a piece, and rows without a time are in the first.

    Only keys of more than ``rows`` rows are cut, evenly in time, so the table that is joined has at most one row for each ``rows`` rows.
    """
    n, lo, hi = name("n"), name("lo"), name("hi")
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min(t).alias(lo), F.max(t).alias(hi)).where((F.col(n) > rows) & (F.col(hi) > F.col(lo)))
    of = {k: name("key") for k in keys}
    hot = hot.withColumnsRenamed(of)
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in of.items()]
    pieces = F.ceil(F.col(n) / rows)
    at = F.least(F.floor((F.col(t) - F.col(lo)) * pieces / (F.col(hi) - F.col(lo))), pieces - 1)
    return df.join(hot, same, "left").withColumn(piece, F.coalesce(at, F.lit(0)).cast("bigint")).drop(n, lo, hi, *of.values())


def with_islands(df: DataFrame, keys: list[str], order: list[str], joins_last, island: str, values: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` with ``island``: neighbours in ``order`` (time first) share a number, from 1 in each key, where ``joins_last(row, last)`` holds.

    ``joins_last`` is given two functions from a name among ``values`` to a column: the row's and its predecessor's. A null verdict parts them.
    """
    piece, starts, base, joined = name("piece"), name("starts"), name("base"), name("joined")
    first, last = name("first"), name("last")
    placed = cut(df, keys, order[0], piece, rows)
    w = W.partitionBy(*keys, piece).orderBy(*order)
    verdict = joins_last(lambda c: F.col(c), lambda c: F.lag(c).over(w))
    placed = placed.withColumn(starts, F.when(F.coalesce(verdict, F.lit(False)), 0).otherwise(1))
    inside = placed.withColumn(island, F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # A piece's first and last row, and the islands that it starts; the first counts as one until the border is looked at.
    at, row = F.struct(*order), F.struct(*values)
    ends = placed.groupBy(*keys, piece).agg(F.min_by(row, at).alias(first), F.max_by(row, at).alias(last), F.sum(starts).alias(starts))
    along = W.partitionBy(*keys).orderBy(piece)
    over = joins_last(lambda c: F.col(first)[c], lambda c: F.lag(last).over(along)[c])
    borders = ends.withColumn(joined, F.when(F.coalesce(over, F.lit(False)), 1).otherwise(0))
    borders = borders.withColumn(base, F.sum(F.col(starts) - F.col(joined)).over(along.rowsBetween(W.unboundedPreceding, -1))).where(F.col(piece) > 0)
    of = {k: name("key") for k in [*keys, piece]}
    borders = borders.select(*[F.col(k).alias(v) for k, v in of.items()], base, joined)
    out = inside.join(borders, [F.col(k).eqNullSafe(F.col(v)) for k, v in of.items()], "left")
    whole = F.col(island) + F.coalesce(F.col(base) - F.col(joined), F.lit(0))
    return out.withColumn(island, whole.cast("bigint")).select(*df.columns, island)


def walk(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], make, column: str, kind: str) -> DataFrame:
    """``df`` with ``column``: what a function of the ``inputs`` gives for each row, the rows of a key taken in order.

    ``make`` gives a new function for each key; it may remember what it has seen. Rows come in batches, sorted by Spark, so a key of any length needs no more memory than the function does.
    """
    at = {c: k for k, c in enumerate(df.columns)}
    arrow = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[kind]

    def run(batches):
        key = step = None
        for b in batches:
            out = []
            for k, x in zip(zip(*(b.column(at[c]).to_pylist() for c in keys)), zip(*(b.column(at[c]).to_pylist() for c in inputs))):
                if step is None or k != key:
                    key, step = k, make()
                out.append(step(*x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], [*b.schema.names, column])

    schema = T.StructType([*df.schema.fields, T.StructField(column, {"int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType()}[kind])])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def nearest(queries: DataFrame, states: DataFrame, key: str, t_query: str, t: str, order: str, direction: str = "nearest", rows: int = ROWS) -> DataFrame:
    """Each query (``key``, ``t_query``, ...) with a struct ``state``: the state of its key nearest in time, of equally near ones the first by ``order``.

    ``direction`` is nearest, backward (at or before) or forward (at or after). Queries and states are one table, sorted by time within a piece, where the last state before and the first state behind a query are carried along; a second pass over one row a piece carries them over borders. So every row moves once, however many states and queries share a key. Queries that find none, or have no time, have a null state; states without a time are none. Rows are kept as they are, repeated ones too.
    """
    k, query, state, at, seq, piece, side = (name(x) for x in ("key", "query", "state", "at", "seq", "piece", "side"))
    q = queries.select(F.col(key).alias(k), F.col(t_query).cast("double").alias(at), F.lit(1).alias(side), F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias(query))
    s = states.where(F.col(t).isNotNull()).select(F.col(key).alias(k), F.col(t).cast("double").alias(at), F.lit(0).alias(side), F.col(order).alias(seq), F.struct(*[F.col(f"`{c}`") for c in states.columns]).alias(state))
    both = cut(q.unionByName(s, allowMissingColumns=True), [k], at, piece, rows)
    mark, before, after = (name(x) for x in ("mark", "before", "after"))
    packed = F.struct(F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(state).alias("state"))
    # At one time states come first, by order; the first of them stands for all.
    ahead = W.partitionBy(k, piece).orderBy(at, side, seq)
    shadowed = (F.lag(at).over(ahead) == F.col(at)) & (F.lag(side).over(ahead) == 0)
    marked = both.withColumn(mark, F.when((F.col(side) == 0) & ~F.coalesce(shadowed, F.lit(False)), packed))
    so_far = (W.unboundedPreceding, 0)
    back = W.partitionBy(k, piece).orderBy(F.desc(at), F.desc(side), F.desc(seq))
    seen = marked.withColumn(before, F.last(mark, True).over(ahead.rowsBetween(*so_far))).withColumn(after, F.last(mark, True).over(back.rowsBetween(*so_far))).where(F.col(side) == 1)
    of_state = F.col(side) == 0
    ends = both.groupBy(k, piece).agg(F.max_by(packed, F.when(of_state, F.struct(F.col(at), -F.col(seq)))).alias("last"), F.min_by(packed, F.when(of_state, F.struct(at, seq))).alias("first"))
    along, behind = W.partitionBy(k).orderBy(piece), W.partitionBy(k).orderBy(F.desc(piece))
    carried = ends.select(F.col(k).alias("k"), F.col(piece).alias("p"), F.last("last", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("b"), F.last("first", True).over(behind.rowsBetween(W.unboundedPreceding, -1)).alias("a"))
    carried = carried.where("a is not null or b is not null")
    full = seen.join(carried, F.col(k).eqNullSafe(F.col("k")) & (F.col(piece) == F.col("p")), "left")
    b, a = F.coalesce(F.col(before), F.col("b")), F.coalesce(F.col(after), F.col("a"))
    gap_b, gap_a = F.col(at) - b["at"], a["at"] - F.col(at)
    found = {
        "nearest": F.when(a.isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & (b["seq"] <= a["seq"])), b).otherwise(a),
        "backward": b,
        "forward": F.when(gap_b == 0, b).otherwise(a),
    }[direction]
    return full.select(F.col(query), F.when(F.col(at).isNotNull(), found["state"]).alias("state")).select(f"{query}.*", "state")
