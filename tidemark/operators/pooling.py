"""Attention pooling with given weights: a query's cross attention over the tokens of a group, in parts that merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of weights that travel to the workers, at most.
MOST_BYTES = 64 << 20
MATRICES, ROWS = ("wq", "wk", "wv", "wo"), ("query", "bq", "bk", "bv", "bo", "gain", "shift")


def given_weights(weights: DataFrame) -> dict[str, np.ndarray]:
    """Weights (name, row, values) as arrays: ``wq wk wv wo`` of d x d, ``query bq bk bv bo gain shift`` of one row, and ``places``, a row for each place of a token, if places count. More than ``MOST_BYTES`` are an error."""
    size = weights.agg(F.coalesce(F.sum(F.size("values")), F.lit(0)).alias("n")).first()["n"] * 8
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of weights; {MOST_BYTES} travel at most")
    held: dict[str, list] = {}
    for r in weights.orderBy("name", "row").collect():
        held.setdefault(r["name"], []).append(r["values"])
    out = {k: np.array(v, float) for k, v in held.items()}
    if missing := [k for k in (*MATRICES, *ROWS) if k not in out]:
        raise ValueError(f"weights lack {', '.join(missing)}")
    return {k: v[0] if k in ROWS else v for k, v in out.items()}


def _partials(w: dict[str, np.ndarray], heads: int):
    """Of each batch and group the greatest score of each head, the sum of exponentials above it, and the values they weigh."""
    d = len(w["query"])
    q = (w["wq"] @ w["query"] + w["bq"]).reshape(heads, d // heads) / np.sqrt(d // heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(2).to_pylist(), float)
            if "places" in w:
                x = x + w["places"][np.minimum(b.column(1).to_numpy(), len(w["places"]) - 1)]
            names, at = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            scores = np.einsum("nhc,hc->nh", (x @ w["wk"].T + w["bk"]).reshape(len(x), heads, -1), q)
            top = np.full((len(names), heads), -np.inf)
            np.maximum.at(top, at, scores)
            e = np.exp(scores - top[at])
            total, held = np.zeros((len(names), heads)), np.zeros((len(names), d))
            np.add.at(total, at, e)
            np.add.at(held, at, (e[:, :, None] * (x @ w["wv"].T + w["bv"]).reshape(len(x), heads, -1)).reshape(len(x), d))
            yield pa.RecordBatch.from_pydict({"key": pa.array(names.tolist()), "n": pa.array(np.bincount(at)), "top": pa.array(top.tolist()), "total": pa.array(total.tolist()), "held": pa.array(held.tolist())})

    return run


def _merged(w: dict[str, np.ndarray], heads: int):
    """Groups from their parts, which come sorted by group; the last group of a batch may go on in the next."""
    d = len(w["query"])

    def done(key, n, top, total, held) -> tuple:
        out = w["wo"] @ (held.reshape(heads, -1) / total[:, None]).ravel() + w["bo"] + w["query"]
        out = (out - out.mean()) / np.sqrt(out.var() + 1e-5) * w["gain"] + w["shift"]
        return key, n, out.tolist()

    def run(batches):
        own = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                part = [r["key"], r["n"], *(np.array(r[c]) for c in ("top", "total", "held"))]
                if own is not None and own[0] == part[0]:
                    top = np.maximum(own[2], part[2])
                    a, c = np.exp(own[2] - top), np.exp(part[2] - top)
                    own = [own[0], own[1] + part[1], top, own[3] * a + part[3] * c, own[4] * np.repeat(a, d // heads) + part[4] * np.repeat(c, d // heads)]
                else:
                    rows += [done(*own)] if own is not None else []
                    own = part
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64()))], ["key", "n", "pooled"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(*own), (pa.string(), pa.int64(), pa.list_(pa.float64())))], ["key", "n", "pooled"])

    return run


def attention_pooled(tokens: DataFrame, weights: DataFrame, heads: int = 8) -> DataFrame:
    """(key, n, pooled): one vector of each group of tokens (key, place, token): the query attends to all of them, is added to the outcome, and the sum is normalised.

    A batch scores its tokens as matrices and gives, for each group, parts of a softmax that merge; so a group of any length is never in one place, and what moves is a row for each group and batch. Tokens that are null, hold nulls or are of another length are left out; a group without any other has no row. Places past the table's end take its last row.
    """
    w = given_weights(weights)
    d = len(w["query"])
    sound = F.col("token").isNotNull() & (F.size("token") == d) & F.forall("token", lambda v: v.isNotNull())
    rows = tokens.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("place").cast("bigint"), F.lit(0)).alias("place"), F.col("token").cast("array<double>").alias("token")).where(sound & F.col("key").isNotNull())
    parts = rows.mapInArrow(_partials(w, heads), "key string, n bigint, top array<double>, total array<double>, held array<double>")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(_merged(w, heads), "key string, n bigint, pooled array<double>")
