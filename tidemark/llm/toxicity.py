"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of the labelled documents. Their terms are words and the first letters of longer words, so that inflected forms meet, and all of them count; document frequencies are taken over the whole corpus. A term weighs the more, the more its likelihood ratio by label exceeds what chance gives, but never nothing. What no example has can match nothing and is left out of a text's vector.

The examples' unit vectors form an inverted index in blocks. A query adds up the postings of its rarer terms, and those of the wide ones, which many examples have, for many queries at once as a product of matrices; for its common ones the index has the greatest weight in each block, and only examples that with these bounds could still be among the nearest are scored in full, which leaves the result exact. Votes of the k nearest are weighted by distance and calibrated by isotonic regression over the examples, each voted on by others that it has taught nothing.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, once, slices

#: Labelled documents that are learnt from, at most: those of least hash.
MAX_EXAMPLES = 2048
#: Parts at most in which the examples' terms are fetched, a job each.
FETCHES = 16
#: A term's weight is its idf times FLOOR and x / (x + HALF), x being its likelihood ratio over CHANCE, the 0.1 % point of chi-square.
FLOOR, CHANCE, HALF = 0.1, 10.83, 30.0
PREFIX = 5
NEIGHBOURS, BLOCK, FOLDS = 15, 64, 4
#: Bytes of text whose words are looked up at once.
SLICE = 1 << 20
#: Queries whose wide terms are scored in one product.
AT_ONCE = 64
CUT = 0.7
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00ab\u00bb\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, evidence_ids array<bigint>, evidence_terms array<string>"


def terms_of(word: str) -> list[str]:
    """A word without the marks around it, and the first letters of a longer one."""
    w = word.strip(MARKS)
    return [w, w[:PREFIX] + "*"] if len(w) > PREFIX else [w] if w else []


def terms_in(text: str | None) -> Counter:
    """How often a text has each of its terms."""
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items() if text else ():
        for t in terms_of(w):
            out[t] += n
    return out


class Places:
    """Places of the known terms of texts. Each distinct word of the texts is looked up once."""

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        self.whole = {t: k for k, t in enumerate(vocabulary) if t[-1] != "*"}  # a word's own marks are stripped
        self.prefix = {t[:-1]: k for k, t in enumerate(vocabulary) if t[-1] == "*"}

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, how often) of the texts' known terms, one text behind the other, and where each text's start (and the end)."""
        words = pc.utf8_split_whitespace(pa.array([t.lower() if t else "" for t in texts], pa.string()))
        coded = words.values.dictionary_encode()
        bare = pc.utf8_trim(coded.dictionary, characters=MARKS)
        heads = pc.if_else(pc.greater(pc.utf8_length(bare), PREFIX), pc.utf8_slice_codeunits(bare, 0, PREFIX), "")
        code, base = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)) * self.n, np.diff(words.offsets.to_numpy()))
        found = []
        for place, distinct in ((self.whole, bare), (self.prefix, heads)):
            at = np.fromiter(map(place.get, distinct.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(distinct))[code]
            found.append((base + at)[at >= 0])
        keys = np.concatenate(found)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        return keys % max(1, self.n), n, np.searchsorted(keys, np.arange(len(texts) + 1) * self.n)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of many ranges, one behind the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Index:
    """Block-max inverted index over unit vectors, as flat arrays: postings by term; the weights of wide terms, those that more than a block's worth of examples have, by term and example, the widest terms first and no more cells than twice the postings; block maxima of the common terms, wide ones of more than a quarter of the examples."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        order = sorted(range(len(ids)), key=lambda k: (vectors[k][0][np.argmax(vectors[k][1])], ids[k]))  # like vectors share a block: tighter bounds
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.labels = np.array([labels[k] for k in order], float)
        self.n, self.blocks = len(order), -(-len(order) // BLOCK)
        terms = np.concatenate([vectors[k][0] for k in order]) if order else np.empty(0, np.int64)
        weights = np.concatenate([vectors[k][1] for k in order]) if order else np.empty(0)
        at = np.repeat(np.arange(self.n), [len(vectors[k][0]) for k in order])
        size = np.bincount(terms, minlength=n_terms)
        wide = np.argsort(-size, kind="stable")[: min(int((size > BLOCK).sum()), 2 * len(terms) // max(1, self.n))]
        self.row = np.full(n_terms, -1)
        self.row[wide] = np.arange(len(wide))
        self.dense = np.zeros((len(wide), self.blocks * BLOCK))
        own = self.row[terms]
        self.dense[own[own >= 0], at[own >= 0]] = weights[own >= 0]
        self.common = int((size[wide] > self.n // 4).sum())
        self.most = self.dense[: self.common].reshape(self.common, self.blocks, BLOCK).max(2, initial=0)
        by_term = np.flatnonzero(own < 0)
        by_term = by_term[np.argsort(terms[by_term], kind="stable")]
        self.at, self.w = at[by_term], weights[by_term]
        self.start = np.searchsorted(terms[by_term], np.arange(n_terms + 1))

    def scored(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings of ``terms`` give every example."""
        lo, hi = self.start[terms], self.start[terms + 1]
        at = spans(lo, hi)
        return np.bincount(self.at[at], np.repeat(weights, hi - lo) * self.w[at], self.n)

    def given(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What wide terms that are not common give every example: one row a query."""
        asked = np.zeros((len(vectors), len(self.dense) - self.common))
        for own, (terms, weights) in zip(asked, vectors):
            row = self.row[terms] - self.common
            own[row[row >= 0]] = weights[row >= 0]
        return (asked @ self.dense[self.common :])[:, : self.n]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1, given: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(cosine, place) of the k nearest with a cosine over 0; ties go to the smaller id. ``given`` is the query's row of what ``given`` tells, where it has been asked."""
        if not self.n or not len(terms):
            return []
        row = self.row[terms]
        scores = self.scored(terms[row < 0], weights[row < 0]) + (self.given([(terms, weights)])[0] if given is None else given)
        common = (row >= 0) & (row < self.common)
        if without >= 0:
            scores[without] = 0
        if common.any():
            row, weights = row[common], weights[common]
            bound = weights @ self.most[row]
            low = np.partition(scores, -k)[-k] if self.n > k else 0.0  # of what is known so far, so that the k-th is no less
            open_ = np.flatnonzero(scores + np.repeat(bound, BLOCK)[: self.n] >= low - 1e-9)
            full = np.zeros(self.n)
            full[open_] = scores[open_] + weights @ self.dense[row[:, None], open_]
            scores = full
        if without >= 0:
            scores[without] = 0
        least = np.partition(scores, -k)[-k] if self.n > k else 0.0
        hits = np.flatnonzero((scores > 0) & (scores >= least - 1e-9))
        best = sorted((-round(float(scores[h]), 12), int(self.ids[h]), int(h)) for h in hits)[:k]
        return [(-s, at) for s, _, at in best]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of y that rise with x, level over each pool and linear between pools."""
    pools: list[list[float]] = []
    for at in np.unique(x):
        own = y[x == at]
        pools.append([at, at, own.sum(), len(own)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, top, s, n = pools.pop()
            pools[-1][1:] = [top, pools[-1][2] + s, pools[-1][3] + n]
    # A small pool is drawn to one half; the running maximum keeps the map from falling where a small pool stands above a large one.
    level = np.maximum.accumulate([(p[2] + 0.25) / (p[3] + 0.5) for p in pools])
    return np.array([v for p in pools for v in p[:2]]), np.array([v for v in level for _ in range(2)])


class Model:
    """Terms, their weights, the index of the examples (id, label, places of terms, how often), and the map from votes to scores; without examples of both labels every score is 0.5.

    The map is fitted on votes that know nothing of the example's own label: each of ``FOLDS`` parts of the examples is voted on by the others, with the evidence that the others give.
    """

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.vocabulary, self.places = vocabulary, Places(vocabulary)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        terms = [e[2:] for e in examples]
        labels = np.array([e[1] == 1 for e in examples], bool)
        self.both = bool(labels.any() and not labels.all())
        if self.both:
            fold = np.arange(len(examples)) % FOLDS  # examples are in order of id, and that order is no label's
            raw, seen = np.zeros(len(examples)), np.zeros(len(examples), bool)
            for f in range(FOLDS):
                others = np.flatnonzero(fold != f)
                if not (labels[others].any() and not labels[others].all()):
                    continue
                self._learn(idf, [examples[k] for k in others], [terms[k] for k in others])
                for k in np.flatnonzero(fold == f):
                    raw[k], seen[k] = round(self.vote(self.index.nearest(*self.vector(*terms[k]), NEIGHBOURS)), 3), True
            if seen.any():
                self.steps = isotonic(raw[seen], labels[seen].astype(float))
        self._learn(idf, examples, terms)

    def _learn(self, idf: np.ndarray, examples: list, terms: list) -> None:
        """Evidence, weights and index of some of the examples."""
        all1 = sum(e[1] == 1 for e in examples)
        at = np.concatenate([t for t, _ in terms]) if terms else np.empty(0, np.int64)
        toxic = np.concatenate([t for (t, _), e in zip(terms, examples) if e[1] == 1]) if all1 else np.empty(0, np.int64)
        n, n1 = np.bincount(at, minlength=len(idf)), np.bincount(toxic, minlength=len(idf))
        self.evidence = np.zeros(len(idf))
        for t in np.flatnonzero(n1):
            self.evidence[t] = evidence_of(int(n1[t]), int(n[t]), all1, len(examples))
        self.weight = idf * (FLOOR + self.evidence)
        self.prior = (all1 + 0.5) / (len(examples) + 1)
        full = [k for k, (t, _) in enumerate(terms) if len(t)]
        self.index = None  # of other examples: two need not be held at once
        self.index = Index([examples[k][0] for k in full], [int(examples[k][1] == 1) for k in full], [self.vector(*terms[k]) for k in full], len(idf))

    def state(self) -> tuple[dict, dict]:
        """Plain values, to be sent to workers that can't import this module."""
        return {k: v for k, v in vars(self).items() if k not in ("index", "places")}, dict(vars(self.index))

    @classmethod
    def of(cls, state: tuple[dict, dict]) -> Model:
        model, index = cls.__new__(cls), Index.__new__(Index)
        vars(index).update(state[1])
        vars(model).update(state[0], index=index, places=Places(state[0]["vocabulary"]))
        return model

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of terms and their counts, of length 1 together."""
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / (math.sqrt(float(w @ w)) or 1.0)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1, by weights that fall to nothing with the cosine, and with the rate of all examples as one vote more."""
        weights = [s / (1.05 - s) for s, _ in near]
        return (sum(w * self.index.labels[at] for w, (_, at) in zip(weights, near)) + self.prior) / (sum(weights) + 1)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """Score, nearest examples and strongest terms of each text."""
        if not self.both:
            return [(0.5, [], [])] * len(texts)
        at, n, starts = self.places.counts(texts)
        vectors = [self.vector(at[a:b], n[a:b]) for a, b in zip(starts, starts[1:])]
        given = chain.from_iterable(self.index.given(vectors[k : k + AT_ONCE]) for k in range(0, len(vectors), AT_ONCE))
        return [self._score(*v, row) for v, row in zip(vectors, given)]

    def _score(self, at: np.ndarray, w: np.ndarray, given: np.ndarray) -> tuple[float, list[int], list[str]]:
        near = self.index.nearest(at, w, NEIGHBOURS, given=given)
        s = self.vote(near)
        if self.steps:
            s = float(np.interp(round(s, 3), *self.steps))
        told = np.flatnonzero(self.evidence[at])
        told = [self.vocabulary[t] for t in at[told[np.argsort(-w[told], kind="stable")[:5]]]]
        return min(1.0, max(0.0, s)), [int(self.index.ids[k]) for _, k in near[:3]], told


def _example_terms(batches):
    for b in slices(batches, 2):
        found = [terms_in(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "t", "n"])


def _frequencies(vocabulary):
    """Documents of the partition that have each term: one row a term, -1 standing for all documents."""

    def run(batches):
        places = once(vocabulary, Places)
        df, n = np.zeros(places.n, np.int64), 0
        for b in slices(batches, 0, SLICE):
            df += np.bincount(places.counts(b.column(0).to_pylist())[0], minlength=len(df))
            n += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["t", "n"])

    return run


def _scores(state):
    """Columns from the fourth on are passed through."""

    def run(batches):
        m = once(state, Model.of)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in slices(batches, 2, SLICE):
            rows = m.scores(b.column(2).to_pylist())
            own = [pa.array([s for s, _, _ in rows], pa.float64()), pa.array([int(s >= CUT) for s, _, _ in rows], pa.int32()), pa.array([e for _, e, _ in rows], pa.list_(pa.int64())), pa.array([w for _, _, w in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own, *b.columns[3:]], [*names, *b.schema.names[3:]])

    return run


def g2(n1: int, n0: int, all1: int, all0: int) -> float:
    """Likelihood ratio of a term's documents by label; 0 unless it goes with label 1."""
    total, seen = all1 + all0, n1 + n0
    cells = ((n1, seen * all1), (n0, seen * all0), (all1 - n1, (total - seen) * all1), (all0 - n0, (total - seen) * all0))
    if n1 * all0 <= n0 * all1:
        return 0.0
    return 2 * sum(o * math.log(o * total / e) for o, e in cells if o and e)


def evidence_of(n1: int, n: int, all1: int, rows: int) -> float:
    """From 0 to 1: how far a term's likelihood ratio exceeds what chance gives."""
    x = g2(n1, n - n1, all1, rows - all1) - CHANCE
    return x / (x + HALF) if x > 0 else 0.0


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Learns from ``labels`` (doc_id, toxic) whose id's crc32 mod 3 is not 1; ids or labels that are null are left out, the least label of a repeated id counts, and of examples with equal texts the one of least id. Without examples of both labels every score is 0.5.

    What reaches the driver are the terms of at most ``max_examples`` texts and one count for each of them.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(id_crc(F.col("doc_id")) % 3 != 1)
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    named = src.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64(F.lower("text")).alias("key")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("e")).select("e.*")
    # A term that many examples have is held once: each example's terms become places as they arrive.
    place: dict[str, int] = {}
    examples = []
    for r in named.select("doc_id", "toxic", "text").coalesce(FETCHES).mapInArrow(_example_terms, "doc_id bigint, toxic int, t array<string>, n array<int>").toLocalIterator():
        examples.append((r["doc_id"], r["toxic"], np.array([place.setdefault(t, len(place)) for t in r["t"]], np.int64), np.array(r["n"], np.int64)))
    examples.sort(key=lambda e: e[0])
    vocabulary = sorted(place)
    rank = np.empty(len(place), np.int64)
    rank[np.fromiter((place[t] for t in vocabulary), np.int64, len(place))] = np.arange(len(place))
    examples = [(doc_id, toxic, rank[at], n) for doc_id, toxic, at, n in examples]
    found = src.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary) + 1, np.int64)  # that of all documents comes last
    counts[found.column("t").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1))
    return Model(vocabulary, idf, examples)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), **limits) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence_ids, evidence_terms) for every row of ``docs``.

    Scores depend on the text alone. Null and empty texts, and those without a term of any example, get the calibrated rate of the examples; a null id counts as the empty text in ``held_out``; repeated rows are scored alike. ``predicted`` is 1 from a score of 0.7. An empty table gives no rows. Columns of ``docs`` named in ``keep`` are handed on beside the scores; one that has the name of a result gets ``_in`` behind its name.
    """
    state = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **limits).state())
    own = {x.split()[0] for x in SCHEMA.split(", ")}
    more = [F.col(c).alias(f"{c}_in" if c in own else c) for c in keep if c != "doc_id"]
    doc_id = F.col("doc_id").cast("bigint")
    first = [f"{x}_{uuid.uuid4().hex}" for x in ("id", "held", "text")]
    src = docs.select(doc_id.alias(first[0]), (id_crc(doc_id) % 3 == 1).alias(first[1]), F.col("text").cast("string").alias(first[2]), *more)
    return src.mapInArrow(_scores(state), ", ".join([SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[3:])]))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
