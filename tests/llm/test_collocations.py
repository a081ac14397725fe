"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import collocations


def plain(rows, least=30, longest=4, share=80, most=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, g in f.items():
        good = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, a in good.items():
            for j in range(2, len(q)):
                gone |= {q[o : o + j] for o in range(len(q) - j + 1) if 100 * a >= share * g[q[o : o + j]]}
        kept = []
        for p, a in good.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]], len(p), k))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s, m, k) for n, (s, a, p, l, r, m, k) in enumerate(sorted(kept)[:most], 1)]
    return out


def rows_of(seed):
    r = random.Random(seed)
    vocab = ["Alpha", "beta", "été", "of", "the", "\x00", "x1", "ﬀ", "New", "York", "city", "hall"]
    phrases = ["new york city hall", "of the", "The X1 beta", "beta beta beta", "été\tété"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(r.randint(0, 60)):
            words.append(r.choice(phrases) if r.random() < 0.4 else r.choice(vocab))
            words.append(r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "?!"]))
        rows.append((k, "".join(words), r.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(200, None, "en"), (201, "", None), (202, " \t ", "fr"), (203, "...", "fr"), (3, rows[3][1], rows[3][2]), (None, rows[4][1], "fr"), (204, "of the hall " * 30_000, "en")]


def frame(spark, rows, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string").repartition(parts)
    return df.withColumn("block", F.lit("x")).withColumn("phrase", F.lit("y")).withColumn("n", F.lit("z"))


def test_equal_to_plain_counting(spark):
    for seed, parts, block_words in ((1, 3, 1 << 20), (2, 5, 200), (3, 1, 1000)):
        rows = rows_of(seed)
        got = collocations.collocations(frame(spark, rows, parts), block_words=block_words).collect()
        want = plain(rows)
        assert len(want) > 30 and sorted(map(tuple, got)) == sorted(want)


def test_limits(spark):
    rows = rows_of(5)
    got = collocations.collocations(frame(spark, rows), least=5, longest=3, share=60, most=7, block_words=300).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 5, 3, 60, 7))


def test_empty(spark):
    assert collocations.collocations(frame(spark, rows_of(1)).where("doc_id < 0")).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "one", "en")])).collect() == []


def test_sums_of_a_bucket():
    """Every block gets the sums of its own keys in its own order; the least block of a key owns it."""
    keys = [np.array([5, 1], np.uint64), np.array([4, 5], np.uint64), np.array([5, 4], np.uint64)]
    rows = pa.table({"block": [3, 1, 2], "bucket": pa.array([0, 0, 0], pa.int32()), "keys": [k.tobytes() for k in keys], "counts": [collocations._packed(np.array([4, 9], "<i8"))] * 3})
    out = collocations._summed(1, 10)(rows).to_pylist()
    sums = {r["block"]: collocations._array(r["sums"], "<i8").tolist() for r in out}
    own = {r["block"]: np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=2).tolist() for r in out}
    assert sums == {1: [13, 17], 2: [17, 13], 3: [17, 0]} and own == {1: [1, 1], 2: [0, 0], 3: [0, 0]}


def test_scores_past_64_bits():
    """2,000,000 a of counts near 10^13."""
    big = 9_000_000_000_000
    row = collocations._block(1, ["en"], np.array([0, 0]), [b"a", b"b"], np.array([big + 1, big + 2]), np.array([1, 2, 0])).to_pylist()[0]
    lists = collocations.Lists(row, 1)
    lists.extend()
    lists.keep([{"sums": collocations._packed(np.array([big], "<i8")), "owned": b"\x80"}])
    assert list(lists.phrases(2, 80)) == [("en", b"a b", 2, big, 1, big + 1, big + 2, 2_000_000 * big // (2 * big + 3), False)]
