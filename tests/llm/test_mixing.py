"""Mixing sources against a plain loop."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from tidemark.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(rows, weights=(1, 2, 3), most=3):
    size = [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for _, t, _ in rows]
    per = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, open_ = sum(per.values()), {}, set(order)
    while True:  # the excess is shared anew until no target is above its stop
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * per[s]}
        if not over:
            return size, per, target | share
        target |= {s: float(most * per[s]) for s in over}
        open_ -= over


def rows_of(seed, n=400):
    r = random.Random(seed)
    # A source with most of the words, tiny ones that stop at three times their size, one without words, and a null one.
    names = ["big"] * 12 + ["a", "b", "c", "É", "~", None]
    rows = [(k, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 30))), r.choice(names)) for k in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (n + 2, " \t\n ", "void"), (None, "no id", "b"), (None, "no id either", "b"), (5, "same id", "b"), (5, "same id", "b"), (n + 3, "long " * 30_000, "c")]


def frame(spark, rows, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(parts)
    return df.withColumn("size", F.lit("x")).withColumn("rate", F.lit("y")).withColumn("copy", F.lit(9)).withColumn("odd.name", F.lit(1))


def test_repetitions(spark):
    rows = rows_of(1)
    size, per, target = expected(rows)
    got = mixing.repetitions(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, n, s) for n, (i, _, s) in zip(size, rows))
    assert any(abs(target[s] - 3 * per[s]) < 1e-6 for s in per if per[s]) and any(target[s] < 3 * per[s] for s in per)
    for r in got:
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        low = int(r.rate + 1e-9)
        assert r.taken == r.size * r.copies <= 3 * r.size and r.copies in (low, low + 1)
        if r.doc_id is not None:
            drawn = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
            assert r.copies == int(r.rate) + (drawn < r.rate - int(r.rate))
    assert Counter(got) == Counter(mixing.repetitions(frame(spark, rows, 7)).collect())


def test_taken_words_come_near_their_target(spark):
    rows = [(k, "w " * (1 + k % 9), f"s{k % 4}") for k in range(8000)]
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.repetitions(frame(spark, rows)).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(taken - target) < 0.05 * target for taken, target in by.values())


def test_mixed(spark):
    rows = rows_of(2, 60)
    docs = frame(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "rate", "odd.name", "copy"]
    copies = Counter()
    for r in mixing.repetitions(docs).collect():
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +copies


def test_empty_and_wordless(spark):
    none = frame(spark, rows_of(1)[:1]).where("doc_id < 0")
    assert mixing.repetitions(none).collect() == [] and mixing.mixed(none).collect() == []
    for r in mixing.repetitions(frame(spark, [(1, None, "a"), (2, " ", None)])).collect():
        assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
