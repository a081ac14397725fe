"""The training-text operators against brute force, on small fixtures with every edge case."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, exact_dedup, licenses, lm_scoring, packing, pii, shingle_join, substring_dedup, token_output, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_r = random.Random(7)
VOCAB = ["".join(_r.choice("abcdefgh") for _ in range(_r.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(120, k) for k in range(12)]
    shared = prose(60, 99)
    texts = [None, "", "  \t\n ", "one", "one", "ONE", "a b c d", "A B C D", "a b c d e", prose(20_000, 5), *base]
    for k, b in enumerate(base[:6]):
        w = b.split()
        for j in range(4):
            v = list(w)
            v[(j * 17) % len(v)] = f"new{j}"
            texts.append(" ".join(v))
        texts.append(b.upper())
        texts.append(prose(30, 200 + k) + " " + shared + " " + prose(30, 300 + k))
    texts += [base[0], base[0], "x" * 50_000, "été " * 40]
    return [(k, t) for k, t in enumerate(texts)]


ROWS = corpus()


def frame(spark, rows, parts=3):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts).withColumn("class", F.lit("x")).withColumn("row", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("score", F.lit(0.5))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ROWS[:1]).where("doc_id < 0")


def low(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("bits", [128, 3])
def test_exact_dedup(docs, bits):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[low(t)].append(i)
    want = sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in ROWS)
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(docs, hash_bits=bits).collect()) == want


def test_exact_dedup_nulls_and_repeats(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (1, "A"), (1, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or -1, r.kept, r.group_size) for r in got) == [(-1, False, 3), (-1, True, 1), (1, True, 3), (1, True, 3)]


def test_chunks_follow_content():
    data = random.Random(1).randbytes(200_000)
    a, b = exact_dedup.cuts(data), exact_dedup.cuts(b"prefix" * 30 + data)
    chunk = lambda d, c: {d[x:y] for x, y in zip([0, *c], c)}
    assert a[-1] == len(data) and len(chunk(data, a) & chunk(b"prefix" * 30 + data, b)) > 0.8 * len(a)


def sets_of(rows, n=5):
    out = {}
    for i, t in rows:
        w = low(t).split()
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute_components(rows):
    sets, comp = sets_of(rows), {i: i for i, _ in rows}
    ids = sorted(comp)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_shingle_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.shingle_components(docs).collect()}
    assert got == brute_components(ROWS)


def test_shingle_components_of_a_chain_and_small_sets(spark):
    w = prose(100, 42).split()
    rows = [(k, " ".join(w[k * 3 : k * 3 + 60])) for k in range(12)] + [(100 + k, " ".join(w[: 5 + k])) for k in range(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.shingle_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_prefix_bounds_hold():
    r = random.Random(3)
    for _ in range(3000):
        a = r.randint(1, 60)
        b = r.randint(math.ceil(0.8 * a), int(a / 0.8))
        o = min(a, b, -(-4 * (a + b) // 9))
        if 100 * o < 80 * (a + b - o):
            continue
        universe = r.sample(range(10_000), a + b - o)
        x, y = set(universe[:a]), set(universe[a - o :])
        for p in (shingle_join.FIRST, shingle_join.SECOND):
            px, py = (set(sorted(s)[: shingle_join.prefix_size(len(s), p)]) for s in (x, y))
            assert len(px & py) >= max(shingle_join.least_hits(a, p), shingle_join.least_hits(b, p))


def test_shingle_sets_of_the_first_search_are_made_once(docs):
    prefixes = docs.selectExpr("doc_id", "1L as n_shingles", "cast('x' as binary) as class", "doc_id as short", "1 as least", "array(doc_id) as keys")
    assert "MapInArrow" not in shingle_join.candidates(prefixes)._jdf.queryExecution().toString()


def test_components_joined_by_more_links(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first, more = [(1, 2), (2, 3), (5, 6), (8, 9)], [(3, 6), (9, 20), (30, 31), (31, 32)]
    got = shingle_join.joined_components(common.components(edges(first)), edges(more)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, common.components(edges(first + more)).collect())) and len(got) == 11


def test_one_of_each_keeps_the_smallest(spark, docs):
    comp = brute_components(ROWS)
    assert {r.doc_id for r in shingle_join.one_of_each(docs).collect()} == {i for i, (_, c) in comp.items() if i == c}


def brute_substrings(rows, window):
    """Sorted (doc_id, n_words, n_removed, sha256 of what stays) by a table of all windows."""
    first: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, w in split:
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("limit", [4096, 1])
def test_substring_dedup(docs, limit):
    got = substring_dedup.substring_dedup(docs, group_suffixes=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substrings(ROWS, 13)
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("window", [1, 4, 40])
def test_substring_dedup_of_other_windows_and_odd_rows(spark, window):
    base = prose(80, 3)
    rows = [(5, base), (5, base), (5, "x " + base), (None, base), (None, base), (7, "y " + base[30:] + "\tz\n"), (None, None), (2, prose(50, 4)), (3, "  " + prose(50, 4) + " \n"), (9, "a"), (8, "a a a a a a"), (10, "é " * 60)]
    got = substring_dedup.substring_dedup(frame(spark, rows), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substrings(rows, window)


def test_subtree_nodes():
    a, b = b"k l m n a b c d e f", b"x l m n a b c d y z"
    found = substring_dedup.nodes({a: 4, b: 2}, 4)
    deep = {(depth, least, tuple(sorted((region.split(b" ")[k]) for region, k in below))) for depth, least, below in found if len(below) > 1}
    assert deep == {(n, 2, (w, w)) for n, w in ((7, b"l"), (6, b"m"), (5, b"n"), (4, b"a"))}
    assert substring_dedup.subtree([(4, 0, 0, a), (2, 0, 0, b), (2, 1, 5, b)], 4) == [(4, 0, 0, 0b11110)]


def test_tokens_in_arrays():
    import pyarrow as pa

    texts = [t if t is None else t.encode() for _, t in ROWS] + [b" a\x0bb\xff ", b"x" * 600_000 + b" y", None, b""]
    for lower in (False, True):
        t = common.Tokens(pa.array([b"skipped", *texts], pa.binary()).slice(1), lower)
        raw, (joined, starts, ends) = t.data.tobytes(), t.joined()
        want = [common.words(x, lower) for x in texts]
        flat = [w for x in want for w in x]
        assert [raw[a:b] for a, b in zip(t.starts, t.ends)] == flat == [joined[a:b] for a, b in zip(starts, ends)]
        assert t.counts.tolist() == [len(x) for x in want] and t.left().tolist() == [len(x) - k for x in want for k in range(len(x))]
        assert len(set(zip(flat, t.hashes.tolist()))) == len(set(flat)) == len(set(t.hashes.tolist()))


def test_decontamination(spark, docs):
    items = [(0, " ".join((ROWS[12][1]).split()[20:60])), (1, "a b c d"), (6, "B c"), (7, "one"), (2, None), (3, ""), (4, prose(40, 9999)), (5, ROWS[13][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in [*ROWS]:
        w = low(t).split()
        grams[i] = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
    want = []
    for j, t in items:
        w = low(t).split()
        n = min(5, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        want += [(i, j, len(own), len(own & grams[i][n])) for i in grams if own and len(own & grams[i][n]) >= 0.8 * len(own)]
    for block in (1 << 20, 300):
        got = decontaminate.contained_items(docs, bench, block_bytes=block)
        assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got.collect()) == sorted(want)
    left = {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()}
    assert left == {i for i, _ in ROWS} - {w[0] for w in want}


def test_decontamination_of_short_items_and_nulls(spark):
    rows = [(1, "x a b c d e"), (2, "x a b c"), (3, "A b C"), (4, "a b x c"), (None, "q a b c"), (None, None), (2, "x a b c")]
    bench = spark.createDataFrame([(0, "a b c"), (None, "x A")], "item_id long, text string")
    got = [(r.doc_id or 0, r.item_id) for r in decontaminate.contained_items(frame(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (1, 0), (2, 0), (2, 0), (3, 0), (1, None), (2, None), (2, None)], key=str)
    assert [(r.doc_id, r.text) for r in decontaminate.decontaminated(frame(spark, rows), bench).orderBy("doc_id").collect()] == [(None, None), (4, "a b x c")]


def test_unique_rows(spark):
    rows = [(1, "bbb"), (None, "Bbb"), (9, "bbb"), (5, "ccc"), (5, "ccc"), (5, "d"), (6, "d"), (None, "e"), (None, "E"), (None, None), (3, ""), (1, "f")]
    got = exact_dedup.unique_rows(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got) == [(0, "e"), (1, "f"), (3, ""), (5, "ccc"), (6, "d"), (9, "bbb")]
    assert {len(r) for r in got} == {9}


def test_packing():
    r = random.Random(2)
    pieces = sorted(((r.randint(1, 100), k) for k in range(500)), reverse=True)
    sizes = (25, 50, 100)
    bins = packing.best_fit(pieces, sizes)
    fill: Counter = Counter()
    for (n, _), (b, size, start, used) in zip(pieces, bins):
        assert start == fill[b] and size in sizes and used <= size
        fill[b] += n
    total = sum(n for n, _ in pieces)
    assert {b: u for b, _, _, u in bins} == dict(fill)
    assert sum({b: s for b, s, _, _ in bins}.values()) < 1.06 * total


def least_cost(lengths, sizes):
    """The cost of the best bins for a few lengths, over every way to part them."""
    best = [0.0] + [float("inf")] * ((1 << len(lengths)) - 1)
    for have in range(1, 1 << len(lengths)):
        low, part = have & -have, have
        while part:
            if part & low:
                n = sum(x for k, x in enumerate(lengths) if part >> k & 1)
                if n <= sizes[-1]:
                    best[have] = min(best[have], best[have ^ part] + packing.cost(next(s for s in sizes if s >= n)))
            part = (part - 1) & have
    return best[-1]


def test_packing_chooses_sizes_jointly():
    r = random.Random(4)
    ratios = []
    for _ in range(60):
        sizes = tuple(sorted(r.sample((16, 25, 40, 64, 100, 160), 3)))
        lengths = sorted((r.randint(1, sizes[-1]) for _ in range(8)), reverse=True)
        bins = packing.best_fit([(n,) for n in lengths], sizes)
        ratios.append(sum(packing.cost(s) for s in {b: s for b, s, _, _ in bins}.values()) / least_cost(lengths, sizes))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.05
    lengths = sorted((min(4096, int(r.lognormvariate(5.3, 1)) + 1) for _ in range(1000)), reverse=True)
    bins = {b: (s, u) for b, s, _, u in packing.best_fit([(n,) for n in lengths], packing.SIZES)}
    one = packing.packed_with(lengths, packing.SIZES[-1:])[2]
    assert len({s for s, _ in bins.values()}) > 2 and sum(s for s, _ in bins.values()) < 1.02 * sum(lengths)
    assert sum(packing.cost(s) for s, _ in bins.values()) < 0.95 * len(one) * packing.cost(packing.SIZES[-1])


def test_packing_remaining_lengths():
    left = packing.Remaining([9, 7, 7, 4, 2, 1])
    assert [left.fill(room, at) for room, at in ((10, 0), (15, 1), (6, 1), (3, 3), (0, 0), (5, 6), (100, 0))] == [10, 15, 6, 3, 0, 0, 30]


def test_packing_covers_every_token(spark, docs, empty):
    lengths = packing.word_lengths(docs)
    out = packing.best_fit_packing(lengths, (64, 256), group_rows=20).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece_start, r.piece_tokens))
    for i, t in ROWS:
        at = 0
        for s, n in sorted(got[i]):
            assert s == at
            at += n
        assert at == len((t or "").encode().split()) + 1
    spans = defaultdict(list)
    for r in out:
        spans[r.bin_group, r.bin].append((r.bin_start, r.piece_tokens, r.bin_size))
    for v in spans.values():
        v.sort()
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= v[-1][2]
    odd = spark.createDataFrame([(None, 3), (None, 3), (1, None), (2, 0), (3, 5), (3, 5)], "doc_id long, n_tokens long")
    assert packing.best_fit_packing(odd).count() == 4 and packing.best_fit_packing(packing.word_lengths(empty)).count() == 0


def test_bit_packing_round_trip():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8, 11, 16, 17, 32):
        ids = rng.integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
        data = token_output.pack(ids, width)
        assert len(data) == -(-1001 * width // 8)
        assert (token_output.unpack(data, 1001, width) == ids).all() and (token_output.unpack(data, 7, width, 993) == ids[993:1000]).all()
    assert token_output.width_of(50257) == 16 and token_output.width_of(1) == 1


def test_token_output(spark, tmp_path, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*ROWS, (899, "lang " * 40_000 + "ü\n" * 9 + "é.\nWort, x!\ny"), (900, " a  b"), (901, "a\n b 　 c"), (902, "x <|endoftext|> y"), (905, "a<|endoftext|>b c"), (906, "q\nw e\n\nr don't 12ab \u03b1\u03b2. \u0561x"), (907, None), (908, None), (903, "it's 's\t t "), (904, "a\x1c b")]
    token_output.write_tokens(frame(spark, rows), str(tmp_path / "t"), path)
    got = {r.doc_id: r for r in token_output.read_tokens(spark, str(tmp_path / "t")).collect()}
    tok = Tokenizer.from_file(path)
    at, flat = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        flat += ids.tolist()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)
    for start, n in ((0, 1), (5000, 9000), (at - 3, 10)):
        part = token_output.read_range(spark, str(tmp_path / "t"), start, n).orderBy("place").collect()
        assert [(r.place, r.id) for r in part] == list(enumerate(flat))[start : start + n]
    token_output.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_output.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_lm_scores(docs, empty):
    train = [(i, t) for i, t in ROWS if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in [*low(t).split(), b""])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    for i, t in ROWS:
        w = [*low(t).split(), b""]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert g.base_score == pytest.approx(base) and g.score <= 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert lm_scoring.lm_scores(empty).count() == 0


def test_lm_scores_with_a_full_filter(spark):
    from unittest import mock

    rows = frame(spark, [(k, prose(120, k % 400)) for k in range(1200)])
    want = {r.doc_id: r.score for r in lm_scoring.lm_scores(rows, max_segments=0).collect()}
    levels = []

    def capacity(entries, segments=lm_scoring.MAX_SEGMENTS, real=lm_scoring.capacity):
        levels.append(real(entries, segments))
        return levels[-1]

    # The filter has room for ever fewer pairs; what it says falsely at its least level is not believed.
    with mock.patch.object(lm_scoring, "capacity", capacity):
        for bits in (1 << 18, 1 << 16, 1 << 14):
            with mock.patch.object(lm_scoring, "SEGMENT_BITS", bits):
                got = {r.doc_id: r.score for r in lm_scoring.lm_scores(rows, max_segments=1).collect()}
            assert got == pytest.approx(want, rel=1e-4)
    assert max(levels) > 2


def test_lm_scores_count_every_pair(spark, docs):
    from unittest import mock

    train = [[b"", *low(t).split(), b""] for i, t in ROWS if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs, after = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:])), Counter()
    worth = {p: float(lm_scoring.value_of(lm_scoring.level_of(np.array([n])))[0]) for p, n in pairs.items()}
    for (w, _), x in worth.items():
        after[w] += x
    assert min(pairs.values()) == 1 and (lm_scoring.value_of(np.arange(1, 4)) == [1, 2, 3]).all()
    n, v, mu = sum(c.values()), len(c), lm_scoring.PRIOR
    want = {}
    for i, t in ROWS:
        s = [b"", *low(t).split(), b""]
        p = [(c[w] + 1) / (n + v + 1) for w in s[1:]]
        want[i] = sum(math.log10((worth.get(k, 0) + mu * q) / (after[k[0]] + mu)) for k, q in zip(zip(s, s[1:]), p))
    for few, head in ((lm_scoring.MAX_SEGMENTS, lm_scoring.HEAD), (lm_scoring.MAX_SEGMENTS, 20), (0, lm_scoring.HEAD), (0, 20)):
        with mock.patch.object(lm_scoring, "HEAD", head):
            got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, max_segments=few).collect()}
        assert got == pytest.approx(want, rel=1e-3 if few else 1e-9, abs=1e-6)


def test_pairs_are_counted_in_bounded_memory():
    import tracemalloc

    codes = np.random.default_rng(1).integers(0, 1 << 19, 1 << 20).astype(np.uint64)
    batch = [codes[k : k + 1000] for k in range(0, len(codes), 1000)]
    want = np.unique(codes, return_counts=True)
    tracemalloc.start()
    got = lm_scoring.counted(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(got, want)) and not batch and peak < 3 * codes.nbytes
    assert [len(x) for x in lm_scoring.counted([codes[:0]])] == [0, 0]


def test_texts_asked_in_pieces_and_heads_held_are_bounded():
    from unittest import mock

    import pyarrow as pa

    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    counts = rng.integers(1, 9, len(codes))
    parts = [lm_scoring._part([(0, 0, len(c), lm_scoring.packed(c, n)) for c, n in zip(np.array_split(codes, 20), np.array_split(counts, 20))])]
    want = Counter()
    for c, v in zip((codes >> np.uint64(32)).tolist(), lm_scoring.value_of(lm_scoring.level_of(counts)).tolist()):
        want[c] += v
    with mock.patch.object(lm_scoring, "HELD_HEADS", 50):
        got, out = Counter(), list(lm_scoring._context_totals(parts))
        for b in out:
            assert b.num_rows <= 80
            for head, after in zip(*(c.to_pylist() for c in b.columns)):
                got[head] += after
    assert len(out) > 1 and got == pytest.approx(want)

    # Texts of one batch give the same whether they are asked at once or in pieces.
    hashes = lm_scoring.hashes_of(pa.array([b"a", b"b", b"c"]))
    m = lm_scoring.Model(np.append(hashes, lm_scoring.END_HASH), np.array([9, 5, 2, 4]), np.zeros(4), np.zeros((0, 8), np.uint8), 2, 20, 4, 200.0, 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4]), pa.array([b"a b rare a", None, b"", b"C a a b"], pa.binary())], ["id", "text"])
    whole = lm_scoring._asked(m, batch, np.arange(4))
    pieces = [lm_scoring._asked(m, batch.slice(k, 1), np.arange(k, k + 1)) for k in range(4)]
    for kind in lm_scoring.SENT:
        for a, b in zip(whole[kind], zip(*(p[kind] for p in pieces))):
            assert a.tolist() == np.concatenate(b).tolist()


def test_bloom_levels():
    codes = np.arange(1, 20_000, dtype=np.int64) * 7919
    counts = (np.arange(len(codes)) % 50) + 2
    table = np.stack([lm_scoring.filled(codes[lm_scoring.segment_of(codes, 2) == s], counts[lm_scoring.segment_of(codes, 2) == s]) for s in range(2)])
    level = lm_scoring.probed(table, codes)
    assert (level >= lm_scoring.level_of(counts)).all() and (level == lm_scoring.level_of(counts)).mean() > 0.99
    assert (lm_scoring.probed(table, codes + 1) == 0).mean() > 0.99
    near = lm_scoring.value_of(lm_scoring.level_of(counts)) / counts
    assert near.min() > 0.6 and near.max() < 1.6
    assert lm_scoring.capacity([(1, 10), (2, 10)]) == 1 and lm_scoring.capacity([(1, 10**9), (3, 10)]) == 2


def test_toxicity_examples_reach_the_driver_as_places(spark):
    from unittest import mock

    rows = [(k, prose(40, k)) for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    with mock.patch.object(toxicity, "Model", lambda *args: args):
        vocabulary, _, examples = toxicity.fit(frame(spark, rows), labels)
    assert vocabulary == sorted(vocabulary) and examples
    for doc_id, toxic, at, n in examples:
        assert isinstance(at, np.ndarray) and toxic == doc_id % 2 and {vocabulary[k]: c for k, c in zip(at, n.tolist())} == toxicity.terms_in(rows[doc_id][1])


@pytest.mark.parametrize("n_terms", [12, 40, 3000])
def test_toxicity_index_is_exact(n_terms):
    r, rng = random.Random(5), np.random.default_rng(5)
    vectors = []
    for _ in range(400):
        at = np.array(sorted(r.sample(range(n_terms), r.randint(1, 10))))
        w = rng.random(len(at)) * np.where(at % 7 == 0, 1, 0.05) + 1e-3
        vectors.append((at, w / np.sqrt(w @ w)))
    index = toxicity.Index(list(range(400)), [0] * 400, vectors, n_terms)
    dense = np.zeros((400, n_terms))
    for k, (at, w) in enumerate(vectors):
        dense[k, at] = w
    for q in range(60):
        scores = np.round(dense @ dense[q], 12)
        for without in (-1, q):
            want = sorted((-scores[k], k) for k in range(400) if scores[k] > 0 and k != without)[:10]
            got = index.nearest(*vectors[q], 10, int(np.flatnonzero(index.ids == without)[0]) if without >= 0 else -1)
            assert np.allclose([s for s, _ in got], [-s for s, _ in want]) and [int(index.ids[at]) for _, at in got] == [k for _, k in want]
    assert toxicity.Index([], [], [], 5).nearest(np.array([1]), np.array([1.0]), 3) == []


def test_toxicity_looks_a_word_up_once_and_scores_wide_terms_together():
    texts = [None, "", " \n", "same, " * 1000, "\x1cStra\u00dfe \u0130nsult!! *a* ** x\u2028longerword's (longerw", *(prose(60, k) for k in range(300))]
    vocabulary = sorted({t for x in texts for t in toxicity.terms_in(x)})[::2]
    places = toxicity.Places(vocabulary)
    asked = []

    class Asked(dict):
        def get(self, *args):
            asked.append(args[0])
            return super().get(*args)

    places.whole = Asked(places.whole)
    at, n, starts = places.counts(texts)
    assert len(asked) <= len({w for x in texts if x for w in x.lower().split()}) + 1
    for k, x in enumerate(texts):
        own = slice(starts[k], starts[k + 1])
        assert {vocabulary[t]: c for t, c in zip(at[own], n[own].tolist())} == {t: c for t, c in toxicity.terms_in(x).items() if t in set(vocabulary)}
    vectors = [(at[a:b], n[a:b] / np.sqrt(n[a:b] @ n[a:b])) for a, b in zip(starts, starts[1:]) if b > a]
    index = toxicity.Index(list(range(len(vectors))), [0] * len(vectors), vectors, len(vocabulary))
    assert 0 < index.common < len(index.dense) and len(index.dense) * index.n <= 2 * len(at) and len(index.at) < len(at)
    for v, given in zip(vectors, index.given(vectors)):
        assert np.allclose(index.nearest(*v, 5, given=given), index.nearest(*v, 5))


def brute_toxicity(rows, labels):
    """Scores by dense vectors and plain loops; calibration is the operator's own."""
    text = dict(rows)
    examples, seen = [], set()
    for i, y in sorted(labels.items()):
        if i in text and zlib.crc32(str(i).encode()) % 3 != 1 and (text[i] or "").lower() not in seen:
            seen.add((text[i] or "").lower())
            examples.append((i, y, toxicity.terms_in(text[i])))
    terms = sorted({t for e in examples for t in e[2]})
    tf = {i: toxicity.terms_in(t) for i, t in rows}
    idf = [math.log((len(rows) + 1) / (sum(t in x for x in tf.values()) + 1)) for t in terms]

    def learnt(some):
        """The vote that these examples give a text."""
        all1 = sum(y for _, y, _ in some)
        weight = []
        for t, i in zip(terms, idf):
            n1, n = sum(y for _, y, e in some if t in e), sum(1 for _, _, e in some if t in e)
            weight.append(i * (toxicity.FLOOR + (toxicity.evidence_of(n1, n, all1, len(some)) if n1 else 0.0)))

        def vector(own):
            v = np.array([(1 + math.log(own[t])) * w if t in own else 0.0 for t, w in zip(terms, weight)])
            return v / (np.linalg.norm(v) or 1)

        own = [(vector(e[2]), e) for e in some if e[2]]
        prior = (all1 + 0.5) / (len(some) + 1)

        def vote(found):
            v = vector(found)
            near = [x for x in sorted((-round(float(o @ v), 12), e[0], e[1]) for o, e in own) if x[0] < 0][:15]
            weights = [-s / (1.05 + s) for s, _, _ in near]
            return round((sum(w * y for w, (_, _, y) in zip(weights, near)) + prior) / (sum(weights) + 1), 3)

        return vote

    raw = []
    for f in range(toxicity.FOLDS):
        vote = learnt([e for k, e in enumerate(examples) if k % toxicity.FOLDS != f])
        raw += [(vote(e[2]), float(e[1])) for k, e in enumerate(examples) if k % toxicity.FOLDS == f]
    steps, vote = toxicity.isotonic(*map(np.array, zip(*raw))), learnt(examples)
    return {i: float(np.interp(vote(tf[i]), *steps)) for i, _ in rows}


def test_toxicity_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(k, prose(r.randint(3, 60), 3000 + k) + (" nastyword badly nastywords" if k % 6 == 0 else " mildly" if k % 5 == 0 else "")) for k in range(240)]
    rows += [(900, None), (901, ""), (902, rows[13][1].upper()), (903, "zzzz"), (904, "nastyworded")]
    labels = {k: int(k % 6 == 0) for k in range(240) if k % 4} | {900: 0, 902: 1}
    got = {x.doc_id: x.score for x in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), keep=("score", "row")).collect()}
    assert got == pytest.approx(brute_toxicity(rows, labels), abs=2e-3)


def test_isotonic_never_falls():
    x, y = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0])
    assert (np.diff(toxicity.isotonic(x, y)[1]) >= 0).all()
    for k in range(200):
        x = np.round(np.random.default_rng(k).random(80), 2)
        y = (np.random.default_rng(k + 999).random(80) < x).astype(float)
        assert (np.diff(toxicity.isotonic(x, y)[1]) >= 0).all()


def test_toxicity_holds_out(spark, empty):
    rows = [(k, prose(60, 1000 + k) + (" vilewordish vileword" if k % 5 == 0 else "")) for k in range(900)] + [(5000, None), (5001, "")]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(900)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), labels, keep=("source", "class")).collect()
    assert {r.source for r in got} == {"s"} and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(frame(spark, rows[:5]), labels.where("false")).first().score == 0.5


def test_toxicity_of_one_label(spark):
    """Nothing can be told from examples of one label, or from none."""
    rows = [(k, prose(20, 4000 + k)) for k in range(40)] + [(90, None), (91, "")]
    for y in (0, 1):
        labels = spark.createDataFrame([(k, y) for k in range(40)], "doc_id long, toxic int")
        assert {(r.score, r.predicted) for r in toxicity.toxicity(frame(spark, rows), labels).collect()} == {(0.5, 0)}


def test_toxicity_keeps_columns_of_any_name(spark):
    rows = frame(spark, [(k, prose(9, k)) for k in range(12)]).withColumn("__id", F.lit("x")).withColumn("__text", F.lit("y"))
    got = toxicity.toxicity(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), keep=("__id", "__text", "score")).collect()
    assert {(r["__id"], r["__text"], r["score_in"]) for r in got} == {("x", "y", 0.5)} and len(got) == 12


def test_pii(spark, empty):
    import re

    odd = ["a@b.c_d@e.f x@y.z. q@w.e@r.t", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "4111 1111 1111 1111 5", "+49 (30) 1234-5678 +1", "é 4111-1111-1111-1111 ☃ a@b.co", "+" * 50, "1 " * 3000, "4" * 5000, "", None, "a" * 20000 + "@b", "5500005555555559 a@b.c,d@e.f;g%h@i-j.k.l"]
    odd += [f"{prose(8, k)} Zanzibarian meets boss@corp.example.com {prose(5, 50 + k)}" for k in range(6)]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        luhn = sum((v * 2 - 9 if v > 4 else v * 2) if k % 2 else v for k, v in enumerate(map(int, reversed(d)))) % 10 == 0 if d else False
        return {"email": True, "ip": all(p.isdigit() and int(p) <= 255 for p in x.split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    spans = pii.pii_spans(frame(spark, list(enumerate(odd)) + [(900 + k, prose(40, k)) for k in range(60)])).cache()
    got = {r.doc_id: (r.b, r.s) for r in spans.select("doc_id", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect()}
    for i, t in enumerate(odd):
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if good(kind, m.group()))
        assert got[i][0] == ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in want), t
        assert set(got[i][0].split(",")) <= set(got[i][1].split(","))
    at = odd[12].index("Zanzibarian")
    assert f"term:{at}:{at + 11}" in got[12][1]
    text = {r.doc_id: r.text for r in pii.sanitised(spans).collect()}
    assert "[EMAIL]" in text[12] and "Zanzibarian" not in text[12] and "corp" not in text[12]
    assert pii.pii_spans(empty).count() == 0


def test_pii_terms_of_entities_in_one_text(spark):
    rows = [(k, prose(40, k)) for k in range(2000)]
    rows += [(5000, f"{prose(20, 1)} Quillonby wrote from only.once@mail.example.net {prose(20, 2)}"), (5001, f"{prose(9, 3)} quillonby {prose(9, 4)}"), (5002, "Call Ysoldemar: +49 30 1234 5678"), (5003, "Call Ysoldemar: +49 30 1234 5678"), (5004, "Ysoldemar left")]
    got = {r.doc_id: (r.text, r.spans) for r in pii.pii_spans(frame(spark, rows)).where("doc_id >= 5000").collect()}
    for k, w in ((5000, "Quillonby"), (5001, "quillonby"), (5002, "Ysoldemar"), (5003, "Ysoldemar"), (5004, "Ysoldemar")):
        text, spans = got[k]
        assert (text.index(w), text.index(w) + len(w)) in [(s.start, s.end) for s in spans if s.kind == "term"]
    usual = set(VOCAB)
    assert not [s for text, spans in got.values() for s in spans if s.kind == "term" and text[s.start : s.end] in usual]


def test_licenses(spark):
    rows = [
        (1, "p/LICENSE", "Some words first.\nReleased under the MIT License."), (2, "p/a/x.py", prose(30, 1)), (3, "p/a/b/y.py", None), (4, "p/a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (5, "q/z.py", "the and of"), (6, None, ""), (7, "p/a/own.py", "code\n" + prose(40, 2) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + prose(40, 3)), (2, "p/a/x.py", prose(30, 1)),
    ]
    got = [(r.doc_id, r.license, r.is_license_file, r.inherited, r.inherited_from, r.effective) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "MIT", True, None, None, "MIT"), (2, None, False, "Apache-2.0", "p/a", "Apache-2.0"), (2, None, False, "Apache-2.0", "p/a", "Apache-2.0"), (3, None, False, "Apache-2.0", "p/a", "Apache-2.0"),
        (4, "Apache-2.0", True, None, None, "Apache-2.0"), (5, None, False, None, None, None), (6, None, False, None, None, None), (7, "GPL-3.0", False, None, None, "GPL-3.0"),
    ], key=str)
    idf, unit, unseen = licenses.weights()
    names = set(licenses.anchors(unit, licenses.THRESHOLD))
    for v in unit:
        assert math.sqrt(sum(x * x for w, x in v.items() if w not in names)) < licenses.THRESHOLD
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_empty_tables(empty, spark):
    assert exact_dedup.exact_dedup(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0 and shingle_join.shingle_components(empty).count() == 0
    assert decontaminate.contained_items(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_components_and_filter(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (5, 5), (None, 1)] + [(100 + k, 101 + k) for k in range(20)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, **{100 + k: 100 for k in range(21)}}
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    bits = common.id_filter(ids)
    places = {r.doc_id: r.p for r in spark.range(3000).withColumnRenamed("id", "doc_id").select("doc_id", common.id_place(F.col("doc_id")).alias("p")).collect()}
    hit = lambda p: bits[p >> 3] >> (7 - (p & 7)) & 1
    assert all(hit(places[k]) for k in range(0, 3000, 3)) and sum(int(hit(p)) for p in places.values()) < 1010


def test_lm_look_up_gives_no_row_a_text_and_segment(spark):
    from unittest import mock

    rows, seen = [(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(200)], {}

    def counted(df, name):
        if name == "scores":
            node = df._jdf.queryExecution().analyzed().toString()
            seen[name] = node.count("FlatMapCoGroupsInArrow") == 1 and "FlatMapGroupsInArrow" in node
        return common.written(df, name)

    with mock.patch.object(lm_scoring, "written", counted), mock.patch.object(lm_scoring, "SEGMENT_TOKENS", 500):
        many = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, rows)).collect()}
    one = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, rows)).collect()}
    assert seen == {"scores": True} and len(many) == len(one) == 200
    for k, r in one.items():
        assert many[k][:5] == r[:5] and math.isclose(many[k].base_score, r.base_score, rel_tol=1e-9) and math.isclose(many[k].score, r.score, rel_tol=1e-9)


def test_lm_scores_go_to_workers_in_small_batches(docs, spark):
    from unittest import mock

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(key)
    with mock.patch.object(lm_scoring, "written", lambda df, name: seen.update({name: spark.conf.get(key)}) or common.written(df, name)):
        assert lm_scoring.lm_scores(docs).count() == len(ROWS)
    assert set(seen) >= {"pairs", "scores"} and set(seen.values()) == {str(4 << 20)} and spark.conf.get(key) == before


def test_lm_workers_give_back_bounded_rows_and_batches():
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64))
    counts = rng.integers(1, 9, len(codes))

    def held(batches, *kinds):
        batches = list(batches)
        sizes = [[len(d) for d in b.column("data").to_pylist()] for b in batches]
        assert max(map(max, sizes)) <= 1 << 18 and max(map(sum, sizes)) <= 2 << 20 and len(batches) > 1
        return lm_scoring._parts(pa.Table.from_batches(batches), int(batches[0].column("kind")[0].as_py()), *kinds)

    one = lambda kind, *columns: pa.Table.from_batches([lm_scoring._part([(0, kind, len(columns[0]), lm_scoring.packed(*columns))])])
    key = (pa.scalar(0, pa.int32()),)
    summed = lm_scoring._summed(key, one(0, codes, counts.astype(np.uint32)))
    for got in (held(summed.to_batches(), np.uint64, np.int64), held(lm_scoring._below(99)(summed.to_batches()), np.uint64, np.int64), held(lm_scoring._for_filter(1, 1)(one(0, codes, counts).to_batches()), np.uint64, np.int64)):
        assert (got[0] == codes).all() and (got[1] == counts).all()

    texts = pa.RecordBatch.from_arrays([pa.array([b" ".join(b"%x" % c for c in codes[k : k + 1000].tolist()) for k in range(0, len(codes), 1000)], pa.binary())], ["text"])
    got = held(lm_scoring._pair_counts(SimpleNamespace(value=(codes[:0], 1)))([texts]), np.uint64, np.uint32)
    assert got[1].sum() == len(codes) + texts.num_rows and len(np.unique(got[0])) > 0.99 * len(codes)

    # What a segment adds to as many texts goes to one bucket.
    uid, none = np.arange(100_000), np.zeros(100_000)
    asked = one(4, uid, none == 0, uid, none, none, none, uid)
    added = lm_scoring._looked_up(SimpleNamespace(value=none), 1, 1, 200.0, 1)(key, asked, one(0, codes[:9], counts[:9]))
    assert (held(added.to_batches(), *lm_scoring.ADDED[5])[0] == uid).all()
    assert (lm_scoring._parts(added, 6, *lm_scoring.ADDED[6])[1] == uid).all()


def test_lm_broadcasts_go_when_the_scores_are_written(docs, spark):
    import os
    from unittest import mock

    from pyspark import SparkContext

    made, real = [], SparkContext.broadcast
    with mock.patch.object(SparkContext, "broadcast", lambda sc, value: made.append(real(sc, value)) or made[-1]):
        got = lm_scoring.lm_scores(docs)
    assert len(made) == 3 and not any(os.path.exists(b._path) for b in made)
    assert got.count() == len(ROWS)


def test_small_rounds_leave_little_behind(spark):
    sc, held = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 70)], "a long, b long")
    manager = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for k in range(manager.getAllFiles().size()) if (f := manager.getAllFiles().apply(k).getName()).startswith("shuffle_")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = common.components(edges)
        assert got.rdd.getNumPartitions() == 1 and common.components(edges, task_edges=4).rdd.getNumPartitions() == 16
        assert {r.component for r in got.where("node <= 30").collect()} == {0} and got.where("node >= 70 and component = 70").count() == 2
        before = shuffled()
        common.checkpointed(edges.groupBy("a").count())
        common.written(edges.groupBy("b").count(), "counts")
        assert not [f for f in shuffled() - before if f.endswith(".data")]
        sc.setJobGroup("id_filter", "")
        common.id_filter(spark.range(100).withColumnRenamed("id", "doc_id"))
        assert len(sc.statusTracker().getJobIdsForGroup("id_filter")) < 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(ROWS[12][1].split()[10:70]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 0, 0) for i, _ in ROWS], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in c.run(spark, str(tmp_path)).collect()}
    text = dict(ROWS)
    last: dict = {}
    for i, t in ROWS:
        last[low(t)] = i
    kept = {i for i in last.values()}
    comp = brute_components([(i, text[i]) for i in sorted(kept)])
    kept = {i for i in kept if comp[i][1] == i}
    item = sets_of([(0, " ".join(ROWS[12][1].split()[10:70]))])[0]
    sets = sets_of([(i, text[i]) for i in kept])
    assert got == {i for i in kept if len(sets[i] & item) < 0.8 * len(item)}


def test_pipeline_drops_toxic_documents(spark, tmp_path):
    import corpus_pipeline as c

    rows = [(k, prose(60, 7000 + k) + (" vilewordish vileword" if k % 5 == 0 else "")) for k in range(600)] + [(5000, None), (5001, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "nothing that any document has in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 0, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # Of the two documents without a text one stays.
    assert {r.doc_id for r in c.run(spark, str(tmp_path)).collect()} == {k for k in range(600) if k % 5} | {5001}
