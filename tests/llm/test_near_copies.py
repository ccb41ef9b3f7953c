"""The near-copy stage against brute force over all pairs, without any limit but the Jaccard similarity."""

import itertools
import random
from math import comb

import numpy as np

from tests.llm.test_operators import DOCS, rows_of
from weft.llm import simhash as S


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = f"n{rng.randint(0, 10**9)}"
    return out


def brute_left(texts):
    sets, group = [S._shingles(t, 5) for t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = find(a), find(b)
        if x != y and len(both := sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both)):
            group[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def left(spark, texts, **options):
    return {r.doc_id for r in S.drop_near_copies(spark.createDataFrame(rows_of(texts), DOCS).repartition(4), **options).collect()}


def test_large_group_of_near_copies(spark):
    """1000 copies, each near the original or just not, and hardly any near another copy."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(300)]
    texts = [" ".join(changed(rng, base, rng.randint(5, 7))) for _ in range(1000)]
    texts.insert(500, " ".join(base))
    want = brute_left(texts)
    assert 100 < len(want) < 600
    assert left(spark, texts, block_rows=300) == want


def test_pairs_of_every_fingerprint_distance(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(changed(rng, words, rng.choice((5, 5, 9))))]
    want = brute_left(texts)
    assert 150 < len(want) < 250
    assert left(spark, texts) == want


def test_no_similar_pair_falls_out_by_place_or_length():
    """Every pair of sets of similarity 0.8 or more is found at some key, in runs compared as matrices and in short ones; none of too different sizes is."""
    rng = np.random.default_rng(13)
    sets = []
    for n in (1, 2, 5, 9, 40, 300, 900):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(12):
            new = rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 2)), dtype=np.uint64)
            kept = base[: max(1, n - int(rng.integers(0, n // 5 + 1)))]
            sets += [np.unique(np.concatenate([kept, new])), np.unique(kept)]
        sets += [np.unique(np.concatenate([base, rng.integers(0, 2**63, 3 * n, dtype=np.uint64)])) for _ in range(4)]
    everywhere = np.sort(np.unique(np.concatenate([s[:1] for s in sets])))
    for common, matrix in ((everywhere[:0], 2), (everywhere, 2), (everywhere, 10_000)):
        rank = np.arange(len(common))
        rows = [(int(h.view(np.int64)), i, place) for i, s in enumerate(sets) for place, h in enumerate(S._prefix(s, common, rank, 0.8))]
        rows = np.array(sorted(rows), np.int64)
        size = np.array([len(s) for s in sets])
        sketches = np.stack([np.frombuffer(S._sketch(s), np.uint64) for s in sets])[rows[:, 1]]
        held, S.MATRIX = S.MATRIX, matrix
        try:
            got = {tuple(sorted((rows[i, 1], rows[j, 1]))) for x, y in S._similar_pairs(rows[:, :1], size[rows[:, 1]], rows[:, 2], sketches, 0.8) for i, j in zip(x, y)}
        finally:
            S.MATRIX = held
        own = [frozenset(s.tolist()) for s in sets]
        both = {(a, b): len(own[a] & own[b]) for a, b in itertools.combinations(range(len(sets)), 2)}
        want = {p for p, n in both.items() if n >= 0.8 * (size[p[0]] + size[p[1]] - n)}
        assert len(want) > 100 and want <= got
        assert all(min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) - 1e-6 for a, b in got)


def test_marked_elements_are_all_that_are_sought(spark):
    rng = np.random.default_rng(14)
    lists = [rng.integers(-(2**63), 2**63 - 1, int(n)).tolist() for n in rng.integers(0, 40, 300)]
    lists[5] += [-1, 0, 2**63 - 1, -(2**63)]
    every = [(key, -key, place, sig) for key, own in enumerate(lists) for place, sig in enumerate(own)]
    sought = {sig for *_, sig in every[::7]} | set(lists[5])
    marks = S._marks(spark.createDataFrame([(x,) for x in sought], "sig long"), 12)
    rows = spark.createDataFrame([(key, -key, own) for key, own in enumerate(lists)], "key long, root long, sigs array<long>").repartition(3)
    got = [tuple(r) for r in S._marked(rows, marks).select("key", "root", "place", "sig").collect()]
    assert len(set(got)) == len(got) and {r for r in every if r[3] in sought} <= set(got) <= set(every)
    assert len(got) < 0.5 * len(every)
    assert not S._marked(rows, S._marks(spark.createDataFrame([], "sig long"))).count()


def test_rows_do_not_depend_on_the_order_of_shingles(spark, monkeypatch):
    """Whatever is taken as common, right or wrong: it is only compared later, not left out."""
    rng = random.Random(15)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
        texts += [" ".join(words), " ".join(changed(rng, words, rng.choice((2, 2, 9))))]
    want = brute_left(texts)
    assert 40 < len(want) < 75
    some = np.unique(np.concatenate([S._shingle_hashes(t, 5)[::3] for t in texts]))
    for common in (some[:0], some):
        monkeypatch.setattr(S, "_common_shingles", lambda *_, c=common: (c, np.arange(len(c))[::-1].copy()))
        assert left(spark, texts, distance=3) == want


def test_fingerprint_round_deals_a_bounded_number_of_rows(spark, monkeypatch):
    """With the weight that pairs have among very many points, the plan keeps to the bound; what it does not link, the shingles find."""
    rng = random.Random(14)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(20_000)]
    points = spark.createDataFrame([(x,) for x in fps], "fp long")
    monkeypatch.setattr(S, "PAIR_US", 5.0)
    assert sum(comb(len(bits), k) for bits, t in S.plan(points, 10) for k in range(t + 1)) > 100
    for block_rows in (2048, 8):
        dealt = 0
        for bits, t in S.plan(points, 10, most=16, block_rows=block_rows):
            assert t == 0
            _, c = np.unique(np.array(fps) & S._mask(bits), return_counts=True)
            dealt += (c * -(-c // block_rows)).sum()
        assert dealt <= 16 * len(fps)
    monkeypatch.setattr(S, "ROWS_A_POINT", 1)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(200)]
        texts += [" ".join(words), " ".join(changed(rng, words, rng.choice((1, 3, 4, 6))))]
    assert left(spark, texts) == brute_left(texts)
