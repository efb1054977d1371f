"""Families of near copies against all pairs: groups at the threshold, outliers, chains, hubs, and sizes that differ."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tidewatch.llm import graph, jaccard_join, near_links


def near_copies(seed, percent):
    """(node, elements): copies of a few sets with edits around the threshold, some edits shared, some sets far off."""
    rng, sets = random.Random(seed), {}
    for base in range(3):
        n = rng.choice([10, 60, 150])
        start = [base * 10_000 + i for i in range(n)]
        shared = [base * 10_000 + 5_000 + i for i in range(8)]
        for _ in range(40):
            edits = rng.randint(0, max(1, 2 * n * (100 - percent) // 100))
            out = set(start)
            for _ in range(edits):
                what = rng.random()
                if what < 0.4:
                    out.discard(rng.choice(start))
                elif what < 0.6:
                    out.add(rng.choice(shared))
                else:
                    out.add(rng.randrange(10**6, 10**9))
            if rng.random() < 0.1:
                out = {x for x in out if rng.random() < 0.5} | {rng.randrange(10**6, 10**9) for _ in range(5)}
            sets[len(sets) + 1] = sorted(out)
    return {k: v for k, v in sets.items() if v}


def brute_groups(sets, percent):
    least, ids = {k: k for k in sets}, list(sets)

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(set(sets[a]) & set(sets[b]))
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("percent,overlap", [(80, near_links.whole_overlap), (90, jaccard_join.partial_overlaps)])
def test_links_give_the_components_of_all_pairs(spark, percent, overlap):
    sets = near_copies(percent, percent)
    rows = spark.createDataFrame([(k, len(v), v) for k, v in sets.items()], "node bigint, n bigint, shingles array<bigint>")
    one_family = spark.createDataFrame([(k, 0) for k in sets], "node bigint, family bigint")
    found = graph.components(near_links.links(rows, one_family, percent, overlap))
    got, want = {r["node"]: r["component"] for r in found.collect()}, brute_groups(sets, percent)
    parts = lambda of: {frozenset(k for k in sets if of(k) == g) for g in {of(k) for k in sets}}
    assert parts(lambda k: got.get(k, k)) == parts(lambda k: want[k])
    assert 1 < len(parts(lambda k: want[k])) < len(sets)


def test_linked_sets_share_a_segment():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 150, 700]:
        for _ in range(40):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            most = n * 10 // 90 if n < 20 else n // 10
            gone, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
            a = np.sort(a)
            both = len(np.intersect1d(a, b))
            row = np.repeat([0, 1], [len(a), len(b)])
            where, keys = jaccard_join.segment_hashes(row, np.concatenate([a, b]), np.array([len(a), len(b)]), 90)
            if 100 * both >= 90 * (len(a) + len(b) - both) and set(a) != set(b):
                assert set(keys[where == 0]) & set(keys[where == 1])


def test_jaccard_join(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == brute.components(texts, 3, 90)


def test_jaccard_join_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 30)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for size, percent in ((3, 90), (2, 90), (1, 95)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs, size, percent).collect()}
        assert got == brute.components(texts, size, percent)
