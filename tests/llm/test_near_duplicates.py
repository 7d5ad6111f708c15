"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pytest

from tests.llm.conftest import ODD
from waybill.llm import near_duplicates as nd
from waybill.llm.components import components


def sets_of(text, width):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    """component_id of each row, by all pairs."""
    sets = [sets_of(t, width) for _, t, *_ in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                part[find(i)] = find(j)
    smallest = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return [(str(i), len(s), str(smallest.get(find(k)) if s else i)) for k, ((i, *_), s) in enumerate(zip(rows, sets))]


def result(df, width):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nd.near_duplicates(df, width).collect())


def test_odd_rows(odd, empty):
    assert result(odd, 4) == sorted(brute(ODD, 4))
    assert {r.kept for r in nd.near_duplicates(odd, 4).collect() if r.doc_id in (1, 2, 3, 7, 9)} == {True}
    assert nd.near_duplicates(empty, 4).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_large_groups_whose_members_are_linked_in_part(make, monkeypatch, block):
    """Variants of a text at many distances, exact copies, and texts that share a long passage."""
    monkeypatch.setattr(nd, "BLOCK", block)
    r = random.Random(block)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    bases = [[word() for _ in range(n)] for n in (40, 150, 600)]
    passage = [word() for _ in range(60)]
    rows = []
    for base in bases:
        for _ in range(90):
            share = r.choice([0.005, 0.01, 0.02, 0.03, 0.05])
            rows.append((len(rows), " ".join(w if r.random() > share else word() for w in base)))
    rows += [(len(rows) + k, " ".join(bases[0])) for k in range(50)]
    rows += [(len(rows) + k, " ".join([*passage, *(word() for _ in range(60))])) for k in range(50)]
    rows = [(i, t, "en", "a") for i, t in rows]
    assert result(make(rows), 4) == sorted(brute(rows, 4))


def test_sketches_lose_no_pair_at_the_threshold():
    r = np.random.default_rng(3)
    for _ in range(400):
        union = int(r.integers(2, 6000))
        both = int(np.ceil(0.8 * union))
        cut = int(r.integers(both, union + 1))
        u = r.permutation(np.unique(r.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)))
        a, b = np.sort(u[:cut]), np.sort(np.concatenate((u[:both], u[cut:])))
        (sa, xa), (sb, xb) = nd.odd_sketch(a), nd.odd_sketch(b)
        flips = np.bitwise_count(np.frombuffer(xa, np.uint64) ^ np.frombuffer(xb, np.uint64)).sum()
        assert nd.may_be_similar(np.int64(flips), sa, sb, len(a), len(b), 80)[0]


@pytest.mark.parametrize("union", [10, 15, 20, 30, 50, 100, 200, 300, 400, 500])
def test_sketches_lose_no_pair_of_small_sets(union):
    """Thousands of pairs at the threshold and just above, whose ranges hold several shingles now and then."""
    r = np.random.default_rng(union)
    rows = []
    for k in range(2000):
        u = r.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
        both = int(np.ceil((0.8 if k % 4 else 0.82) * union))
        cut = int(r.integers(both, union + 1))
        a, b = np.sort(u[:cut]), np.sort(np.concatenate((u[:both], u[cut:])))
        (sa, xa), (sb, xb) = nd.odd_sketch(a), nd.odd_sketch(b)
        rows.append((np.bitwise_count(np.frombuffer(xa, np.uint64) ^ np.frombuffer(xb, np.uint64)).sum(), sa, sb, len(a), len(b)))
    assert nd.may_be_similar(*np.array(rows, np.int64).T, 80)[0].all()


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)] + [(7, 7), (5000, 2000)]
    part = {}
    for a, b in links:
        part.setdefault(a, a), part.setdefault(b, b)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in part if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1024, 2048])
@pytest.mark.parametrize("tasks", [1, 2])
def test_words_that_polynomials_confuse_are_not_linked(spark, n, tasks):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    df = spark.createDataFrame(list(enumerate([*texts, *(f"{t} with some more" for t in texts)])), "doc_id long, text string").repartition(tasks, "doc_id")
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(df, 4, 80).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
