"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from waybill.llm import spelling as sp


def plain_words(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(spark, rows, limit=sp.BLOCK):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    result = sp.spelling_variants(df, limit=limit)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in result.collect())


def variants(seed, words, texts):
    """Texts of few stems and their misspellings: repeated letters, ends, umlauts, chains of forms."""
    r = random.Random(seed)
    letters = "abéÿ×"

    def bent(w):
        at, kind = r.randrange(len(w) + 1), r.randrange(3)
        return w[:at] + (r.choice(letters) if kind else "") + w[at + (kind < 2):]

    stems = ["".join(r.choice(letters) for _ in range(r.randint(7, 15))) for _ in range(words)]
    once = [bent(w) for w in stems for _ in range(6)]
    pool = stems + once + [bent(w) for w in once]
    weights = [300] * len(stems) + [r.choice((3, 30)) for _ in once] + [r.choice((1, 2)) for _ in once]
    return [(i, " ".join(w.upper() if r.random() < 0.2 else w for w in r.choices(pool, weights, k=400))) for i in range(texts)]


@pytest.mark.parametrize("seed, limit", [(0, sp.BLOCK), (1, 40), (2, 1)])
def test_variants(spark, monkeypatch, seed, limit):
    """Whole classes as one block, blocks parted once or twice, and parted as far as they go."""
    monkeypatch.setattr(sp, "TOGETHER", 64)
    monkeypatch.setattr(sp, "ASKING", 16)
    rows = variants(seed, 30, 40)
    expected = plain(rows)
    assert any(e[1] and e[2] != e[1] for e in expected) and any(e[4] > 3 for e in expected)
    assert found(spark, rows, limit) == expected


def test_given_documents(spark, documents):
    rows = [(d, t) for d, t, *_ in documents][:60]
    assert found(spark, rows, 200) == plain(rows)


def test_odd_texts(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(None, "variants variants variantÉs variantÉs"), (3, "_variants1variantsĀvariants\x00" * 3), (4, "y" * 20_000 + " " + "y" * 20_001)] * 2
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "short words only, here")]) == []


@pytest.mark.parametrize("longer", [0, 1])
def test_recurrences(longer):
    """Bitsets against comparing letter by letter; words of other blocks are never near."""
    r = np.random.default_rng(longer)
    index, asking = r.integers(97, 99, (150, 8)).astype(np.uint8), r.integers(97, 99, (90, 8 + longer)).astype(np.uint8)
    a, b = r.integers(0, 3, 150), r.integers(0, 4, 90)
    got = set(zip(*(x.tolist() for x in sp.one_error(index, a, asking, b))))
    assert got == {(j, i) for j in range(90) for i in range(150) if a[i] == b[j] and one_apart(bytes(index[i]), bytes(asking[j]))}


def test_blocks_stay_small_and_lose_no_pair(spark):
    """Many words with one half: parted until no block is above the limit, and all their pairs are found."""
    r = random.Random(3)
    words = {"prefix" + "".join(r.choice("abcd") for _ in range(6)) for _ in range(1500)} | {"".join(r.choice("abcd") for _ in range(5)) + "ending" for _ in range(900)}
    vocabulary = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    sizes = sp.blocks(vocabulary, 100).groupBy("block").count().collect()
    assert max(s["count"] for s in sizes) <= 100
    got = {(x.word, x.near) for x in sp.near_words(vocabulary, 100).collect()}
    by_cut = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_cut[w[:i] + "*" + w[i + 1:]].add(w)
        for i in range(len(w)):
            if w[:i] + w[i + 1:] in words:
                by_cut[w, i] = {w, w[:i] + w[i + 1:]}
    assert got == {(a, b) for group in by_cut.values() for a in group for b in group if a != b}
