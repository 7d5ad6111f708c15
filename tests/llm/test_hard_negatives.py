"""Hard negatives against brute force, and the walk of the multi-index against its promises."""

import numpy as np
import pandas as pd
import pytest

from waybill.llm import hard_negatives as hn


def plain(rows, every, k):
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known[i, label, tuple(int(np.floor(np.float64(np.float32(x)) * 256)) for x in v)] = 1
    out = []
    for a, la, va in known:
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in known if i != a)
            for ps, p, _ in [s for s in scored if s[2] == la][:k]:
                fits = [s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
                out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def found(spark, rows, every, k):
    df = spark.createDataFrame([(i, v, la, 1, 2) for i, v, la in rows], "vec_id long, embedding array<float>, label int, rank int, score int")
    result = hn.hard_negatives(df, every=every, positives=k, negatives=k)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in result.collect())


def clustered(n, dim, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    v = centres[r.integers(0, 8, n)] + r.normal(size=(n, dim)) * spread
    v[n // 2:n // 2 + n // 4] = v[1]
    return list(zip(range(n), (v * 0.3).astype(np.float32).tolist(), r.integers(0, 4, n).tolist()))


@pytest.mark.parametrize("dim, spread, block, probe", [(12, 0.05, 16, 60), (7, 1.0, 32, 0), (4, 0.3, 4096, 8192)])
def test_negatives(spark, monkeypatch, dim, spread, block, probe):
    """Narrow clusters and none, many and few blocks, a quarter of equal vectors, ties, with and without a first step."""
    for name, value in (("BLOCK", block), ("PROBE", probe), ("ANCHORS", 8)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(600, dim, 1, spread)
    assert found(spark, rows, 10, 4) == plain(rows, 10, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.5], 1), (0, [2.0, 2.0], 2), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [nan, 1.0], 1),
        (4, [inf, 1.0], 2), (5, [None, 1.0], 2), (None, [1.0, 1.0], 2), (6, [1.0, 1.9], None), (7, [1.0, 1.9], 2), (8, [1.0, 1.9], 2), (9, [], 1), (11, [3.0], 2),
        (12, [0.5, 1.5, -2.0], 3), (20, [0.0, 0.0], 3), (21, [0.0, 0.0], 3), (22, [-1.0, -1.0], 3), (30, [-1.0, -2.0], 3), (40, [0.9, 1.9], -7)]
    assert found(spark, rows, 10, 5) == plain(rows, 10, 5)
    assert found(spark, rows[:2], 10, 5) == []
    assert found(spark, [], 10, 5) == []


def test_walk_is_by_falling_bound_and_certified():
    r = np.random.default_rng(5)
    rows = np.floor((r.normal(size=(8, 10))[r.integers(0, 8, 4000)] + r.normal(size=(4000, 10)) * 0.1) * 256).astype(np.int64)
    books = hn.Codebooks(rows[:500], 8)
    cell, far = books.place(rows)
    table = pd.DataFrame({"cell": cell, "far_1": far[0], "far_2": far[1], "n": 1}).groupby("cell", as_index=False).agg({"n": "sum", "far_1": "max", "far_2": "max"})
    directory = hn.Directory(table.assign(blocks=1), books)
    one, two = books.bounds(rows[:30], directory.radii)
    for k in range(30):
        scores = rows @ rows[k]
        walked = list(directory.walk(one[k], two[k]))
        assert sorted(c for c, _ in walked) == sorted(set(cell.tolist()))
        bounds = [b for _, b in walked]
        assert bounds == sorted(bounds, reverse=True)
        assert all(scores[cell == c].max() <= b for c, b in walked)
        least = np.sort(scores)[-20]
        visited = {c for c, at in directory.visits(rows[k:k + 1], np.array([least]), probing=True).items() if at}
        visited |= set(directory.visits(rows[k:k + 1], np.array([least]), probing=False))
        assert set(cell[scores >= least].tolist()) <= visited
        assert len(visited) < len(walked)


def test_blocks_of_one_cell_are_parted(spark, monkeypatch):
    """Equal vectors, one cell: no block has far more than its share."""
    monkeypatch.setattr(hn, "BLOCK", 20)
    df = spark.createDataFrame([(i, [1, 2], 0) for i in range(1000)], "vec_id long, v array<long>, label long").select("vec_id", "label", "v")
    blocks = hn.Index(df).blocks.collect()
    assert len(blocks) == 50 and max(len(b["ids"]) // 8 for b in blocks) <= 45
