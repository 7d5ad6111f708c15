"""URL filters and inner products against brute force."""

import random
import re

import numpy as np
import pytest

from waybill.llm import inner_products as ip
from waybill.llm import url_filters as uf

# URL filters

URLS = [
    None, "", "no scheme", "http://", "://x.net/es/a", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com", "http://example.com/", "http://example.com/en",
    "http://a.example.com/en/", "http://example.com?x=/en/", "http://example.com#/en/", "http://net/es/", "http://.net/es/", "http://net./es/",
    "http://anet/es/", "http://x.net/fr/1", "http://x.net/FR/1", "https://com/", "ftp://user@x.com:80/", "http://x.com/\n/y", "a\nb://x.com/", "http://İ.com/",
    "http://" + "a." * 3000 + "com/" + "b/" * 3000, "http://x.com//en/", "http://x.org/en/://example.com/en/"]


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "allow"), default=None)
    return (host, path, best[0] + best[1], best[2]) if best else (host, path, None, "allow")


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rows = uf.judge_urls(pages, uf.rule_table(spark, rules)).collect()
    assert len(rows) == len(urls)
    return {r.page_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_urls(spark, seed):
    r = random.Random(seed)
    label = lambda: r.choice(["com", "net", "example", "www", "a", "b"])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice(["en/", "es/", "x", ""]) for _ in range(r.randint(0, 3)))
    rules = uf.RULES if not seed else [*uf.RULES, *((host(), path(), r.choice(["allow", "block"])) for _ in range(60))]
    urls = [*URLS, *(f"http://{host()}{path()}" for _ in range(400)), "http://example.com/en/1", "http://example.com/en/1"]
    got = judged(spark, urls, rules)
    assert [got[i] for i in range(len(urls))] == [plain(u, rules) for u in urls]


def test_no_pages_and_no_rules(spark):
    assert judged(spark, [], uf.RULES) == {}
    assert judged(spark, ["http://x.net/es/"], []) == {0: ("x.net", "/es/", None, "allow")}


def test_too_many_shapes_are_refused(spark):
    rules = uf.rule_table(spark, [("net", "/" + "a" * k, "block") for k in range(5)])
    with pytest.raises(ValueError):
        uf.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules, max_shapes=4)


def test_urls_are_native(spark, sf_dir):
    plan = uf.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), uf.rule_table(spark, uf.RULES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Inner products


def answers(rows, k, every):
    """By all products; rows of (vec_id, vector)."""
    known = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.append((i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]))
    out = []
    for q, v in {(i, tuple(v)) for i, v in known if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k, every):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    return sorted(tuple(r) for r in ip.top_products(df, k, every).collect())


@pytest.mark.parametrize("spread, block", [(0.0, 4096), (2.0, 40), (0.3, 16)])
def test_products(spark, monkeypatch, spread, block):
    """Equal and very different lengths, few and many blocks, ties, copies."""
    monkeypatch.setattr(ip, "BLOCK", block)
    monkeypatch.setattr(ip, "QUERIES", 8)
    r = np.random.default_rng(block)
    v = r.normal(size=(300, 12)) * np.exp(r.normal(size=(300, 1)) * spread)
    v[250:280] = v[0]
    v[280:290] *= 0
    rows = list(zip(range(300), v.astype(np.float32).tolist()))
    assert found(spark, rows, 7, 10) == answers(rows, 7, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [-1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []),
        (6, [1.0]), (7, [3.0, -1.0, 2.0]), (8, [0.0, 0.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (40, None)]
    assert found(spark, rows, 20, 20) == answers(rows, 20, 20)
    assert found(spark, rows[:1], 20, 20) == []
    assert found(spark, [], 20, 20) == []


def test_coordinate_pruning_keeps_all_that_reach_the_threshold():
    r = np.random.default_rng(4)
    rows = r.normal(size=(4000, 6))
    rows[:500] = r.normal(size=6) + r.normal(size=(500, 6)) * 0.2
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for q in rows[:40]:
        cosines = units @ (q / np.linalg.norm(q))
        for local in (0.7, 0.9, 0.99):
            kept = ip._coordinate_places(q, rows, units, local)
            assert set(np.flatnonzero(cosines >= local)) <= set(kept)
            assert len(kept) < len(rows)


def near_axes(n, dim, seed):
    """Whole-number vectors of one-hot direction, of any sign, and leaning to an axis more or less."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim)) * r.choice([0.0, 0.01, 0.05, 0.1], size=(n, 1))
    v[np.arange(n), r.integers(0, dim, n)] += r.choice([-1.0, 1.0], n)
    return np.floor(v * 64)


def test_coordinate_pruning_of_queries_near_an_axis():
    rows = near_axes(3000, 8, 6).astype(np.int64)
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    one_hot = np.eye(8, dtype=np.int64)[[0, 3]] * [[64], [-64]]
    for q in [*one_hot, *rows[:60]]:
        cosines = units @ (q / np.linalg.norm(q))
        for local in (0.7, 0.8, 0.9, 0.99, 1 - 1e-9):
            kept = ip._coordinate_places(q, rows, units, local)
            assert set(np.flatnonzero(cosines >= local)) <= set(kept)
            assert len(kept) < len(rows)


def test_products_of_vectors_near_an_axis(spark):
    """Lengths of one bucket, so that the first block gives thresholds near the lengths."""
    v = near_axes(1500, 8, 7)
    v = v[np.linalg.norm(v, axis=1) < 66]
    v[:40] = np.eye(8)[np.arange(40) % 8] * 64
    v[np.arange(len(v)), np.abs(v).argmax(1)] *= 1.125
    v = np.floor(v)
    rows = list(zip(range(len(v)), (v / 64).astype(np.float32).tolist()))
    assert found(spark, rows, 20, 10) == answers(rows, 20, 10)
