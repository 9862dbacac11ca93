import math
import random
from collections import Counter

import numpy as np
import pytest

from symgraph.llm import topk


def brute(rows, k=10):
    """Each query row against each other row, in Python's integers."""
    ok = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(1024.0 * x) for x in v)]
    nth, seen = {}, Counter()
    for n in sorted(range(len(ok)), key=lambda n: ok[n]):
        seen[ok[n][0]] += 1
        nth[n] = seen[ok[n][0]]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 100 == 0:
            held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
            s = sorted((-held(sum(x * y for x, y in zip(a, b))), c) for m, (c, b) in enumerate(ok) if m != n and len(a) == len(b))
            out += [(q, r + 1, c, -x, nth[n]) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e13])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "FAN", 2)
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * scale)) for _ in range(8)]) for i in range(450)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, rows[3][1]), (600, None), (601, [1.0, None]), (602, [math.nan] * 8), (603, [math.inf] * 8), (700, []), (701, []), (800, [1.0, 2.0])]
    rows += [(100, rows[7][1]), (100, rows[7][1]), (100, rows[100][1]), (7, rows[7][1]), (604, [1e306] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, nth int, v int, rank int")
    assert sorted(map(tuple, topk.op5_topk(df).collect())) == brute(rows)
    v = topk.valid_vectors(df).selectExpr("vec_id", "0L as nth", "v")
    got = topk.search(v.where("vec_id = 500"), v, tile=64, block=2).collect()
    assert len(got) == 10 and (scale > 1e12 or {3, 500, 501, 502} <= {r.vec_id for r in got})


def test_ties_copies_and_empty(spark):
    rows = [(100, [1.0]), *((i, [1.0]) for i in range(1, 40)), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in topk.op5_topk(df).collect())
    assert got == list(enumerate([1, 2, 3, 4, 5, 5, 6, 7, 8, 9], 1))
    assert topk.op5_topk(df.limit(0)).count() == 0
    odd = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1e17, 0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.op5_topk(df).collect())) == brute(odd)


def test_selection():
    rng = np.random.default_rng(3)
    for top in (3, 50, 10**6):
        s = rng.integers(-top, top, (40, 60))
        own = rng.integers(-1, 60, 40)
        rows, cols = topk.select(s.copy(), own, 7)
        for r in range(40):
            want = sorted((c for c in range(60) if c != own[r]), key=lambda c: (-s[r, c], c))[:7]
            assert sorted(cols[rows == r].tolist()) == sorted(want)


def test_products_are_exact():
    for top in (1 << 20, 1 << 28, 1 << 40):
        rng = np.random.default_rng(1)
        a, b = rng.integers(-top, top, (3, 5)), rng.integers(-top, top, (4, 5))
        want = np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1)
        assert (topk.products(a.astype(float), b.astype(float)).astype(object) == want).all()
