import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from symgraph.llm import simhash
from symgraph.llm.common import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    fps = [brute_print(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if (fps[i] ^ fps[j]).bit_count() <= radius] for i in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(comp[j] for j in near[i])
            if low < comp[i]:
                comp[i], changed = low, True
    ids = {}
    for i in range(n):
        known = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        ids[i] = min(known) if known else None
    return sorted([(rows[i][0], f"{fps[i]:016x}", len(near[i]) - 1, ids[i]) for i in range(n)], key=str)


def test_every_pair_within_the_radius_shares_a_mask():
    for r in (1, 2, 3):
        masks = simhash.covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        rng = np.random.default_rng(r)
        for _ in range(500):
            flip = sum(1 << int(b) for b in rng.choice(64, r, replace=False))
            assert any(not flip & m for m in masks)


@pytest.mark.parametrize("hot", [0, 64])
def test_against_brute_force(spark, hot):
    """Also empty, blank, null and long texts, copies, null and repeated ids."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, 400)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 6].split()
        for _ in range(i % 5):
            words[int(rng.integers(len(words)))] = "x"
        rows.append((100 + i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b"), (None, base[0]), (7, base[7]), (906, "z " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df, hot=hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "n_near", "component_id")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)
    assert max(r[2] for r in brute(rows)) > 5


def test_hot_bucket_of_different_prints_is_exact(spark):
    fps = sorted({(1 << a) | (1 << b) for a in range(20) for b in range(20)} | {0})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    for hot in (0, 10_000):
        assert {(r.a, r.b) for r in simhash.near_pairs(df, hot=hot).collect()} == want


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "q r s t u", "z"), (None, "a b c d", "n")], "doc_id long, text string, source string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "2", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_judges_rows_that_share_an_id_by_component(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(7, text(i)) for i in range(12)] + [(7, text(3)), (8, text(4)), (1, text(5)), (9, text(20)), (9, text(21)), (None, text(0))]
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(7, text(i)) for i in range(12) if i != 5] + [(1, text(5)), (9, text(20)), (9, text(21)), (0, text(0))])
