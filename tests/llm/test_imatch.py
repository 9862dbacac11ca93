import hashlib
import random

import numpy as np

from symgraph.llm import imatch


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(3000)]
    rows = [(i * 3, " ".join(rng.choices(vocab, k=rng.randint(0, 200)))) for i in range(300)]
    rows += [(1, rows[4][1]), (2, rows[4][1]), (5, None), (8, "é" * 9), (10_000, "word " * 40000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    bits = imatch.band(df)
    got = {r.doc_id: r for r in imatch.compare_neighbours(df, range_docs=20).collect()}
    lexicon = imatch.Lexicon(bits)
    rows.sort()
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        p, q, x = (imatch.Print(lexicon, s.encode()) for s in (t, e, nxt))
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), p.hex, q.hex, imatch.likeness(p, q), imatch.likeness(p, x))
        assert tuple(got[i])[1:] == want, i
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1
    long = [r for r in got.values() if 200 < r.n_chars < 5000]
    assert np.mean([r.near_edited for r in long]) > 0.35 > 0.1 > np.mean([r.near_next for r in long])


def test_subset_hashes_match_near_copies(spark):
    rng = random.Random(7)
    text = [f"w{rng.randrange(3000)}" for _ in range(300)]
    near = text.copy()
    near[100] = "changed"
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(reversed(text))), (4, None)] + [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    assert len(got) == len(rows) and got[1].subsets == got[3].subsets and got[4].n_terms == 0
    same = lambda a, b: sum(x == y != 0 for x, y in zip(got[a].subsets, got[b].subsets))
    assert got[1].level == got[2].level and same(1, 2) > 0.7 * sum(x != 0 for x in got[1].subsets) and same(1, 10) <= 2


def test_band_counts_documents(spark):
    df = spark.createDataFrame([("rare common x",), ("rare common",), ("common once",), ("common",), (None,)] + [(f"common f{i}",) for i in range(400)], "text string")
    lexicon = imatch.Lexicon(imatch.band(df))
    assert len(lexicon.keep({b"rare", b"common", b"once"})) == 1
    assert len(lexicon.keep({b"common", b"once"})) == 2  # nothing within the band: all terms


def test_one_none_and_repeated(spark):
    one = spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")
    r = imatch.op9_imatch(one).first()
    assert r.near_next == 1 and r.n_chars == 15
    assert imatch.op9_imatch(one.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a b"), (None, "z"), (None, None)], "doc_id long, text string")
    assert imatch.compare_neighbours(more, range_docs=1).count() == 5
