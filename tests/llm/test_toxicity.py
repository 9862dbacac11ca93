import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import toxicity


def brute_segments(x):
    """Recursive definition: the best segment, then both sides of it."""
    best = None
    for i in range(len(x)):
        for j in range(i, len(x)):
            s = sum(x[i : j + 1])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, _ = best
    return brute_segments(x[:i]) + [best] + [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(x[j + 1 :])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-7, -5, -3, -2, 2, 4, 8, 16, 31]), max_size=14))
def test_maximal_segments(x):
    got = toxicity.maximal_segments([(i, i, float(v)) for i, v in enumerate(x)])
    assert sum(s for *_, s in got) >= sum(s for *_, s in brute_segments(x)) - 1e-9
    assert max((s for *_, s in got), default=0) == max((s for *_, s in brute_segments(x)), default=0)
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    for i, j, s in got:
        assert abs(sum(x[i : j + 1]) - s) < 1e-9
        # no prefix or suffix of a maximal segment sums to nothing
        assert all(sum(x[i : k + 1]) > 0 and sum(x[k : j + 1]) > 0 for k in range(i, j + 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-7.0, -5.0, -3.0, -2.0, 2.0, 4.0, 8.0, 16.0, 31.0]), max_size=14))
def test_maximal_segments_by_their_definition(x):
    """Segments all of whose proper beginnings and ends sum above 0, and that no
    longer such segment holds."""
    fine = {(i, j) for i in range(len(x)) for j in range(i, len(x)) if all(sum(x[i : k + 1]) > 0 and sum(x[k : j + 1]) > 0 for k in range(i, j + 1))}
    want = sorted(s for s in fine if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in fine))
    assert [(i, j) for i, j, _ in toxicity.maximal_segments([(i, i, v) for i, v in enumerate(x)])] == want


def test_the_extreme_value_law_of_simulated_texts():
    rng = np.random.default_rng(5)
    n = rng.integers(50, 5000, 4000).astype(float)
    best = np.maximum(0.0, (np.log(0.02 * n) - np.log(rng.exponential(size=4000))) / 0.8)
    lam, k = toxicity.gumbel(n, best, np.ones(4000))
    assert abs(lam - 0.8) < 0.04 and abs(k - 0.02) < 0.004
    expected = k * n * np.exp(-lam * best)
    for e in (0.05, 0.2, 0.5):
        assert abs((expected < e).mean() - (1 - np.exp(-e))) < 0.02


def corpus(n=1500):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 120))
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["vile", "scum", "idiot", "filth"], k=4)
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_passages(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.op3_toxicity(d, lab).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    model = toxicity.fit(d, lab)
    text = "word1 word2 " * 30 + "you vile scum idiot " + "word3 word4 " * 30
    one = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[p.start : p.end] for p in one.passages] == ["vile scum idiot"]
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in got if not r.predicted} == {r.doc_id for r in kept.collect()}


def test_labels_of_the_held_out_third_are_unused(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert a == b


def test_evidence_values_of_clean_texts_hold_their_rate(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(2400):
        words = [f"word{rng.randrange(400)}" if rng.random() > 0.01 else f"mild{rng.randrange(6)}" for _ in range(rng.randint(20, 400))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [f"mild{rng.randrange(6)}" for _ in range(6)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [t.split() for (i, t), (_, y) in zip(docs, labels, strict=True) if not y and zlib.crc32(str(i).encode()) % 3 == 1]
    e = np.array([model.k * len(t) * np.exp(-model.lam * model.best(t)) for t in held])
    rates = [(x, (e < x).mean(), 1 - np.exp(-x)) for x in (0.05, 0.1, 0.3, 0.5, 1.0)]
    # segments of a few tokens score in steps, the law is continuous
    assert all(abs(have - want) < 0.13 for _, have, want in rates), (rates, model.lam, model.k)


def test_units_and_near_copies(spark):
    assert toxicity.units("abcdefghij") == ["abcdefghij", "abcdefgh*", "abcdefg*", "abcdef*", "abcde*"] and toxicity.units("abcde") == ["abcde"]
    model = toxicity.Model({"abcde*": 2.0, "abcdefg": -1.0})
    assert [model.of(t) for t in ("abcdefg", "abcdefh", "abcde", "x")] == [-1.0, 2.0, None, None]


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "a b", 0.5), (2, "a b", 0.5), (3, "x " * 50000, 0.5)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.op3_toxicity(d, lab).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.op3_toxicity(d.limit(0), lab.limit(0)).count() == 0


def test_a_faint_word_repeated_is_little_evidence():
    model = toxicity.Model({"faint": 0.1, "vile": 2.6, "scum": 2.6, "idiot": 2.6}, lam=1.9, k=0.002, a=-12.7, b=1.0)
    assert abs(model.best(["vile", "faint", "vile"]) - 5.3) < 1e-9
    assert model.score("faint " * 3784) < 0.01 < 0.7 < model.score("word " * 100 + "vile scum idiot " + "word " * 100)
