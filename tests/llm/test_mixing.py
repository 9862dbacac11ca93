import random
from collections import Counter

import numpy as np
import pytest

from symgraph.llm import mixing


def test_permutations():
    for n in (1, 2, 3, 17, 256, 1000):
        p = mixing.permute(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n)) and (mixing.permute(p, n, 9, back=True) == np.arange(n)).all()


def test_targets_by_resharing():
    def brute(sizes, weights):
        t, open_ = [0.0] * len(sizes), set(range(len(sizes)))
        rest = float(sum(sizes))
        while open_:
            share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
            over = [i for i in open_ if share[i] > 3 * sizes[i] + 1e-9]
            if not over:
                for i in open_:
                    t[i] = share[i]
                break
            for i in over:
                t[i] = 3.0 * sizes[i]
                rest -= t[i]
                open_.discard(i)
        return t

    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 5, 100, 3000]) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(brute(sizes, weights))
    assert mixing.targets([], []) == []


def table(spark, n=400):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 1, 7, 40, 300]))), "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(n)]
    rows += [(1000, "a\tb\n c", None, 1), (1001, None, "s1", 1), (1002, None, None, 1), (None, "x y", "s2", 1), (5, rows[5][1], rows[5][2], 1), (5, rows[5][1], rows[5][2], 1), (6, "other text", "s2", 1), (1003, "long " * 30000, "é", 1), (1004, "tiny", "z", 1)]
    return rows, spark.createDataFrame([(*r[:3], "en", 2) for r in rows], "doc_id long, text string, source string, lang string, size int")


def test_words_taken(spark):
    rows, df = table(spark)
    got = mixing.op6_mixing(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    per = Counter()
    for _, t, s, *_ in rows:
        per[s] += size(t)
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(names, mixing.targets([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    p = mixing.plan(df).collect()
    for s in names:
        assert sum(r.taken for r in p if r.source == s) == round(goal[s])
        assert {(r.source_size, r.target) for r in p if r.source == s} == {(per[s], goal[s])}
    again = mixing.op6_mixing(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_texts_hold_the_words_taken(spark):
    rows, df = table(spark)
    mixed = mixing.mixed_documents(df.select("doc_id", "text", "lang", "source"))
    assert mixed.columns == ["doc_id", "text", "lang", "source"]
    words = Counter()
    for r in mixed.collect():
        words[(r.doc_id, r.source)] += len(r.text.split())
    want = Counter()
    for r in mixing.plan(df).collect():
        want[(r.doc_id, r.source)] += r.taken
    assert words == +want
    have = {(i, s): t for i, t, s, *_ in rows}
    assert all(set(r.text.split()) <= set((have[(r.doc_id, r.source)] or "").split()) or r.doc_id == 6 for r in mixed.collect())


def brute_plan(rows, block, seed, slots):
    """Slot by slot in Python: words of each row by shard, and the slots of each
    source by shard. The library's permutation and generator are taken as given."""
    by = {}
    for n, (_, t, s) in enumerate(rows):
        by.setdefault(s, []).append(n)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    streams = []
    for s in names:  # the order within a source is found from the plan
        streams.append([n for n in by[s] for _ in (rows[n][1] or "").split()])
    goal = [round(x) for x in mixing.targets([len(x) for x in streams], [(5, 2, 1)[i % 3] for i in range(len(names))])]
    need = []
    for i, x in enumerate(streams):
        order, left = [], goal[i]
        nb, e = -(-len(x) // block), 0
        while left > 0:
            for b in mixing.permute(np.arange(nb), nb, mixing._key(seed, i, e)).tolist():
                n = min(left, len(x[b * block : (b + 1) * block]))
                if left > 0:
                    order.append((b, n))
                left -= n
            e += 1
        need.append(order)
    total = sum(map(len, need))
    shards, used, words, counts = -(-total // slots), [0] * len(names), {}, {}
    p = np.array([len(x) for x in need], float)
    for h in range(shards + 1):
        drawn = np.random.default_rng([seed, h]).multinomial(min(slots, total), p / p.sum()) if h < shards else [len(x) for x in need]
        for i, n in enumerate(drawn):
            for b, w in need[i][used[i] : used[i] + n]:
                counts[h, names[i]] = counts.get((h, names[i]), 0) + 1
                for n_row in streams[i][b * block : b * block + w]:
                    words[n_row, h] = words.get((n_row, h), 0) + 1
            used[i] = min(len(need[i]), used[i] + int(n))
    return words, counts


@pytest.mark.parametrize("seed", [20, 21])
def test_plan_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 7)
    rng = random.Random(4)
    raw = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 1, 7, 40, 90]))), rng.choice(["hot", "hot", "a", "b", None])) for i in range(60)]
    df = spark.createDataFrame(raw, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.plan(df, block=16, seed=seed, ranges=True).collect()}
    # one lane: documents of a source are in the order of their ids
    words, counts = brute_plan(sorted(raw), 16, seed, 7)
    for i, t, _ in raw:
        want = {h: n for (k, h), n in words.items() if k == i}
        have = Counter()
        for r in got[i].ranges:
            have[r["shard"]] += r["n"]
        assert have == want and got[i].taken == sum(want.values()) and got[i].shards == sorted(want)
    assert len({h for h, _ in counts}) > 3


def test_the_draws_change_the_shards(spark):
    _, df = table(spark)
    both = [{(r.doc_id, r.thash): r.shards for r in mixing.plan(df, block=8, seed=s).collect()} for s in (20, 21)]
    assert both[0] != both[1]


def test_clashing_columns_and_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 3)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(50)), "s", i, i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key long, thash long, ord long, shard long, `a.b` long")
    out = mixing.mixed_documents(df, block=16)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r.doc_id == r.key == r.thash == r.ord == r.shard == r["a.b"] for r in got) and len(got) > 40
    words = Counter(w for r in got for w in r.text.split())
    assert set(words.values()) == {1} and len(words) == 2000


def test_empty(spark):
    _, df = table(spark)
    assert mixing.op6_mixing(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    none = df.where("text is null")
    assert [r.taken for r in mixing.op6_mixing(none).collect()] == [0, 0]


def test_texts_that_share_an_id_with_texts_that_give_nothing(spark):
    texts = ["", None, " \t"] + [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    df = spark.createDataFrame([(i % 3, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.plan(df).groupBy("doc_id").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    words = Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r.doc_id] += len(r.text.split())
    assert words == taken and sum(taken.values()) > 0
