import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from symgraph.llm import linededup
from symgraph.llm.common import shared_filter

LINE, PLACES = linededup.LINE_WORDS, linededup.PLACES
words = lambda rng, n: " ".join(f"{rng.choice('abcé')}{rng.randrange(10**6)}" for _ in range(n))


def line_hash(some):
    h, of = linededup.word_hashes([" ".join(some).encode()])
    return int(linededup.lines_in(h, of)[1][0])


def chosen(text, hashes):
    """(line, occurrence) by the word it begins at, place by place."""
    own = text.split()
    h = []
    for i in range(len(own) - LINE + 1):
        key = tuple(own[i : i + LINE])
        h.append(hashes.setdefault(key, line_hash(key)))
    picked = set()
    for last in range(PLACES - 1 + len(h)):
        some = [(h[i], -i) for i in range(max(0, last - PLACES + 1), min(len(h), last + 1))]
        if some:
            picked.add(-min(some)[1])
    out, seen = {}, {}
    for i in sorted(picked):
        key = tuple(own[i : i + LINE])
        seen[key] = seen.get(key, 0) + 1
        out[i] = (key, seen[key])
    return out


def brute(rows):
    """The words that each text loses, by comparing words; no library code but the
    hash that picks a place."""
    hashes, first, gone = {}, {}, []
    for n, t in sorted(((i, t) for i, t in rows if i is not None and t), key=lambda r: r[0]):
        for at, line in chosen(t, hashes).items():
            if line not in first or (first[line][0] == n and at < first[line][2]):
                first[line] = (n, t.split(), at)
    for i, t in rows:
        lost, own = set(), (t or "").split()
        for at, line in (chosen(t, hashes) if t and i is not None else {}).items():
            o, theirs, there = first[line]
            if o >= i:
                continue
            left = right = 0
            while left < min(PLACES, at, there) and own[at - left - 1] == theirs[there - left - 1]:
                left += 1
            while right < PLACES and at + LINE + right < len(own) and there + LINE + right < len(theirs) and own[at + LINE + right] == theirs[there + LINE + right]:
                right += 1
            lost |= set(range(at - left, at + LINE + right))
        gone.append(lost)
    return gone


def outcome(spark, rows, kind="doc_id long, text string"):
    df = spark.createDataFrame(rows, kind)
    out, lost = linededup.dedup_flagged(df)
    return {(r["doc_id"], r["text"]): r[lost] for r in out.collect()}


def corpus():
    rng = random.Random(6)
    passage, two, head = words(rng, 55), [words(rng, 20), words(rng, 35)], words(rng, 8)
    rows = []
    for i in range(60):
        own = [words(rng, rng.randint(3, 60)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            own[rng.randrange(len(own))] += " " + passage + " " + words(rng, 4)
        if i % 4 == 1:
            own[1:1] = two
        if i % 7 == 2:
            own.append(" ".join(rows[i - 2][1].split()[5 : rng.randint(20, 90)]))
        rows.append((i, "\n".join([head, *own])))
    rows += [(100, rows[7][1]), (101, rows[7][1] + "\n" + words(rng, 9)), (102, None), (103, ""), (104, " \n\t"), (None, rows[0][1])]
    rows += [(105, "\n".join(["rep eat"] * 40 + two)), (106, "\n".join(["rep eat"] * 50)), (107, passage + " " + words(rng, 6) + " " + passage), (108, two[1] + "\n" + two[0] + " " + passage)]
    rows.append((109, " ".join(rows[11][1].split()[50:] + rows[11][1].split()[:50])))
    return rows, passage, two


def test_against_brute_force(spark):
    rows, passage, two = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, pos int")
    got = {r.doc_id: r for r in linededup.op7_line_dedup(df).collect()}
    kept = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert len(got) == len(rows)
    for (i, t), lost in zip(rows, brute(rows), strict=True):
        want = [x for p, x in enumerate((t or "").split()) if p not in lost]
        assert got[i].removed_words == len(lost), i
        assert (i in kept) == (bool(want) or not lost), i
        if i in kept:
            assert (kept[i] or "").split() == want, i
            assert got[i].kept_chars == len(kept[i] or "") and got[i].kept_sha256 == hashlib.sha256((kept[i] or "").encode()).hexdigest()
    assert sum(passage in (t or "") for i, t in kept.items() if i is not None) == 1
    assert sum(all(x in (t or "") for x in two) for i, t in kept.items() if i is not None) == 1
    assert 100 not in kept and None in kept and got[101].n_blocks == 1 and got[109].n_moved > 0


def test_every_run_of_32_words_goes(spark):
    """Against all pairs of documents, by words alone."""
    rng = random.Random(11)
    runs = [words(rng, n) for n in (32, 33, 40, 60, 24, 300)]
    rows = []
    for i in range(50):
        x, y = rng.sample(runs, 2)
        rows.append((i, f"{words(rng, rng.randrange(9))} {x} {words(rng, rng.randrange(1, 40))}.\n{y}\t{words(rng, 3)}"))
    got = outcome(spark, rows)
    for i, t in rows:
        own, held = t.split(), set()
        for _, other in rows[:i]:
            theirs = other.split()
            grams = {tuple(theirs[k : k + 32]) for k in range(len(theirs) - 31)}
            for k in range(len(own) - 31):
                if tuple(own[k : k + 32]) in grams:
                    held |= set(range(k, k + 32))
        kept = next(t for n, t in got if n == i)
        assert kept.split() == [x for k, x in enumerate(own) if k not in held], i


def test_the_whole_block_goes_although_an_earlier_document_holds_its_halves_in_turn(spark):
    rng = random.Random(2)
    a, b = words(rng, 16), words(rng, 16)
    rows = [(1, f"{b} {words(rng, 40)} {a}"), (2, f"{words(rng, 9)}\n{a}\n{b}\n{words(rng, 9)}"), (3, f"{words(rng, 12)} {a} {b} {words(rng, 12)}")]
    got = {i: (t, x) for (i, t), x in outcome(spark, rows).items()}
    assert got[3][1]["words"] == 32 and a not in got[3][0] and b not in got[3][0] and got[2][1] is None


def test_a_block_that_no_document_holds_stays(spark):
    rng = random.Random(3)
    ten = [words(rng, 10) for _ in range(3)]
    rows = [(i, f"{words(rng, 20)}\n{ten[i]}\n{words(rng, 20)}") for i in range(3)] + [(9, "\n".join([words(rng, 5), *ten, words(rng, 5)]))]
    assert all(x is None for x in outcome(spark, rows).values())


def test_a_common_short_line_in_an_older_document_saves_no_copy(spark):
    rng = random.Random(5)
    ten = [words(rng, 20) for _ in range(10)]
    rows = [(1, f"{words(rng, 30)}\nThanks.\n{words(rng, 30)}"), (2, "\n".join(f"{x}\nThanks." for x in ten)), (3, "\n".join(f"{x}\nThanks." for x in ten))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in linededup.dedup(df).collect()) == [1, 2]


def test_rows_that_share_an_id_keep_what_differs(spark):
    text = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 61), (2, text + "\nown", 9), (2, "something else\nown", 18), (2, text + "\nown", 9)], "doc_id long, text string, n_chars int")
    got = sorted((r.text, r.n_chars) for r in linededup.dedup(df).where("doc_id = 2").collect())
    assert got == [("own", 3), ("own", 3), ("something else\nown", 18)]
    assert linededup.dedup(df.limit(0)).count() == 0 and linededup.op7_line_dedup(df.limit(0)).count() == 0


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(8)
    long = words(rng, 90_000)
    rows = [(1, long, 1, 2, 3, 4, 5), (2, words(rng, 30) + " " + long[200_000:700_000], 1, 2, 3, 4, 5), (3, "x", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lost int, key int, sets int, new int, `a.b` int")
    out = {r.doc_id: r for r in linededup.dedup(df).collect()}
    assert df.columns == linededup.dedup(df).columns and all(tuple(r)[2:] == (1, 2, 3, 4, 5) for r in out.values())
    assert out[1].text == long and 30 <= len(out[2].text.split()) <= 32
    h, of = linededup.word_hashes([long.encode()])
    assert np.array_equal(linededup._long_hashes(long.encode()), h) and not of.any()


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    some = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage = some(60)
    rows = [(1, some(30) + passage + some(9)), (2, some(20) + "。" + passage + some(8))]
    got = {i: t for i, t in outcome(spark, rows)}
    assert passage in got[1] and got[2] == rows[1][1].replace(passage, "")


def test_what_is_left_of_a_text():
    assert linededup.without("a b c d", [(1, 3)]) == ("a d", 2) and linededup.without("a\nb c\nd", [(1, 3)]) == ("a\nd", 2)
    assert linededup.without("a b c\nd", [(1, 3)]) == ("a\nd", 2) and linededup.without(" a b ", [(0, 1)]) == (" b ", 1)
    assert linededup.without("a b \n", [(1, 99)]) == ("a \n", 1) and linededup.without(" a b\n", [(0, 2)])[0].strip() == ""
    assert linededup.without("a b c d e", [(3, 4), (0, 2), (1, 2)]) == ("c e", 3) and linededup.without("", []) == ("", 0)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(12)))
def test_patience_is_a_longest_increasing_run(y):
    got = linededup.patience(np.array(y))
    best = []
    for n, v in enumerate(y):
        best.append(1 + max([best[k] for k in range(n) if y[k] < v], default=0))
    assert len(got) == max(best) and (np.diff(got) > 0).all() and (np.diff(np.array(y)[got]) > 0).all()


def test_moved_blocks_are_aligned_in_a_later_pass():
    got = linededup.align(np.array([0, 30, 60, 200]), np.array([100, 130, 160, 0]))
    assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 1)]
    assert linededup.align(np.array([20, 0, 25, 33]), np.array([27, 7, 32, 41])) == [(1, 2, 0), (3, 3, 0)]


@pytest.mark.parametrize("n", [0, 24, 25, 26, 31, 32, 200])
def test_lines_cover_texts(n):
    rng = random.Random(n)
    text = [words(rng, n).encode(), words(rng, 40).encode()]
    place, h = linededup.lines_in(*linededup.word_hashes(text))
    own = place[place < n]
    assert len(set(h.tolist())) == len(h)
    if n >= LINE:
        assert own[0] == 0 and own[-1] == n - LINE and (np.diff(own) <= PLACES).all()


def test_a_filter_leaves_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = shuffled()
    f = shared_filter(spark.range(20000).groupBy((F.col("id") % 5000).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"))
    assert f.holds(np.arange(5000, dtype=np.uint64)).all() and not f.holds(np.arange(5000, 9000, dtype=np.uint64)).any()
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
