"""Toxicity by maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import arrow

_TOKEN = re.compile(r"\w+")
#: The bound of the model: labelled rows of each class that it is fitted on (those
#: with the smallest hash of the id). It keeps every token of theirs with |z| of
#: LEAST_Z at least.
MAX_TRAIN_PER_CLASS = 10_000
#: A word's units are itself and its beginnings of so many letters; the longest unit
#: with a score of its own gives the word's.
BEGINNINGS = range(8, 4, -1)
#: Words of which a worker keeps the score before it starts afresh.
MEMO = 200_000
#: The prior weighs this share of all counts; then the least |z|, the largest |score|, the score of a token without evidence.
PRIOR, LEAST_Z, CAP, DRIFT = 0.1, 2.5, 4.0, -0.03


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa, linear time) of a sequence
    given as runs ``(first, last, score of the run)`` in order: ``(first, last,
    score)`` of each, disjoint and in order. A run of one sign may stand for many
    tokens, since no maximal segment ends inside a negative run."""
    found: list[list[float]] = []  # first, last, sum before it, sum through it, index of the next candidate to its left
    total = 0.0
    for first, last, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        cand = [first, last, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cand[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= cand[3]:
                found.append([*cand, j])
                break
            cand = [found[j][0], cand[1], found[j][2], cand[3]]
            del found[j:]
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


@dataclass
class Model:
    """Scores of units and the calibration. ``weight`` is empty where training had
    no two classes; every score is then 0."""

    weight: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-3
    a: float = 0.0
    b: float = 0.0
    memo: dict[str, float | None] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def of(self, token: str) -> float | None:
        """The score of a token, None without evidence."""
        return next((self.weight[u] for u in units(token) if u in self.weight), None)

    def runs(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """Tokens with a score of their own, the gaps between them as one run each. From
        the third on, the k-th occurrence of a token scores 2 / k of it: log-odds are
        of texts that hold it, not of repeats, and a faint word repeated thousands of
        times would outweigh all else and flatten the curve."""
        memo, out, at, seen = self.memo, [], -1, {}
        if len(memo) > MEMO:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = self.of(t)
        for i, s in [(i, s) for i, s in enumerate(map(memo.__getitem__, tokens)) if s is not None]:
            seen[tokens[i]] = nth = seen.get(tokens[i], 0) + 1
            if out and i > at + 1:
                out.append((at + 1, i - 1, DRIFT * (i - at - 1)))
            out.append((i, i, s * min(1.0, 2 / nth)))
            at = i
        return out

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments ``(first token, last token, score, E-value)``:
        under K n exp(-lambda S) = 1 expected in a clean text of n tokens."""
        found = ((i, j, s, self.k * len(tokens) * math.exp(-min(700.0, self.lam * s))) for i, j, s in maximal_segments(self.runs(tokens)))
        return [x for x in found if x[3] < 1]

    def best(self, tokens: list[str]) -> float:
        """The score of the best segment; 0 where no token scores above 0."""
        return max((s for *_, s in maximal_segments(self.runs(tokens))), default=0.0)

    def evidence(self, found: list[tuple[int, int, float, float]], n: int) -> float:
        """Sum of -ln E over the significant segments of a text of n tokens."""
        return sum(self.lam * s - math.log(self.k * n) for *_, s, _ in found)

    def score(self, text: str | None) -> float:
        """The probability of label 1: a logistic curve of the evidence."""
        tokens = tokens_of(text)
        return self.curve(self.evidence(self.passages(tokens), len(tokens)))

    def curve(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.a + self.b * x)))) if self.weight else 0.0


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def units(token: str) -> list[str]:
    """What a token may be scored by: itself, then its beginnings from long to short
    (marked by a star), so that forms of a word share evidence."""
    return [token, *(token[:n] + "*" for n in BEGINNINGS if n < len(token))]


def gumbel(n: np.ndarray, best: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Lambda and K of the extreme-value law P(best segment < s) = exp(-K n e^(-lambda s))
    of texts of ``n`` tokens, by maximum likelihood; a text without a positive score
    (best 0) counts as censored there. Fewer than ten texts with one: lambda 1, which
    log-odds have by Karlin and Altschul's equation, and K alone is fitted."""
    hit = best > 0
    m = w[hit].sum()

    def k_of(lam: float) -> float:
        return (m + 0.5) / max(float(w @ (n * np.exp(-lam * best))), 1e-9)

    def slope(lam: float) -> float:
        return m / lam - float(w[hit] @ best[hit]) + k_of(lam) * float(w @ (n * best * np.exp(-lam * best)))

    lam = 1.0
    if hit.sum() >= 10:
        low, high = 1e-3, 100.0  # the slope falls from above 0 to below it
        for _ in range(80):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if slope(mid) > 0 else (low, mid)
        lam = math.sqrt(low * high)
    return lam, k_of(lam)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}
    for b in batches:
        for text, y, half in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            counts[half, y].update({u for t in set(tokens_of(text)) for u in units(t)})
        if sum(map(len, counts.values())) > 300_000:
            yield from map(_counted, (0, 1), [counts] * 2)
            for c in counts.values():
                c.clear()
    yield from map(_counted, (0, 1), [counts] * 2)


def _counted(half: int, counts: dict[tuple[int, int], Counter]) -> pa.RecordBatch:
    own = [counts[half, y] for y in (0, 1)]
    names = list(own[0].keys() | own[1].keys())
    cols = [pa.array(names, pa.string()), pa.array([half] * len(names), pa.int32())] + [pa.array([c[n] for n in names], pa.int64()) for c in own]
    return pa.RecordBatch.from_arrays(cols, names=["token", "half", "clean", "toxic"])


def log_odds(counts: DataFrame) -> list[tuple[str, float]]:
    """Tokens of ``counts(token, clean, toxic)`` with their log-odds under an
    informative Dirichlet prior (PRIOR times the pooled counts), for those
    with |z| of LEAST_Z at least. A token of one or two texts never reaches it, so
    their number is bounded by the words of the labelled rows."""
    total = counts.agg(F.sum("clean").alias("nc"), F.sum("toxic").alias("nt")).first()
    if not (total and total.nc and total.nt):
        return []
    alpha, whole = PRIOR * (F.col("clean") + F.col("toxic")), PRIOR * (total.nc + total.nt)
    odds = lambda y, n: F.log((y + alpha) / (n + whole - y - alpha))
    delta = odds(F.col("toxic"), total.nt) - odds(F.col("clean"), total.nc)
    z = delta / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    found = counts.select("token", delta.alias("d"), z.alias("z")).where(F.abs("z") >= LEAST_Z)
    return sorted((r.token, r.d) for r in found.select("token", "d").collect())


def training_ids(labels: DataFrame, per_class: int = MAX_TRAIN_PER_CLASS) -> DataFrame:
    """``(id, y, half, weight)`` of at most ``per_class`` labelled rows of either
    class, outside the held-out third (crc32 of the id's digits mod 3 is 1).
    Several labels of a document: toxic if any is. Null ids or labels are unused."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    crc = F.crc32(F.col("doc_id").cast("string"))
    one = one.where(crc % 3 != 1).withColumn("h", F.xxhash64("doc_id"))
    n = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [one.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    w = F.when(F.col("y") == 1, max(1.0, n.get(1, 0) / per_class)).otherwise(max(1.0, n.get(0, 0) / per_class))
    return parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("id"), "y", F.pmod("h", F.lit(2)).cast("int").alias("half"), w.alias("weight"))


#: Bins of a signature; of two rows with this share of equal bins one is a near copy.
BINS, ALIKE = 64, 0.5


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash over the 3-word shingles of a text, and its least hashes
    by bin."""
    for b in batches:
        least, signs = [], []
        for text in b.column(0).to_pylist():
            words = text.split()
            grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            h = np.fromiter((xxhash.xxh64_intdigest(g, 7) for g in grams), np.uint64, len(grams)) >> np.uint64(1)
            bins = np.full(BINS, -1, np.int64).view(np.uint64)
            np.minimum.at(bins, (h % np.uint64(BINS)).astype(np.int64), h)
            least.append(int(h.min()))
            signs.append(bins.view(np.int64))
        cols = [*b.columns, pa.array(least, pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "m", "sign"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model on a bounded sample of labelled rows (see ``training_ids``):
    log-odds of the units of all of them. For the calibration each half is scored
    by the log-odds of the other: the clean texts give the extreme-value law of the
    best segment, all texts the logistic curve that turns the evidence of a text
    into the probability of label 1.

    Copies and near copies in a class count once, so that a copied text doesn't
    make its rare words look toxic: a row goes if its least shingle hash is that of
    a row with a smaller id and half of their signatures' bins agree."""
    # At most 2 x MAX_TRAIN_PER_CLASS rows of 28 bytes are broadcast.
    ids = F.broadcast(training_ids(labels))
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id").where("text is not null")
    train = train.select("text", "y", "half", "weight", "id").transform(arrow, _marks, "text string, y int, half int, weight double, id long, m long, sign array<long>")
    of = Window.partitionBy("y", "m").orderBy("id", "text")
    same = lambda x, y: F.when((x == y) & (x >= 0), 1).otherwise(0)
    filled = lambda x, y: F.when((x >= 0) | (y >= 0), 1).otherwise(0)
    total = lambda f: F.aggregate(F.zip_with("sign", "lead", f), F.lit(0), lambda a, b: a + b)
    train = train.withColumn("lead", F.first("sign").over(of)).withColumn("n", F.row_number().over(of))
    train = train.where((F.col("n") == 1) | (total(same) < ALIKE * total(filled)))
    train = train.select("text", "y", "half", "weight").persist()
    counts = train.transform(arrow, _count_batches, "token string, half int, clean long, toxic long")
    counts = counts.groupBy("token", "half").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    both = counts.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = lambda odds: {t: max(-CAP, min(CAP, d)) for t, d in odds}
    model = Model(held(log_odds(both)))
    if model.weight:
        others = [Model(held(log_odds(counts.where(F.col("half") == 1 - h)))) for h in (0, 1)]
        seen = train.where("y = 0").transform(arrow, _best_batches(others), "n long, best double, weight double").collect()
        if any(r.n for r in seen):
            model.lam, model.k = gumbel(*(np.array([r[i] for r in seen if r.n], float) for i in range(3)))
        for m in others:
            m.lam, m.k = model.lam, model.k
        rows = train.transform(arrow, _final_batches(others), "y int, weight double, x double").collect()
        model.a, model.b = logistic([r.x for r in rows], [r.y for r in rows], [r.weight for r in rows])
    counts.unpersist()
    train.unpersist()
    return model


def _best_batches(others: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [tokens_of(t) for t in b.column(0).to_pylist()]
            best = [others[h].best(t) for t, h in zip(tokens, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, tokens), pa.int64()), pa.array(best, pa.float64()), b.column(3)], names=["n", "best", "weight"])

    return run


def _final_batches(others: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [tokens_of(t) for t in b.column(0).to_pylist()]
            x = [others[h].evidence(others[h].passages(t), len(t)) for t, h in zip(tokens, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(x, pa.float64())], names=["y", "weight", "x"])

    return run


def logistic(x: list[float], y: list[int], w: list[float]) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression on the evidence
    of texts, lightly ridged so that separable classes give finite values."""
    X, t, w = np.column_stack([np.ones(len(x)), np.array(x, float)]), np.array(y, float), np.array(w, float)
    beta = np.zeros(2)
    if not len(t):
        return 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -35, 35)))
        grad = X.T @ (w * (t - p)) - 0.01 * beta
        hess = (X * (w * p * (1 - p))[:, None]).T @ X + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


PASSAGE = "array<struct<start:int,end:int,score:double,e_value:double>>"


def _score_batches(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, passages = [], []
            for text in b.column(1).to_pylist():
                tokens = tokens_of(text)
                found = model.passages(tokens)
                scores.append(model.curve(model.evidence(found, len(tokens))))
                spans = []
                if found:
                    # lower() may change lengths; offsets are then those of the lower-cased text
                    at = [m.span() for m in _TOKEN.finditer(text.lower())]
                    spans = [{"start": at[i][0], "end": at[j][1], "score": s, "e_value": e} for i, j, s, e in found]
                passages.append(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, passages)`` for every row: the probability of label 1 and
    the significant passages (character spans of the lower-cased text). Only the
    text is read, so other columns may have any name. Null and empty texts score as
    texts without evidence; equal texts score alike, each row (repeated, or with a
    null id) by itself; an empty table gives no rows. A very long text is scored
    whole, in time and memory linear in its tokens; a longer text needs a higher
    segment score for the same E-value."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.transform(arrow, _score_batches(model), f"doc_id {kind}, score double, passages {PASSAGE}")


def op3_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The query's columns; odd rows as in ``score``. Without labels of both classes
    every score is 0. A null id isn't held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged;
    odd rows as in ``score``: null and empty texts stay."""
    model = fit(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.score(t) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.transform(arrow, run, docs.schema)
