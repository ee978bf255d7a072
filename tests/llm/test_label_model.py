"""The label model of the toxicity operator against plain loops, and voters for clean."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X


def plain_fit(texts, sample, width, rounds):
    """(balance, rates by class, discounts): expectation maximisation, one text and voter at a time."""
    voters = range(width)
    clip = lambda x, low, high: min(max(x, low), high)

    def rates(docs, fired):
        return [[clip((fired[c][i] + 0.5) / (docs[c] + 1), 1e-5, 1 - 1e-5) for i in voters] for c in (0, 1)]

    def discounts(docs, fired, together):
        n = max(docs[1], 1.0)
        out = []
        for i in voters:
            total = 1.0
            for j in voters:
                a, b = fired[1][i] / n, fired[1][j] / n
                spread = math.sqrt(max(a * (1 - a), 1e-6)) * math.sqrt(max(b * (1 - b), 1e-6))
                total += clip((together[i, j] / n - a * b) / spread, 0, 1) if i != j else 0
            out.append(total)
        return out

    known, known_fired, together = [0, 0], [[0] * width, [0] * width], Counter()
    for votes, y in sample:
        known[y] += 1
        for i in votes:
            known_fired[y][i] += 1
            if y:
                together.update((i, j) for j in votes)
    discount = discounts(known, known_fired, together)
    balance, rate = clip(known[1] / sum(known), 1e-3, 0.5), rates(known, known_fired)
    for last in [False] * (rounds - 1) + [True]:
        docs, fired, together = [0.0, 0.0], [[0.0] * width, [0.0] * width], Counter()
        for votes in texts:
            odds = math.log(balance / (1 - balance))
            for i in voters:
                says = math.log(rate[1][i] / rate[0][i]) if i in votes else math.log((1 - rate[1][i]) / (1 - rate[0][i]))
                odds += says / discount[i]
            toxic = 1 / (1 + math.exp(-clip(odds, -30, 30)))
            for c, share in ((0, 1 - toxic), (1, toxic)):
                docs[c] += share
                for i in votes:
                    fired[c][i] += share
            for i in votes:
                for j in votes:
                    together[i, j] += toxic
        scale = sum(docs) / max(1, sum(known))
        both = [docs[c] + scale * known[c] for c in (0, 1)]
        all_fired = [[fired[c][i] + scale * known_fired[c][i] for i in voters] for c in (0, 1)]
        balance, rate = clip(both[1] / sum(both), 1e-3, 0.5), rates(both, all_fired)
        if last:
            discount = discounts(docs, fired, together)
    return balance, rate, discount


def drawn(seed, texts, width):
    """Texts of two classes: half the voters for toxic, one of them twice, half for clean."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(texts):
        y = int(rng.random() < 0.3)
        votes = {i for i in range(1, width) if rng.random() < (0.5 if (i < width // 2) == bool(y) else 0.1)}
        out.append((frozenset(votes | {0} if 1 in votes else votes), y))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_fit_by_brute_force(spark, seed):
    width, all_ = 8, drawn(seed, 300, 8)
    sample = all_[:60]
    x = np.zeros((len(sample), width))
    for i, (votes, _) in enumerate(sample):
        x[i, sorted(votes)] = 1
    patterns = Counter(votes for votes, _ in all_)
    df = spark.createDataFrame([(sorted(v), n) for v, n in patterns.items()], "votes array<int>, n long").repartition(3)
    model = X.fit_label_model(df, x, np.array([y for _, y in sample]), rounds=4)
    balance, rate, discount = plain_fit([v for v, _ in all_], sample, width, 4)
    assert model.balance == pytest.approx(balance, abs=1e-9)
    assert np.allclose(model.rates, rate, atol=1e-9) and np.allclose(model.discount, discount, atol=1e-9)
    assert model.discount[0] > 1.5  # the voter that repeats another
    truth = np.array([y for _, y in all_])
    votes = np.zeros((len(all_), width))
    for i, (v, _) in enumerate(all_):
        votes[i, sorted(v)] = 1
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.85


def test_voters_for_clean(spark):
    rows = [("awful filth", 1)] * 20 + [("lovely garden", 0)] * 40
    sample = spark.createDataFrame(rows, "text string, y int")
    names, toxic, clean = X._mined(sample, 4, 3)
    assert (toxic, clean) == (20, 40)
    marks = [m.rstrip("*") for m, _ in names]
    assert all("awful".startswith(m) or "filth".startswith(m) for m in marks[:4]) and len(marks) == 7
    assert all("lovely".startswith(m) or "garden".startswith(m) for m in marks[4:])
    assert len(X._mined(sample, 4)[0]) == 4


def test_clean_words_lower_a_score(spark):
    """A text with a word of clean texts beside a toxic one scores below the toxic word alone."""
    texts = {i: "awful stuff here" if i % 3 == 0 else "lovely garden here" for i in range(240)}
    texts |= {1000: "awful lovely garden", 1001: "awful", 1002: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = docs.where("doc_id < 240").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    score = {r.doc_id: r.score for r in X.score_toxicity(docs, labels).collect()}
    assert score[1001] > score[1000] and score[0] > 0.5 > score[1]
    assert all(0 <= s <= 1 for s in score.values())
