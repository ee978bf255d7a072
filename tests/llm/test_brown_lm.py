import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import brown_lm as B


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def base_scores(texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(t for i, x in texts.items() if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for i, x in texts.items()}


@pytest.mark.parametrize("head", [20, 60_000])
def test_base_and_gain(spark, head):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = base_scores({r.doc_id: r.text for r in df.collect()})
    got = B.score_texts(df, head=head, clustered=min(head, 300)).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    # the classes tell something of texts that were not learned from
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_probabilities_sum_to_one():
    """The transitions and emissions that score_texts builds, on a toy table."""
    n = np.array([[5, 2, 0], [1, 7, 3], [2, 0, 4]])
    of = B.exchange(n, 2, 2)
    assert of[2] == max(of[:2].max() + 1, 2)
    member = np.eye(int(of.max()) + 1)[of]
    moves = member.T @ n @ member
    mass = member.T @ (n.sum(axis=0) + 0.5)
    shares = (moves + 4 * mass / mass.sum()) / (moves.sum(axis=1, keepdims=True) + 4)
    assert np.allclose(shares.sum(axis=1), 1)


def test_exchange_finds_blocks():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 3, 30)
    n = np.where(kind[:, None] == (kind[None, :] + 1) % 3, 50, 0) + rng.integers(0, 2, (30, 30))
    of = B.exchange(n, 30, 3)
    assert len({(a, b) for a, b in zip(kind.tolist(), of.tolist())}) == 3


def test_exchange_never_lowers_likelihood():
    rng = np.random.default_rng(1)
    n = rng.poisson(1.5, (20, 20))

    def likelihood(of):
        member = np.eye(int(of.max()) + 1)[of]
        m = member.T @ n @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))

    start = np.concatenate([np.arange(16) % 4, 4 + np.arange(4)])
    assert likelihood(B.exchange(n, 16, 4)) >= likelihood(start)


def test_inserted_word_joins_its_kind():
    """Words that stand like those of a class join it, by the whole likelihood tried class by class."""
    rng = np.random.default_rng(2)
    m = rng.integers(1, 60, (5, 5)).astype(float)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    for _ in range(50):
        row, col = rng.integers(0, 9, 5).astype(float), rng.integers(0, 9, 5).astype(float)
        tried = []
        for k in range(3):
            t = m.copy()
            t[k] += row
            t[:, k] += col
            out, into = m.sum(axis=1), m.sum(axis=0)
            out[k] += row.sum()
            into[k] += col.sum()
            tried.append(f(t) - f(out) - f(into))
        assert tried[B.best_class(m, 3, row, col)] == pytest.approx(max(tried), abs=1e-5)


def test_score_by_brute_force(spark):
    """The score of every text from its words' classes, counted again by plain Python."""
    rng = np.random.default_rng(4)
    texts = {i: " ".join(f"{'ab'[j % 2]}{rng.integers(0, 8)}" for j in range(rng.integers(0, 30))) for i in range(80)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    of = {}
    keep = B.Symbols.classed

    def classed(self, classes):
        out = keep(self, classes)
        of.update({w: int(classes[i]) for w, i in out.words.items()})
        return out

    B.Symbols.classed = classed
    try:
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.score for r in B.score_texts(df, clustered=5, classes=3).collect()}
    finally:
        B.Symbols.classed = keep
    rare = max(of.values()) + 1
    line = lambda i: [t.encode() for t in texts[i].split()] + [b""]
    train = [line(i) for i in texts if not held[i]]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    cls = lambda w: of.get(w, rare)
    tokens, kinds = Counter(), Counter({rare: 1})
    for w, k in c.items():
        tokens[cls(w)] += k
        kinds[cls(w)] += 1
    mass = {k: tokens[k] + 0.5 * kinds[k] for k in range(rare + 1)}
    moves = Counter((cls(a), cls(b)) for x in train for a, b in zip([b"", *x], x))
    outs = Counter()
    for (a, _), k in moves.items():
        outs[a] += k
    for i in texts:
        want, before = 0.0, cls(b"")
        for w in line(i):
            k = cls(w)
            want += math.log10((moves[before, k] + 4 * mass[k] / (n + 0.5 * (v + 1))) / (outs[before] + 4)) + math.log10((c[w] + 0.5) / mass[k])
            before = k
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_edge_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "A b\ta", 1.0), (3, "A b\ta", 1.0), (None, "x", 1.0), (9, "word " * 3000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = B.score_texts(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 4, 4, 3001]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert B.score_texts(df.limit(0)).count() == 0
