"""The Jaccard join against all pairs, the label model's parts, and the pipeline's decisions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, jaccard_join, secret_scan, shingles, toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def groups(texts, threshold=0.8):
    """{id: (class_id, copy_id, n_copies, n_links)} by comparing all pairs."""
    def words(t):
        out, word = [], ""
        for c in (t or "").lower() + " ":
            if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
                out += [word] if word else []
                word = ""
            else:
                word += c
        return out

    def shingle(t):
        w = words(t)
        if not w:  # equal only to itself
            return frozenset({("text", t or "")})
        return frozenset(tuple(w[i : i + 5]) for i in range(max(min(len(w), 1), len(w) - 4)))

    copies = {}
    for i, t in texts:
        copies.setdefault(shingle(t), []).append(i)
    classes = sorted(copies, key=lambda s: min(copies[s]))
    root = {s: s for s in classes}
    links = dict.fromkeys(classes, 0)

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, x in enumerate(classes):
        for y in classes[:a]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = {}
    for s in classes:
        least[find(s)] = min(least.get(find(s), 1 << 60), min(copies[s]))
    return sorted((i, least[find(s)], min(copies[s]), len(copies[s]), links[s]) for s in classes for i in copies[s])


def random_texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.randint(40, 120))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


def test_hot_classes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 3)
    texts = list(enumerate([*random_texts(30), *["a hot text of some words that stands there often"] * 40, *[" "] * 9]))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(df).collect()) == groups(texts)


@pytest.mark.parametrize("block", [768, 4])
def test_all_pairs(spark, block):
    texts = list(enumerate([*random_texts(), None, "", " ", " ", "!!!", "{}[]", "!!!", "one two", "One, two!", "é é é é é é", "long " * 4000]))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, cls string")
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(df, block=block).collect())
    assert got == groups(texts)


def test_repeated_ids(spark):
    texts = random_texts(12)
    rows = [(i % 5, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_join.near_duplicates(df).count() == len(rows)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_one_of_each(spark):
    docs = table(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(i for i, c, *_ in groups(texts) if i == c)
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect()) == want


def test_pruning_bound():
    assert jaccard_join.least_agreements(16, 0.8, 1e-6) < jaccard_join.least_agreements(96, 0.8, 1e-6) < 0.8 * 96
    # a pair at the threshold is rarely dropped: the sum over agreements below the bound
    least = jaccard_join.least_agreements(96, 0.8, 1e-6)
    rng = np.random.default_rng(0)
    assert (rng.binomial(96, 0.8, 200_000) < least).mean() < 1e-4


def test_shingles():
    a, b = "The  quick-brown Fox, jumps over", "the quick brown fox jumps over"
    assert (shingles.shingle_set(a) == shingles.shingle_set(b)).all() and len(shingles.shingle_set(b)) == 2
    assert len(shingles.shingle_set("")) == len(shingles.shingle_set(" .,")) == 0 and len(shingles.shingle_set("x y")) == 1
    words = [f"w{i}" for i in range(5000)]
    assert len(np.unique(shingles.word_hashes(" ".join(words)))) == 5000
    assert (shingles.word_hashes("b a") == shingles.word_hashes("a b")[::-1]).all()
    sets = shingles.shingle_set(" ".join(words)), shingles.shingle_set(" ".join(words[1000:]))
    m = shingles.MinHasher(512)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((m(sets[0]) == m(sets[1])).mean() - true) < 0.08


# toxicity


def labelled(spark, n=1200):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice("abcdefghij") * 3 + rng.choice("klmnop") for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(("vileword", "badword"))
            words[rng.randrange(30)] = rng.choice(("vileword", "badword"))
        docs.append((i, " ".join(words), "s", 0.5))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame([*docs, (9001, None, "s", 0.5), (9002, "", "s", 0.5)], "doc_id long, text string, source string, score double"), spark.createDataFrame([*labels, (77777, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), {i: "vileword" in t or "badword" in t for i, t, *_ in docs})


def test_scores(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    assert {r.doc_id: r.predicted for r in rows if r.doc_id > 9000} == {9001: 0, 9002: 0}
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == {i for i, t in truth.items() if not t} | {9001, 9002}


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark, 600)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    pick = lambda y: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_toxicity(docs, y).collect())
    assert pick(labels) == pick(flipped)


def test_no_labels(spark):
    docs, labels, _ = labelled(spark, 20)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    unnamed = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.held_out for r in toxicity.score_toxicity(unnamed, labels).collect()] == [False]


def test_discount_of_voters_that_repeat():
    """Two voters that always fire together weigh about as much as one alone."""
    votes = np.array([[1, 1, 0]] * 50 + [[0, 0, 1]] * 50 + [[1, 1, 1]] * 50 + [[0, 0, 0]] * 50, float)
    single = np.stack([np.zeros(4), np.concatenate(([200.0], votes.sum(axis=0)))])
    assert np.allclose(toxicity._discount(single, votes.T @ votes, np.ones(3)), [2, 2, 1], atol=0.05)


# pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert one.columns == columns
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, SF, "labels")).collect() if r.predicted}
    ids = {r.doc_id for r in one.collect()}
    assert ids == set(texts) - bad
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF)
    kept = {i for i, c, *_ in groups([(i, texts[i]) for i in sorted(ids)]) if i == c}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == kept
    three = corpus_pipeline.drop_benchmark_leaks(spark, two, SF)
    leaks = {r.doc_id for r in decontam.contaminated(two, table(spark, SF, "benchmark")).collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == kept - leaks
    four = corpus_pipeline.redact_secrets(spark, three, SF)
    assert four.columns == columns
    for r in four.collect():
        assert r.text == secret_scan.redact(texts[r.doc_id], secret_scan.scan(texts[r.doc_id])) and r.n_chars == len(r.text)
    five = {r.doc_id: r for r in corpus_pipeline.encode(spark, four, SF).collect()}
    run = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == five and set(run) == kept - leaks
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secret_scan", "bpe"]
