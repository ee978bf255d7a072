"""Toxicity by weak supervision (operator 3).

1. Voters. On a bounded sample of labelled training rows, every word (lexicon entry) and every
   word beginning (pattern) is counted by class; those that stand out most in toxic texts become
   voters for toxic, those that stand out most in clean ones voters for clean, each at one and at
   several occurrences.
2. Votes. Every whole text is read once; what remains of it is the list of voters that fire.
3. Label model. A generative model of the true class and the votes is fitted by expectation
   maximisation on the vote patterns of all documents, with the labelled sample's counts as prior:
   it estimates the class balance and each voter's firing rates by class (its accuracy), and, from
   the posterior, the correlation of each two voters within a class. A voter's weight is divided
   by one plus its correlations, so voters that repeat each other count once together.
4. Classifier. A logistic regression over the votes is trained on posterior labels: those of
   ``sample_rows`` documents (in expectation), drawn at random from all without regard to labels,
   and those of the labelled sample, where the label is one more voter of a known accuracy.

Only labelled rows of ``labels`` whose crc32(doc_id as text) mod ``folds`` is not ``held_out`` are
learned from; the rows sampled are ``sample_rows`` in expectation, chosen by a hash of the id, one
text for each id.

Defined results: texts of any length are read whole; a null or empty text has no votes and gets the score of no votes; repeated rows
are scored each on their own; of several labels of one id the highest counts; null labels and
labels of unknown ids are ignored; without any usable label every score is 0; other input columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staging, crc32_mod

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 20_000
VOTERS = 96
#: Voters for clean, beside the others.
CLEAN_VOTERS = 32
#: Occurrences at which a voter fires, each a voter of its own.
COUNTS = (1, 3)
BEGINNINGS = (4, 5)
LEAST_DOCS = 5
THRESHOLD = 0.3
ROUNDS = 5
#: Share of labels that are taken to be wrong when they are joined with the model's posterior.
LABEL_NOISE = 0.05
#: Weight of an unlabelled document beside a labelled one: its posterior alone is more cautious.
UNLABELLED_WEIGHT = 0.03

WORD = re.compile(r"[^\W\d_]+")


def marks(text: str) -> Counter:
    """Occurrences of the text's words and word beginnings (these with a star)."""
    words = Counter(WORD.findall(text.lower()))
    found = Counter({w: n for w, n in words.items() if 3 <= len(w) <= 24})
    for size in BEGINNINGS:
        for w, n in words.items():
            if len(w) > size:
                found[w[:size] + "*"] += n
    return found


class Voters:
    """Which voters fire in a text: one pass over its words."""

    def __init__(self, names: list[tuple[str, int]]):
        self.words: dict[str, list[tuple[int, int]]] = {}
        self.beginnings: dict[int, dict[str, list[tuple[int, int]]]] = {n: {} for n in BEGINNINGS}
        for i, (mark, least) in enumerate(names):
            (self.beginnings[len(mark) - 1] if mark.endswith("*") else self.words).setdefault(mark.rstrip("*"), []).append((i, least))

    def fired(self, text: str) -> list[int]:
        words = Counter(WORD.findall(text.lower()))
        out = [i for w in words.keys() & self.words.keys() for i, least in self.words[w] if words[w] >= least]
        for size, known in self.beginnings.items():
            if known:
                n: Counter = Counter()
                for w, c in words.items():
                    if len(w) > size and w[:size] in known:
                        n[w[:size]] += c
                out += [i for b, c in n.items() for i, least in known[b] if c >= least]
        return sorted(out)


def training_labels(labels: DataFrame, sample_rows: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(l_id, y) of the sampled training rows; ``sample_rows`` in expectation at most."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where("l_id is not null and y in (0, 1)")
    known = known.where(crc32_mod(F.col("l_id"), FOLDS) != HELD_OUT).groupBy("l_id").agg(F.max("y").alias("y"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    return known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def _mined(sample: DataFrame, voters: int, clean_voters: int = 0, staging: Staging | None = None) -> tuple[list[tuple[str, int]], int, int]:
    """The voters' (mark, least count), and the sample's rows by class. With ``staging`` the counts
    are written there, as each ranking reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()

        def emit() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array([m for m, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.int32()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["mark", "least", "p", "n"])
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into = toxic if y else clean
                into[("", 0)] += 1
                into.update((m, least) for m, c in marks(text or "").items() for least in COUNTS if c >= least)
                if len(into) > 500_000:  # bounded memory; the sums are merged later
                    yield emit()
        yield emit()

    counts = sample.select("text", "y").mapInArrow(run, "mark string, least int, p long, n long").groupBy("mark", "least").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    if staging is not None:
        counts = staging.keep(counts, "marks")
    total = counts.where("mark = ''").first()
    if total is None or not total["p"] or not total["n"]:
        return [], 0, 0
    pos, neg = total["p"], total["n"]
    # difference of rates in standard errors
    pooled = (F.col("p") + F.col("n") + 1) / (pos + neg)
    z = (F.col("p") / pos - F.col("n") / neg) / F.sqrt(pooled * (1 / pos + 1 / neg))
    ranked = counts.where((F.col("mark") != "") & (F.col("p") >= LEAST_DOCS) & (F.col("p") / pos > 2 * F.col("n") / neg)).withColumn("z", z)
    best = ranked.orderBy(F.col("z").desc(), "mark", "least").limit(voters).collect()
    if clean_voters:
        ranked = counts.where((F.col("mark") != "") & (F.col("n") >= LEAST_DOCS) & (F.col("n") / neg > 2 * F.col("p") / pos)).withColumn("z", z)
        best += ranked.orderBy("z", "mark", "least").limit(clean_voters).collect()
    return [(r["mark"], r["least"]) for r in best], pos, neg


def _votes(docs: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """id, votes (the voters that fire, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel = Voters(names)
        for batch in batches:
            fired = [panel.fired(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32()))], ["id", "votes"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, votes array<int>")


class LabelModel:
    """Class balance and, by voter, firing rates in clean and toxic texts, and weights."""

    def __init__(self, balance: float, rates: np.ndarray, discount: np.ndarray):
        self.balance, self.rates, self.discount = balance, rates, discount
        fires = np.log(rates[1] / rates[0]) / discount
        silent = np.log((1 - rates[1]) / (1 - rates[0])) / discount
        self.weights = fires - silent
        self.bias = np.log(balance / (1 - balance)) + silent.sum()

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.bias, -30, 30)))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), np.diff(offsets)), column.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


def _expected(patterns: DataFrame, model: LabelModel, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all documents: by class, [documents, firings of each voter]; with ``pairs`` also
    the joint firings of each two voters in toxic texts. A task sends its sums once, of a size
    that is given by the voters, and of the symmetric joint sums one half."""
    width = len(model.weights)
    half = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, joint = np.zeros((2, width + 1)), np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                votes, n = _dense(part.column(0), width), part.column(1).to_numpy()
                toxic = model.posterior(votes)
                for y, share in ((0, (1 - toxic) * n), (1, toxic * n)):
                    single[y, 0] += share.sum()
                    single[y, 1:] += share @ votes
                if pairs:
                    joint += (votes * (toxic * n)[:, None]).T @ votes
        sums = np.concatenate([single.ravel(), joint[half]] if pairs else [single.ravel()])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["at", "x"])

    rows = patterns.select("votes", "n").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(2 * (width + 1) + len(half[0]))
    for r in rows:
        sums[r["at"]] = r["x"]
    joint = np.zeros((width, width))
    joint[half] = sums[2 * (width + 1) :]
    return sums[: 2 * (width + 1)].reshape(2, -1), joint + np.triu(joint, 1).T


def fit_label_model(patterns: DataFrame, votes: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM over ``patterns`` (votes, n: documents), with the labelled sample as prior counts."""
    width = votes.shape[1]
    prior = np.stack([np.concatenate(([(y == c).sum()], votes[y == c].sum(axis=0))) for c in (0, 1)])
    flat = np.ones(width)

    def model(counts: np.ndarray, discount: np.ndarray) -> LabelModel:
        rates = np.clip((counts[:, 1:] + 0.5) / (counts[:, :1] + 1), 1e-5, 1 - 1e-5)
        return LabelModel(float(np.clip(counts[1, 0] / counts[:, 0].sum(), 1e-3, 0.5)), rates, discount)

    # voters repeat each other (a word and its beginning): the sample's correlations start the fit
    current = model(prior, _discount(prior, votes[y == 1].T @ votes[y == 1], flat))
    for i in range(rounds):
        last = i == rounds - 1
        single, joint = _expected(patterns, current, last)
        # the sample weighs as much as all documents do
        scale = single[:, 0].sum() / max(1.0, prior[:, 0].sum())
        counts = single + prior * scale
        current = model(counts, _discount(single, joint, flat) if last else current.discount)
    return current


def _discount(single: np.ndarray, joint: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """One plus the sum of a voter's positive correlations within the class of toxic texts."""
    n = max(single[1, 0], 1.0)
    rate = single[1, 1:] / n
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
    correlation = (joint / n - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    return flat + np.clip(np.nan_to_num(correlation), 0, 1).sum(axis=1)


def fit_classifier(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the bias last) of a logistic regression on soft labels of weighted rows, by Newton steps."""
    x = np.column_stack([votes, np.ones(len(votes))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * w
        move = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, voters: int = VOTERS, clean_voters: int = CLEAN_VOTERS, with_key: bool = False) -> DataFrame:
    """One row per document: id_col, held_out (boolean), score (double), predicted (int); with
    ``with_key`` also key (hash of the text)."""
    staging = Staging(docs.sparkSession, "toxicity")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = F.broadcast(training_labels(labels, sample_rows))  # sample_rows rows, in expectation
    # one text of each id, so that repeated ids don't outgrow the bound
    sample = source.join(known, source["id"] == known["l_id"]).groupBy("id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    sample = staging.keep(sample, "sample")
    names, pos, neg = _mined(sample, voters, clean_voters, staging)
    held = F.coalesce(crc32_mod(F.col("id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")  # null ids aren't
    if not names:
        none = source.withColumn("key", F.xxhash64("text")) if with_key else source
        return none.select(F.col("id").alias(id_col), held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *["key"] * with_key)
    carried = F.struct("id", *[F.xxhash64("text").alias("key")] * with_key).alias("id")
    votes = staging.keep(_votes(source.select(carried, "text"), names).select("id.*", "votes"), "votes")
    patterns = staging.keep(votes.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    rows = sample.select(F.col("y").cast("int").alias("id"), "text")
    rows = _votes(rows, names).collect()
    y = np.array([r["id"] for r in rows])
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r["votes"]] = 1
    model = fit_label_model(patterns, x, y)
    # the label is one more voter, of a known accuracy
    odds = np.log(model.posterior(x).clip(1e-6, 1 - 1e-6) / (1 - model.posterior(x).clip(1e-6, 1 - 1e-6)))
    target = 1 / (1 + np.exp(-(odds.clip(-3, 3) + np.log((1 - LABEL_NOISE) / LABEL_NOISE) * np.where(y == 1, 1, -1))))
    drawn = votes.where(F.rand(7) < sample_rows / max(1, votes.count())).groupBy("votes").agg(F.count("*").alias("n")).collect()  # sample_rows in expectation
    ux = np.zeros((len(drawn), len(names)))
    for i, r in enumerate(drawn):
        ux[i, r["votes"]] = 1
    n = UNLABELLED_WEIGHT * np.array([r["n"] for r in drawn], float)
    weights = fit_classifier(np.vstack([x, ux]), np.concatenate([target, model.posterior(ux)]), np.concatenate([np.ones(len(x)), n]))
    by_voter = F.array(*(F.lit(float(w)) for w in weights[:-1]))
    logit = F.aggregate("votes", F.lit(float(weights[-1])), lambda s, v: s + F.get(by_voter, v))
    score = 1 / (1 + F.exp(-logit))
    out = votes.select("id", held, score.alias("score"), *["key"] * with_key)
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *["key"] * with_key)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns. Rows are told apart by
    id and text, so one toxic row takes no other with it that has its id, or none either."""
    staging = Staging(docs.sparkSession, "toxic_rejected")
    scored = score_toxicity(docs, labels, id_col, text_col, with_key=True, **options)
    bad = staging.keep(scored.where("predicted = 1").select(F.col(id_col).alias("_bad"), F.col("key").alias("_key")).distinct(), "bad")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_key"]), "left_anti")
