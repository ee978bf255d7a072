"""LM scoring by a Brown class-based bigram model (operator 6).

P(text) = product over tokens of P(class | class before) * P(word | class). Classes are found by
exchange clustering in two steps. The ``clustered`` most frequent words are exchanged: each in turn
moves to the class that raises the likelihood of the training bigrams most, ``ROUNDS`` times through
or until no word moves. Then every other word of the head is inserted, by the same gain, into one of
these classes: its own bigram list is weighed against the fixed class-by-class table, word by word
and spread over tasks. Words beyond the head (the ``head`` most frequent ones with ``HEAD_LEAST`` or
more occurrences) and unknown ones form one class of their own: they aren't clustered. The end of a
text is a token too, and stands before each text's first word.

Counts of all words and of all bigrams of the training texts are taken, whatever the size: words
are counted by task before they are shuffled. The ``head`` most frequent words are broadcast (a
bounded table); a text's other words are joined with the whole count table, so no word's count is
dropped. Bigrams are counted by symbol (a clustered word, or a band of words of like counts until
these are inserted), so the table that reaches the driver has (clustered + 20)**2 cells at most; of
the inserted words only their classes do, ``head`` numbers at most.

Probabilities are smoothed so that the model without transitions is the base score: a class's
emission is (count + 0.5) / (its tokens + 0.5 * its words), rare words counting one word more for
the unknown, and transitions are drawn to the classes' own shares by ``strength`` counts.

Defined results: texts of any length are scored whole; a null text counts as empty; an empty text is its end alone; rows are scored each
on their own, repeated ones alike; without training texts N and V are 0; other input columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staging, crc32_mod

FOLDS, HELD_OUT = 5, 1
HEAD = 60_000
#: Words seen less often are always in the rare class: it must learn where unknown words stand.
HEAD_LEAST = 3
CLUSTERED = 1000
CLASSES = 64
STRENGTH = 4.0
ROUNDS = 12
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, as UTF-8: what stands between ASCII white space."""
    return (text or "").encode().lower().split()


def exchange(n: np.ndarray, movable: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol, from bigram counts: the first ``movable`` symbols are exchanged among
    ``classes`` classes; every other symbol has a class of its own, numbered from there on."""
    size = len(n)
    classes = max(1, min(classes, movable))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)])
    total = classes + size - movable
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    n = n.astype(float)
    m = member.T @ n @ member
    after, before = n.sum(axis=1), n.sum(axis=0)
    out, into = (np.bincount(of[:movable], x[:movable], classes) for x in (after, before))
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds):
        moved = 0
        right, left = n @ member, (member.T @ n).T  # by symbol: counts before / after each class
        for w in range(movable):
            a, own = of[w], n[w, w]
            row, col = right[w].copy(), left[w].copy()
            row[a] -= own
            col[a] -= own
            m[a, :] -= row
            m[:, a] -= col
            m[a, a] -= own
            k = slice(0, classes)
            rows = f(m[k] + row) - f(m[k])
            cols = f(m[:, k] + col[:, None]) - f(m[:, k])
            at = np.arange(classes)
            corner = m[at, at]
            gain = rows.sum(axis=1) - rows[at, at] + cols.sum(axis=0) - cols[at, at] + f(corner + row[k] + col[k] + own) - f(corner)
            out[a] -= after[w]
            into[a] -= before[w]
            gain -= f(out + after[w]) - f(out) + f(into + before[w]) - f(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b, :] += row
            m[:, b] += col
            m[b, b] += own
            out[b] += after[w]
            into[b] += before[w]
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w, :]
                left[:, b] += n[w, :]
                member[w, a], member[w, b] = 0, 1
        if not moved:
            break
    return of


def _counts(texts: DataFrame) -> DataFrame:
    """(w, c): training counts of all words, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > 400_000:  # bounded memory; sums are merged after the shuffle
                    yield emit()
        yield emit()

    return texts.select("text").mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Symbols:
    """Symbol of each head word: clustered words first, then classes by magnitude, then the rest."""

    def __init__(self, head: list[tuple[bytes, int]], clustered: int):
        self.words = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.int64)
        self.clustered = min(clustered, len(head))
        bands = np.floor(np.log2(np.maximum(self.counts[self.clustered :], 1))).astype(int)
        self.bands = sorted(set(bands.tolist()), reverse=True)
        place = {b: self.clustered + i for i, b in enumerate(self.bands)}
        self.rare = self.clustered + len(self.bands)
        self.size = self.rare + 1
        # one more entry: index -1 is any word beyond the head
        self.of = np.array([*range(self.clustered), *(place[b] for b in bands.tolist()), self.rare], np.int64)

    def classed(self, classes: np.ndarray) -> Symbols:
        """The same words, each with its class as its symbol; the rest has the class after them."""
        out = Symbols.__new__(Symbols)
        out.words, out.counts, out.clustered, out.bands = self.words, self.counts, self.clustered, []
        out.rare = int(classes.max(initial=-1)) + 1
        out.size, out.of = out.rare + 1, np.append(classes, out.rare)
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))


def _bigrams(texts: DataFrame, shared) -> DataFrame:
    """(a, b, n): training counts of symbol pairs, the end standing before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value
        n = np.zeros(symbols.size**2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys = []
                for text in batch.column(0).slice(at, 1024).to_pylist():
                    s = symbols.of[symbols.ids([END, *words_of(text), END])]
                    keys.append(s[:-1] * symbols.size + s[1:])
                n += np.bincount(np.concatenate(keys), minlength=len(n))
        some = np.flatnonzero(n)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["pair", "n"])

    return texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _contexts(texts: DataFrame, shared) -> DataFrame:
    """(word, at): of every head word that isn't clustered, its neighbours: an array of ctx and n,
    ctx being the class after it, or the number of classes and the class before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, of, total = shared.value
        low, wide = symbols.clustered, 2 * total
        n = np.zeros((len(symbols.words) - low) * wide, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys = []
                for text in batch.column(0).slice(at, 1024).to_pylist():
                    ids = symbols.ids([END, *words_of(text), END])
                    classes = of[symbols.of[ids]]
                    word = (ids - low) * wide
                    first, last = np.flatnonzero(ids[:-1] >= low), np.flatnonzero(ids[1:] >= low) + 1
                    keys += [word[first] + classes[first + 1], word[last] + total + classes[last - 1]]
                keys, times = np.unique(np.concatenate(keys), return_counts=True)
                n[keys] += times.astype(np.int32)
        some = np.flatnonzero(n)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part].astype(np.int64))], ["cell", "n"])

    _, _, total = shared.value
    cells = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    word, ctx = F.floor(F.col("cell") / (2 * total)).cast("long"), F.pmod("cell", F.lit(2 * total)).cast("int")
    return cells.groupBy(word.alias("word")).agg(F.collect_list(F.struct(ctx.alias("ctx"), "n")).alias("at"))  # 2 * total entries at most


def best_class(m: np.ndarray, classes: int, row: np.ndarray, col: np.ndarray) -> int:
    """The class, of the first ``classes``, that a word with these counts before (row) and after
    (col) each class joins with the greatest gain of likelihood; the smallest one of ties."""
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    k = np.arange(classes)
    rows, cols = f(m[k] + row) - f(m[k]), f(m[:, k] + col[:, None]) - f(m[:, k])
    corner = m[k, k]
    gain = rows.sum(axis=1) - rows[k, k] + cols.sum(axis=0) - cols[k, k] + f(corner + row[k] + col[k]) - f(corner)
    out, into = m[k].sum(axis=1), m[:, k].sum(axis=0)
    gain -= f(out + row.sum()) - f(out) + f(into + col.sum()) - f(into)
    return int(np.argmax(np.round(gain, 6)))


def _inserted(contexts: DataFrame, table, classes: int) -> DataFrame:
    """(word, class) of every word of ``contexts``, by the fixed class-by-class table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for batch in batches:
            chosen = []
            for entries in batch.column(1):
                counts = np.zeros(2 * len(m))
                both = entries.values
                counts[both.field(0).to_numpy()] = both.field(1).to_numpy()
                chosen.append(best_class(m, classes, counts[: len(m)], counts[len(m) :]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32())], ["word", "class"])

    return contexts.mapInArrow(run, "word long, class int")


def _counted_pairs(texts: DataFrame, shared, size: int) -> np.ndarray:
    pairs = np.zeros(size**2, np.int64)
    for r in _bigrams(texts, shared).collect():  # size ** 2 rows at most
        pairs[r["pair"]] = r["n"]
    return pairs.reshape(size, size)


def _scored(docs: DataFrame, shared, tables) -> DataFrame:
    """By row: what head words tell, and the other words with their occurrences."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value
        base, step, emission = tables.value
        item = pa.list_(pa.struct([("w", pa.binary()), ("tf", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    words.append(END)
                    ids = symbols.ids(words)
                    s = symbols.of[ids]
                    before = np.concatenate((symbols.of[symbols.ids([END])], s[:-1]))
                    beyond = np.flatnonzero(ids < 0)
                    rare = Counter([words[i] for i in beyond])
                    out[0].append(len(words))
                    out[1].append(len(words) - len(beyond))
                    out[2].append(float(base[ids].sum()))
                    out[3].append(float(step[before, s].sum() + emission[ids].sum()))
                    out[4].append([{"w": w, "tf": c} for w, c in rare.items()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array(out[4], item)], ["id", "n_tokens", "n_head", "base", "model", "rare"])

    return docs.mapInArrow(run, f"id {kind}, n_tokens long, n_head long, base double, model double, rare array<struct<w:binary,tf:long>>")


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES, strength: float = STRENGTH) -> DataFrame:
    """One row per text: id_col, held_out, n_tokens, n_known, train_tokens (long), base_score and
    score (log10 probabilities), perplexity (by token, of the class model)."""
    spark = df.sparkSession
    staging = Staging(spark, "brown")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = docs.where(F.coalesce(crc32_mod(F.col("id"), FOLDS) != HELD_OUT, F.lit(True)))
    counts = staging.keep(_counts(train), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("c") >= HEAD_LEAST).orderBy(F.col("c").desc(), "w").limit(head).collect()
    symbols = Symbols([(bytes(r["w"]), r["c"]) for r in top], clustered)
    shared = spark.sparkContext.broadcast(symbols)
    pairs = _counted_pairs(train, shared, symbols.size)
    of = exchange(pairs, symbols.clustered, classes)
    if len(symbols.words) > symbols.clustered:
        total, found = int(of.max()) + 1, int(of[: symbols.clustered].max()) + 1
        member = np.zeros((symbols.size, total))
        member[np.arange(symbols.size), of] = 1
        contexts = _contexts(train, spark.sparkContext.broadcast((symbols, of, total)))
        table = spark.sparkContext.broadcast(member.T @ pairs @ member)
        by_word = np.concatenate([of[: symbols.clustered], np.zeros(len(symbols.words) - symbols.clustered, np.int64)])
        for r in _inserted(contexts, table, found).collect():  # a row for each head word
            by_word[symbols.clustered + r["word"]] = r["class"]
        symbols = symbols.classed(by_word)
        shared = spark.sparkContext.broadcast(symbols)
        pairs, of = _counted_pairs(train, shared, symbols.size), np.arange(symbols.size)
    # tokens and words of each symbol, then of each class; rare words count the unknown word too
    tokens, kinds = np.zeros(symbols.size), np.zeros(symbols.size)
    np.add.at(tokens, symbols.of[:-1], symbols.counts)
    np.add.at(kinds, symbols.of[:-1], 1)
    tokens[symbols.rare] = n - symbols.counts.sum()
    kinds[symbols.rare] = v - len(symbols.counts) + 1
    size = int(of.max()) + 1
    class_tokens, class_kinds = np.bincount(of, tokens, size), np.bincount(of, kinds, size)
    mass = class_tokens + 0.5 * class_kinds
    whole = n + 0.5 * (v + 1)
    member = np.zeros((symbols.size, size))
    member[np.arange(symbols.size), of] = 1
    moves = member.T @ pairs @ member
    shares = (moves + strength * mass / whole) / (moves.sum(axis=1, keepdims=True) + strength)
    step = np.log10(np.maximum(shares, 1e-300))[of][:, of]
    base = np.append(np.log10(symbols.counts + 0.5) - np.log10(whole), 0.0)
    emission = np.append(np.log10(symbols.counts + 0.5) - np.log10(np.maximum(mass[of[symbols.of[:-1]]], 0.5)), 0.0)
    tables = spark.sparkContext.broadcast((base, step, emission))
    rows = staging.keep(_scored(docs, shared, tables).withColumn("row", F.monotonically_increasing_id()), "rows")
    words = rows.select("row", F.explode("rare").alias("r")).select("row", "r.w", "r.tf")
    counted = words.join(counts, "w", "left")
    c = F.coalesce("c", F.lit(0))
    beyond = counted.groupBy("row").agg(F.sum(F.col("tf") * F.log10(c + 0.5)).alias("logs"), F.sum("tf").alias("n_beyond"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_seen"))
    found = rows.drop("rare").join(beyond, "row", "left")
    logs, n_beyond = F.coalesce("logs", F.lit(0.0)), F.coalesce("n_beyond", F.lit(0))
    rare_mass = float(np.log10(max(mass[of[symbols.rare]], 0.5)))
    score = F.col("model") + logs - n_beyond * F.lit(rare_mass)
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce(crc32_mod(F.col("id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_seen", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - n_beyond * F.lit(float(np.log10(whole)))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
