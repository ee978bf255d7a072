"""N-gram Jaccard join with Bayesian candidate pruning (operator 7).

Texts with the same set of five-word shingles are one copy class. Classes that agree in a band of
their MinHash signatures meet in a bucket. There, the signatures of two classes are compared some
values at a time; as soon as the posterior probability of a similarity of ``threshold``, given the
agreements so far and a uniform prior, falls below ``tolerance``, the pair is dropped. The rest is
verified exactly on the shingle sets.

No pair ever becomes a row. A pair belongs to the first band in which it agrees, so it is judged
in one place; a task that judges a bucket writes one row per class with its number of links, and
one edge per class to the bucket's first linked class. A bucket of more than ``block`` classes is
cut into blocks, and each pair of blocks is a unit of its own, so a group of any size spreads over
tasks and no task holds more than two blocks. Edges are closed into groups by passing the smallest
label along them until nothing changes.

Defined results: a null text counts as empty; texts without words are copies only of equal texts and
have no links; texts of any length are read whole; a text of fewer than five words is one shingle; repeated rows are copies of each other; ids
may repeat and a null id is kept; other input columns are ignored; an empty table gives an empty
result. A pair at the threshold exactly is linked. A pair at the threshold shares no band with a
probability of (1 - 0.8**4)**24 (3e-6, less above it), and each look of the pruning may drop it
with a chance of the order of the tolerance; nothing else can lose a link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staging
from tidemark.llm.shingles import MinHasher, mix, shingle_set

THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 4
SIGNATURE = BANDS * BAND_ROWS
#: Signature values that are compared before each look at the posterior.
STEP = 16
TOLERANCE = 1e-6
BLOCK = 768


def least_agreements(compared: int, threshold: float, tolerance: float) -> int:
    """The least number of agreements among ``compared`` values at which the posterior
    probability of reaching the threshold is no less than the tolerance."""
    # uniform prior: the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum
    n, below = compared + 1, 0.0
    for m in range(compared + 1):
        below += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if below >= tolerance:
            return m
    return compared


def _class(shingles: np.ndarray, text: str) -> bytes:
    """Digest of the shingle set, or of the text where it has no words."""
    data = shingles.tobytes() if len(shingles) else b"text " + text.encode()
    return hashlib.blake2b(data, digest_size=16).digest()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), cls (digest of the shingle set), n (its size), sig (packed 32-bit
    minima)."""
    text = F.col(text_col).cast("string")
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHasher(SIGNATURE)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                sets = [shingle_set(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([_class(s, t) for s, t in zip(sets, texts, strict=True)], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([minhash(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["id", "key", "cls", "n", "sig"],
                )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, key long, cls binary, n int, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """cls, band, bucket (hash of the band's values and number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _packed(batch.column(1), np.uint32, SIGNATURE).astype(np.uint64)
            parts = sig.reshape(len(sig), BANDS, BAND_ROWS)
            key = np.arange(BANDS, dtype=np.uint64)[None, :]
            for r in range(BAND_ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
            rows = np.repeat(np.arange(len(sig)), BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), pa.array(key.ravel().view(np.int64))], ["cls", "band", "bucket"])

    return classes.where("n > 0").select("cls", "sig").mapInArrow(run, "cls binary, band int, bucket long")


def _packed(column: pa.Array, kind, width: int) -> np.ndarray:
    """Rows of a binary column whose values all hold ``width`` items."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def _units(buckets: DataFrame, block: int) -> DataFrame:
    """cls, band, unit (hash), side: where each class is judged. A bucket of one block is one
    unit; otherwise each pair of blocks is one, with sides 0 and 1, or -1 within a block."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    sized = buckets.join(sizes, "bucket")
    n_blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    sized = sized.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = sized.select("cls", "band", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return met.select("cls", "band", F.xxhash64("bucket", low, high).alias("unit"), side.alias("side"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("unit").sortWithinPartitions("unit")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units, of some thousand rows or one unit each; column 0 is the unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            units = part.column(0).to_numpy()
            turn = int(np.searchsorted(units, units[-1], "left"))  # units are sorted
            if turn or (held and held[-1].column(0)[-1].as_py() != units[0]):
                whole = [*held, part.slice(0, turn)] if turn else held
                yield pa.Table.from_batches(whole)
                held = []
            held.append(part.slice(turn))
    if held:
        yield pa.Table.from_batches(held)


def _slices(units: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(units)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(units)]))
    several = ends - starts > 1
    yield from zip(starts[several].tolist(), ends[several].tolist(), strict=True)


class Judge:
    """Which pairs of a unit belong to it and survive the pruning."""

    def __init__(self, threshold: float, tolerance: float):
        self.looks = [(at, min(at + STEP, SIGNATURE)) for at in range(0, SIGNATURE, STEP)]
        self.least = [least_agreements(b, threshold, tolerance) for _, b in self.looks]

    def pairs(self, sig: np.ndarray, band: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices (i, j) of surviving pairs, i before j."""
        left, right = [], []
        n = len(sig)
        for i in range(n):
            others = np.arange(i + 1, n) if side[i] < 0 else np.flatnonzero(side == 1) if side[i] == 0 else None
            if others is None or not len(others):
                continue
            count = np.zeros(len(others), np.int32)
            for (a, b), least in zip(self.looks, self.least, strict=True):
                count += (sig[others, a:b] == sig[i, a:b]).sum(axis=1, dtype=np.int32)
                keep = count >= least
                others, count = others[keep], count[keep]
                if not len(others):
                    break
            if len(others) and band:
                earlier = sig[others, : band * BAND_ROWS] == sig[i, : band * BAND_ROWS]
                others = others[~earlier.reshape(len(others), band, BAND_ROWS).all(axis=2).any(axis=1)]
            if len(others):
                left.append(np.full(len(others), i))
                right.append(others)
        empty = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets[i] and sets[j]."""
    n, total = len(sets), sum(map(len, sets))
    if len(i) < 64 or n < 32:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    items, at = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    if n * n * len(items) > 400.0 * len(i) * total / n:  # products of sparse columns don't pay
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    common = np.zeros((n, n), np.float32)
    for start in range(0, len(items), columns):
        a, b = np.searchsorted(at, (start, start + columns))
        part = np.zeros((n, columns), np.float32)
        part[rows[a:b], at[a:b] - start] = 1
        common += part @ part.T
    return np.rint(common[i, j]).astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index linked with each index, over any number of links."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _needed(units: DataFrame, judge: Judge) -> DataFrame:
    """The (unit, band, side, cls, sig) whose class has a surviving pair in the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            batch = table.combine_chunks().to_batches()[0]
            sig = _packed(batch.column(4), np.uint32, SIGNATURE)
            bands, sides = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keep = []
            for a, b in _slices(batch.column(0).to_numpy()):
                i, j = judge.pairs(sig[a:b], int(bands[a]), sides[a:b])
                if len(i):
                    keep.append(a + np.unique(np.concatenate((i, j))))
            if keep:
                yield batch.take(pa.array(np.concatenate(keep)))

    return units.mapInArrow(run, "unit long, band int, side int, cls binary, sig binary")


def _links(needed: DataFrame, judge: Judge, threshold: float) -> DataFrame:
    """(cls, links, root): by class and unit, the exact links and one linked class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            batch = table.combine_chunks().to_batches()[0]
            sig = _packed(batch.column(4), np.uint32, SIGNATURE)
            bands, sides, texts = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(5)
            rows, links, roots = [], [], []
            for a, b in _slices(batch.column(0).to_numpy()):
                i, j = judge.pairs(sig[a:b], int(bands[a]), sides[a:b])
                if not len(i):
                    continue
                sets = [shingle_set(t or "") for t in texts.slice(a, b - a).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                common = _intersections(sets, i, j)
                union = sizes[i] + sizes[j] - common
                linked = common >= threshold * union - 1e-9
                i, j = i[linked], j[linked]
                count = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                some = np.flatnonzero(count)
                rows.append(a + some)
                links.append(count[some])
                roots.append(a + _roots(b - a, i, j)[some])
            if rows:
                cls = batch.column(3)
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(links).astype(np.int64)), cls.take(pa.array(np.concatenate(roots)))], ["cls", "links", "root"])

    return needed.mapInArrow(run, "cls binary, links long, root binary")


def _components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(cls, label): the smallest class that each class of ``edges`` (cls, root) is linked with."""
    both = staging.keep(edges.union(edges.select("root", "cls")).distinct(), "edges")
    labels = staging.keep(both.groupBy("cls").agg(F.min("root").alias("m")).select("cls", F.least("cls", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("cls").alias("root"), "label"), "root").groupBy("cls").agg(F.min("label").alias("near"))
        passed = labels.join(near, "cls").select("cls", "label", F.least("label", "near").alias("new"))
        passed = staging.keep(passed, "passed")
        # a label's own label: halves the way of long chains
        jump = passed.select(F.col("cls").alias("new"), F.col("new").alias("further"))
        jumped = passed.join(jump, "new", "left").select("cls", "label", F.least("new", F.coalesce("further", "new")).alias("new"))
        jumped = staging.keep(jumped, "labels")
        changed = not jumped.where("new != label").isEmpty()
        labels = jumped.select("cls", F.col("new").alias("label"))
        if not changed:
            return labels


#: A key with more than this share of the rows is hot: there are fewer such keys than its inverse.
HOT_SHARE, HOT_LEAST = 1 / 2000, 1024


def _joined(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left joined with the one row of ``right`` by key; ``rows`` tells how many of left's ``total``
    rows a key has. Hot keys, 2,000 at most, are broadcast, so none of them lands in one task."""
    is_hot = F.col(rows) > max(HOT_LEAST, int(total * HOT_SHARE))
    hot, cold = right.where(is_hot), right.where(~is_hot)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per input row: id_col, class_id (smallest id of the group of linked texts and
    their copies), copy_id (smallest id with the same shingles), n_copies (long, rows of the copy
    class), n_links (long, other copy classes with a similarity of ``threshold`` or more)."""
    found = _grouped(df, id_col, text_col, threshold, tolerance, block)
    return found.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_copies", "n_links")


def _grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, key (hash of the text), class_id, copy_id, n_copies, n_links and
    first (no_id, id, key: the group's row of the smallest id, null ids last)."""
    staging = Staging(df.sparkSession, "jaccard")
    judge = Judge(threshold, tolerance)
    docs = staging.keep(signatures(df, id_col, text_col), "signatures")
    members = docs.select("id", "key", "cls")
    copies = members.groupBy("cls").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"))
    copies = staging.keep(copies, "copies")
    classes = docs.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = staging.keep(classes, "classes")
    units = staging.keep(_units(_bands(classes), block), "units")
    signed = _dealt(units.join(classes.select("cls", "sig"), "cls").select("unit", "band", "side", "cls", "sig"))
    needed = staging.keep(_needed(signed, judge), "needed")
    # one text of each class that is needed; the classes' texts have equal shingles
    asked = needed.select("cls").distinct()
    one = copies.join(asked, "cls", "left_semi").select("cls", F.col("copy_id").alias("id"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if _unique(docs):
        texts = texts.join(one, "id").select("cls", "text")
    else:
        # ids that repeat don't name a text: the digest is computed again
        texts = _digests(texts).join(asked, "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text"))
    verified = _dealt(needed.join(texts, "cls").select("unit", "band", "side", "cls", "sig", "text"))
    links = staging.keep(_links(verified, judge, threshold), "links")
    labels = _components(links.where("cls != root").select("cls", "root"), staging)
    counted = links.groupBy("cls").agg(F.sum("links").alias("n_links"))
    found = copies.join(labels, "cls", "left").join(counted, "cls", "left")
    found = found.select("cls", "copy_id", "n_copies", "first", F.coalesce("label", "cls").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    found = staging.keep(found, "found")
    named = found.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min("first").alias("first"), F.count("*").alias("n_classes"))
    named = staging.keep(named, "named")
    whole = _joined(found.drop("first"), named, "label", "n_classes", found.count())
    whole = staging.keep(whole.select("cls", "class_id", "copy_id", "n_copies", "n_links", "first"), "whole")
    out = _joined(members, whole, "cls", "n_copies", members.count())
    return out.select("id", "key", "class_id", "copy_id", "n_copies", "n_links", "first")


def _unique(docs: DataFrame) -> bool:
    """Whether no two rows share an id, and none is null."""
    return docs.where("id is null").isEmpty() and docs.groupBy("id").count().where("count > 1").isEmpty()


def _digests(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [_class(shingle_set(t or ""), t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), batch.column(0)], ["cls", "text"])

    return texts.select("text").mapInArrow(run, "cls binary, text string")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of linked texts, that of the smallest id, with all its columns. Rows
    are told apart by id and text: texts that aren't linked all stay, whatever ids they have."""
    staging = Staging(df.sparkSession, "jaccard_kept")
    found = staging.keep(_grouped(df, id_col, text_col, **options).select("id", "key", "first"), "groups")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    gone = staging.keep(found.where(~stays).select(F.col("id").alias("_gone"), F.col("key").alias("_key")).distinct(), "gone")
    keyed = df.withColumn("_own", F.xxhash64(F.col(text_col).cast("string")))
    stay = keyed.join(gone, keyed[id_col].eqNullSafe(gone["_gone"]) & (keyed["_own"] == gone["_key"]), "left_anti")
    repeated = not found.groupBy("id", "key").count().where("count > 1").isEmpty()
    return (stay.dropDuplicates([id_col, "_own"]) if repeated else stay).drop("_own")
