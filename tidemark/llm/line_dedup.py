"""Substring dedup by line hashing (operator 8).

Units are lines, and in a line of several sentences each sentence; a unit is normalised to its
lower-cased words, and units of at least ``min_words`` words are hashed to 128 bits. A shorter one
is hashed with its neighbours: from each unit on and up to each unit, the fewest units in a row
that have ``min_words`` words are a unit too. So whatever run of whole units repeats is removed
whole if it has ``min_words`` words, however short its lines and sentences are, and nothing depends
on what stands around it. Digests are grouped over all documents; of each group the earliest ranked
occurrence stays (by rank, then id, then place) and all others are removed. The removed spans are
code points of the original text; those of neighbours may overlap.

Texts are read once in Python, which writes digests and offsets, never the text; everything after
that moves digests only. Grouping keeps one row per digest and task before it shuffles, and the
join that finds later occurrences holds repeated digests only on one side, so a digest that has a
third of all rows is split as a skewed partition of that join.

Defined results: null and empty texts have no units; the rank column's nulls come last; ids are
ranked as they compare, null ids last; repeated rows (same rank, id and text) are one document,
and both stay as they are or are cut alike; texts of any length are read whole; other input columns are
ignored, but ``dedup_texts`` replaces one named ``removed``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staging

#: A unit ends at a line's end, or after a sentence's last mark before white space.
UNIT_END = re.compile(r"\n|(?<=[.!?])[^\S\n]+")
WORDS = re.compile(r"\w+")
MIN_WORDS = 6


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit that is long enough, and of each least row of units that
    is; sorted. Where a row overlaps an equal one (a word that is repeated over and over), both
    are hashed as one, so that what is repeated never is a part of what stays."""
    parts, at = [], 0
    for end, after in [*(m.span() for m in UNIT_END.finditer(text)), (len(text), len(text))]:
        if words := WORDS.findall(text[at:end].lower()):
            parts.append((at, end, words))
        at = after
    rows, low, n = set(), 0, 0
    for high, (_, _, words) in enumerate(parts):
        n += len(words)
        while n >= min_words:
            # the fewest up to ``high``, or the fewest from ``low`` on
            if n - len(parts[low][2]) < min_words or n - len(words) < min_words:
                rows.add((low, high))
            if n - len(parts[low][2]) < min_words:
                break
            n -= len(parts[low][2])
            low += 1
    digest = lambda i, j: hashlib.blake2b(" ".join(w for p in parts[i : j + 1] for w in p[2]).encode(), digest_size=16).digest()
    out, seen = [], {}
    for i, j in sorted(rows):
        d = digest(i, j)
        first, last = seen.get(d, (i, -1))
        if i <= last:
            d = digest(first, j)
        else:
            first = i
            seen[d] = (i, j)
        out.append((parts[first][0], parts[j][1], d))
    return sorted(out)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (sorted)."""
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(text[at:a])
        at = max(at, b)
    pieces.append(text[at:])
    return "".join(pieces)


def _documents(df: DataFrame, id_col: str, text_col: str, rank: Column, min_words: int) -> DataFrame:
    """id, key (hash of the text), rank, units (start, end, digest as two longs)."""
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), rank.alias("rank"), F.col(text_col).cast("string").alias("text"))
    unit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [
                    [{"start": a, "end": b, "d1": int.from_bytes(d[:8], "little", signed=True), "d2": int.from_bytes(d[8:], "little", signed=True)} for a, b, d in units(t or "", min_words)]
                    for t in part.column(3).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rows, unit)], ["id", "key", "rank", "units"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, key long, rank {source.schema['rank'].dataType.simpleString()}, units array<struct<start:int,end:int,d1:long,d2:long>>")


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: id_col, key (hash of the text), n_units (int), removed (array of
    start, end, first_id: the unit's place, and the document that keeps it, sorted by start;
    places may overlap)."""
    staging = Staging(df.sparkSession, "line_dedup")
    rank = F.col(rank_col) if rank_col else F.lit(0)
    docs = staging.keep(_documents(df, id_col, text_col, rank, min_words), "units")
    flat = docs.select("id", "key", "rank", F.explode("units").alias("u")).select("id", "key", "rank", "u.*")
    # nulls last: a flag stands before rank and id
    order = F.struct(F.col("rank").isNull().alias("no_rank"), "rank", F.col("id").isNull().alias("no_id"), "id", "key", "start")
    digests = flat.groupBy("d1", "d2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    digests = staging.keep(digests.select("d1", "d2", "first"), "repeated")
    later = flat.join(digests, ["d1", "d2"]).where(order != F.col("first"))
    removed = later.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("first.id").alias("first_id")))).alias("removed"))
    removed = removed.withColumnRenamed("id", "r_id").withColumnRenamed("key", "r_key")
    found = docs.select("id", "key", F.size("units").alias("n_units")).join(removed, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    empty = F.array().cast(removed.schema["removed"].dataType)
    return found.select(F.col("id").alias(id_col), "key", "n_units", F.coalesce("removed", empty).alias("removed"))


def dedup_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with text_col cut: all its columns, and removed (the original spans)."""
    found = find_repeats(df, id_col, text_col, **options).select(F.col(id_col).alias("_id"), F.col("key").alias("_key"), F.col("removed").alias("_removed")).distinct()
    keyed = df.withColumn("_own", F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left")
    joined = joined.withColumn(text_col, F.col(text_col).cast("string")).withColumn("removed", F.col("_removed")).drop("_own", "_id", "_key", "_removed")
    at_text, at_removed = joined.columns.index(text_col), joined.columns.index("removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = zip(part.column(at_text).to_pylist(), part.column(at_removed).to_pylist(), strict=True)
                texts = [cut(t, [(r["start"], r["end"]) for r in removed]) if t and removed else t for t, removed in rows]
                columns = part.columns
                columns[at_text] = pa.array(texts, part.schema.field(at_text).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return joined.mapInArrow(run, joined.schema)
