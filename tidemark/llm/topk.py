"""Exact top-k search by the three-phase uniform threshold (operator 10).

Vectors are cut into ``lists`` blocks of components; for a query, each block is one list of
partial scores. Phase 1 gathers every task's own k highest entries of each list; the k-th highest
whole score T of what was gathered is a safe cutoff. Phase 2 broadcasts T / lists: an object whose
score reaches T stands at that height in one list at least, so every entry from there on is
collected and no object that matters is missed; those that can't reach T with what the other lists
may add are dropped. Phase 3 resolves the remaining scores exactly.

Queries are taken in blocks of ``query_block``, so what is broadcast and what reaches the driver
(a block's queries and cutoffs) is bounded whatever the table's size.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as filled with zeros, vectors of any length are used whole; every row is a candidate
but the query's own, so rows that share a vec_id, equal or not, count each, and so do rows without
one; ties go to the smaller vec_id, null ids last; every row whose id is divisible is a query of
its own; a query with fewer than k candidates gets all; an empty table gives an empty result.
Components and scores beyond 64 bits count as the nearest long. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Staging

SCALE = 1024
QUERY_STEP = 100


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of every row that takes part, v being floor(SCALE * x) as array of long."""
    finite = F.forall(F.col("x"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ok = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    ok = ok.where(F.col("x").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return ok.select("id", F.transform("x", lambda e: F.floor(e * F.lit(float(SCALE)))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to ``width``."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


#: Scores of this size or more are held to it until they are resolved.
WIDE = 1 << 61


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T: in doubles while all sums stay under 2**53, in 64-bit integers while they fit, else
    row by row; what is WIDE or more (either way) is held to that."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    bound = most(a) * most(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < WIDE:
        return a @ b.T
    if len(b) > 1:  # only the rows that are large need wide numbers
        large = np.array([most(r) for r in b], dtype=object) * most(a) * max(1, a.shape[1]) >= 1 << 53
        out = np.zeros((len(a), len(b)), np.int64)
        for part in (np.flatnonzero(~large.astype(bool)), *np.flatnonzero(large.astype(bool))[:, None]):
            if len(part):
                out[:, part] = _product(a, b[part])
        return out
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, -WIDE, WIDE).astype(np.int64)


def _resolved(left: DataFrame) -> DataFrame:
    """(q, id, row, score) of (q, id, row, v, qv): whole scores, exact at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = -(1 << 63), (1 << 63) - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                width = max(np.diff(batch.column(i).offsets.to_numpy()).max(initial=0) for i in (3, 4))
                v, qv = _matrix(batch.column(3), width), _matrix(batch.column(4), width)
                scores = np.einsum("ij,ij->i", v, qv)
                # doubles tell, with room to spare, which sums may leave 64 bits
                reach = np.abs(v).max(axis=1, initial=0).astype(float) * np.abs(qv).max(axis=1, initial=0).astype(float) * max(1, width)
                lowest = (v == low).any(axis=1) | (qv == low).any(axis=1)  # has no absolute value
                for i in np.flatnonzero((reach >= 2.0**61) | lowest):
                    scores[i] = max(low, min(high, sum(x * y for x, y in zip(v[i].tolist(), qv[i].tolist(), strict=True))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64())], ["q", "id", "row", "score"])

    return left.select("q", "id", "row", "v", "qv").mapInArrow(run, "q long, id long, row long, score long")


def _blocks(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def top_k(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_step: int = QUERY_STEP, lists: int = 2, query_block: int = 1024, chunk_rows: int = 2048) -> DataFrame:
    """The k best candidates of every row whose id is divisible by ``query_step``: query_id long,
    rank int from 1, vec_id long, score long.

    Equal vectors tie for every query, so only the k + 1 smallest ids of a vector can be among
    the k best beside the query itself: the others needn't be searched. Queries with equal
    vectors are searched once, for k + 1 candidates, and each then leaves out its own row.
    """
    spark = df.sparkSession
    staging = Staging(spark, "topk")
    every = staging.keep(prepared(df, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "every")
    in_order = (F.col("id").asc_nulls_last(), "row")
    first = F.row_number().over(Window.partitionBy("v").orderBy(*in_order))
    vectors = staging.keep(every.withColumn("at", first).where(F.col("at") <= k + 1).drop("at"), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    asked = every.where(F.col("id") % query_step == 0)
    queries = staging.keep(asked.groupBy("v").agg(F.min("row").alias("q")).select("q", "v"), "queries")
    found, last = spark.createDataFrame([], "q long, id long, row long, score long"), None
    while True:
        block = queries.where(F.lit(True) if last is None else F.col("q") > last).orderBy("q").limit(query_block).collect()
        if not block:
            break
        best = _search(queries.where(F.col("q").between(block[0]["q"], block[-1]["q"])), vectors, block, k + 1, width, lists, chunk_rows)
        found, last = found.unionByName(staging.keep(best, "found")), block[-1]["q"]
    members = asked.join(queries, "v").select(F.col("id").alias("query_id"), F.col("row").alias("own"), "q")
    best = Window.partitionBy("own").orderBy(F.col("score").desc(), *in_order)
    ranked = members.join(found, "q").where(F.col("row") != F.col("own")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _search(asked: DataFrame, vectors: DataFrame, block: list, k: int, width: int, lists: int, chunk_rows: int) -> DataFrame:
    """(q, id, row, score) of each query's k best objects; ``block`` holds the rows of ``asked``."""
    spark = vectors.sparkSession
    ids = [r["q"] for r in block]
    matrix = np.zeros((len(ids), width), np.int64)
    for i, r in enumerate(block):
        matrix[i, : len(r["v"])] = r["v"]
    shared = spark.sparkContext.broadcast((np.array(ids, np.int64), matrix))
    blocks = _blocks(width, lists)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                yield part.column(0).to_numpy(), _matrix(part.column(1), width)  # rows and vectors

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: the task's own k highest entries of every list, with their whole scores."""
        query_ids, qm = shared.value
        part = [np.zeros((len(query_ids), 0), np.int64) for _ in blocks]
        whole, own = list(part), list(part)
        for chunk_ids, v in chunks(batches):
            scores = _product(qm, v)
            n = min(k, len(chunk_ids))
            for j, s in enumerate(blocks):
                partial = _product(qm[:, s], v[:, s])
                top = np.argpartition(-partial, n - 1, axis=1)[:, :n]
                found = np.hstack((part[j], np.take_along_axis(partial, top, axis=1)))
                keep = np.argsort(-found, axis=1, kind="stable")[:, :k]
                part[j] = np.take_along_axis(found, keep, axis=1)
                whole[j] = np.take_along_axis(np.hstack((whole[j], np.take_along_axis(scores, top, axis=1))), keep, axis=1)
                own[j] = np.take_along_axis(np.hstack((own[j], chunk_ids[top])), keep, axis=1)
        for w, o in zip(whole, own, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, o.shape[1])), pa.array(o.ravel()), pa.array(w.ravel())], ["q", "row", "score"])

    searched = vectors.select("row", "v")
    gathered = searched.mapInArrow(gather, "q long, row long, score long").distinct()
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "row"))
    bounds = gathered.withColumn("at", place).where(F.col("at") == k).select("q", "score").collect()
    # any k whole scores bound the k-th best from below; with fewer objects than k all are wanted
    safe = {r["q"]: r["score"] for r in bounds}
    lowest = -(1 << 62)
    reach = [safe.get(q, lowest) for q in ids]
    # integers: if their sum is T or more, one of the lists holds ceil(T / lists) or more
    floor = np.array([-(-t // lists) if t > lowest else lowest for t in reach], np.int64)
    floors = spark.sparkContext.broadcast(floor)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 2: every entry at or above the query's cutoff."""
        query_ids, qm = shared.value
        for own, v in chunks(batches):
            for s in blocks:
                scores = _product(qm[:, s], v[:, s])
                qi, ci = np.nonzero(scores >= floors.value[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[qi]), pa.array(own[ci]), pa.array(scores[qi, ci])], ["q", "row", "part"])

    limits = spark.createDataFrame([(q, int(f), int(t)) for q, f, t in zip(ids, floor.tolist(), reach, strict=True)], "q long, cutoff long, safe long")
    wide = (F.abs("part") >= WIDE).cast("int")
    met = searched.mapInArrow(collect, "q long, row long, part long").groupBy("q", "row").agg(F.sum("part").alias("part"), F.count("*").alias("n"), F.max(wide).alias("wide"))
    # a list that doesn't show the object holds less than the cutoff there
    met = met.join(F.broadcast(limits), "q")  # query_block rows
    open_ = (F.col("safe") == lowest) | (F.col("wide") == 1) | (F.col("part") + (lists - F.col("n")) * F.col("cutoff") >= F.col("safe"))
    left = met.where(open_).select("q", "row")
    # Phase 3: whole scores of what is left
    exact = left.join(vectors, "row").join(F.broadcast(asked.select("q", F.col("v").alias("qv"))), "q")  # query_block vectors
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return _resolved(exact).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at")


def top_k_sql(k: int = 10) -> str:
    """Brute force in DuckDB SQL, for unique ids and vectors of one length."""
    return f"""
    WITH ok AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= {k}
    """
