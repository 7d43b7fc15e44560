"""Exact inner-product search by length buckets.

Candidates are grouped by vector length into buckets of quantiles. Within a bucket a product q.v can reach a bound t only if the
cosine reaches t / (|q| max|v|), the local threshold. Per bucket and query one of two prunings is chosen from it:

* none of the bucket, if the threshold is above 1;
* by length, if it is low: only vectors with |v| >= t / |q| are multiplied;
* by coordinates, if it is high: with x = v / |v| and y = q / |q| of cosine >= c, the coordinate x_f lies within
  y_f c +- sqrt((1 - c^2) (1 - y_f^2)); the largest coordinates of the query are tested.

What is left is verified by whole-number products. The bound of a query is its k-th best score among the longest bucket.

Queries and candidates meet in blocks of bounded size; a block of queries is sent only to the chunks whose length allows a hit.
Equal vectors are one candidate: it keeps its k + 1 smallest ids, which is all a list of k can hold, so a group of copies of any size costs one vector.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; of rows that repeat an
id the smallest vector counts; vectors of different dimension are never compared; ties go to the smaller id; a query without
candidates gives no row; other columns take no part. Scores wrap beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace

#: Rows of a chunk of candidates, rows of a block of queries, buckets by length, coordinates tested.
CHUNK, BLOCK, BUCKETS, FOCUS = 8_192, 4_096, 64, 4
#: From this local threshold on coordinates prune.
STEEP = 0.6


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with one row per id; v as array<double>."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(fine)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): equal vectors once, with the k + 1 smallest ids.

    The smallest ids are found by ranking below the limit before and after the shuffle; no list of a whole group is made.
    """
    order = Window.partitionBy("v").orderBy("id")
    few = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def best_ids(scores: np.ndarray, ids: list[list[int]], own: int, k: int) -> list[tuple[int, float]]:
    """The k best (id, score) of candidate classes, ties to the smaller id, without the query's own id."""
    if len(scores) > 4 * k + 4:
        # k + 1 classes at least reach this score; one of them may hold nothing but the query itself
        rows = np.flatnonzero(scores >= -np.partition(-scores, k)[k])
        scores, ids = scores[rows], [ids[r] for r in rows.tolist()]
    order = np.argsort(-scores, kind="stable")
    found: list[tuple[float, int]] = []
    for at in order.tolist():
        if len(found) >= k and -scores[at] > found[k - 1][0]:
            break
        found += [(-scores[at], i) for i in ids[at] if i != own]
        found.sort()
        del found[k:]
    return [(i, -s) for s, i in found]


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole-number products; by doubles where these are exact, else by 64-bit integers that wrap."""
    if np.abs(v).max(initial=0) * np.abs(q).sum() < 2.0**53:
        return v @ q
    with np.errstate(invalid="ignore", over="ignore"):
        return (v.astype(np.int64) * q.astype(np.int64)).sum(axis=1)


def survivors(v: np.ndarray, length: np.ndarray, unit: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Rows of one bucket's chunk that may reach ``bound``; nothing that does is left out."""
    norm = np.sqrt(q @ q)
    top = length.max(initial=0)
    if not bound > 0 or norm == 0:
        return np.arange(len(v))  # any product may reach it
    local = bound / (norm * top) if top else np.inf
    slack = 1e-9
    if local > 1 + slack:
        return np.empty(0, np.int64)
    keep = length * norm >= bound * (1 - slack)
    if local >= STEEP:
        y, c = q / norm, np.minimum(local, 1)
        for f in np.argsort(-np.abs(y))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - y[f] * y[f]))) + slack
            near = y[f] * c
            # beyond the query's own coordinate the whole cap may lie on the pole
            low = -1.0 if y[f] <= -c else near - spread
            high = 1.0 if y[f] >= c else near + spread
            keep &= (unit[:, f] >= low) & (unit[:, f] <= high)
    return np.flatnonzero(keep)


def search_chunk(queries: pa.Table, chunk: pa.Table, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the k best of the chunk per query, as far as they reach the query's bound."""
    v, q = matrix(chunk["v"]), matrix(queries["v"])
    ids = chunk["ids"].to_pylist()
    length = np.sqrt((v * v).sum(axis=1))
    unit = v / np.where(length > 0, length, 1)[:, None]
    for own, vector, bound in zip(queries["query_id"].to_pylist(), q, queries["bound"].to_pylist(), strict=True):
        rows = survivors(v, length, unit, vector, -np.inf if bound is None else bound)
        if len(rows):
            scores = exact_scores(v[rows], vector)
            for i, s in best_ids(scores, [ids[r] for r in rows.tolist()] if len(rows) < len(ids) else ids, own, k):
                if bound is None or s >= bound:
                    yield own, i, int(s)


def _in_chunks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(search_chunk(left, right, k)) if left.num_rows and right.num_rows else []
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    by = ["dim", "bucket", "chunk"]
    sides = queries.groupBy(*by, "block").cogroup(chunks.groupBy(*by, "block"))
    return sides.applyInArrow(run, "query_id long, vec_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(df: DataFrame, k: int, is_query: Column, key: str = "vec_id", vector: str = "embedding",
                 prepare: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest whole-number inner products of each query.

    ``is_query`` selects queries by the column ``id``; ``prepare`` turns the array column ``v`` into whole numbers.
    """
    work = Workspace(df.sparkSession, "topk")
    vectors = valid_vectors(df, key, vector)
    if prepare is not None:
        vectors = vectors.withColumn("v", prepare)
    vectors = work.store(vectors, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    every = work.store(classes(vectors, k).withColumn("length", norm).withColumn("dim", F.size("v")), "classes")
    # at most one row per bucket: a bounded list of lengths
    cuts = every.stat.approxQuantile("length", [i / BUCKETS for i in range(1, BUCKETS)], 0.001) if every.take(1) else []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    bucket = F.size(F.filter(edges, lambda c: c > F.col("length")))  # 0 holds the longest
    placed = every.withColumn("bucket", bucket)
    sizes = placed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).withColumn(
        "chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    sizes = work.store(sizes, "buckets")
    chunked = work.store(placed.join(sizes.select("dim", "bucket", "chunks"), ["dim", "bucket"]).withColumn(
        "chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).select("dim", "bucket", "chunk", "v", "ids"), "chunks")
    queries = vectors.where(is_query).select(F.col("id").alias("query_id"), "v", F.size("v").alias("dim"))
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    if not n_queries:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.col("query_id").alias("score"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def meet(asked: DataFrame, spread: DataFrame) -> DataFrame:
        """Queries sent to chunks: ``spread`` has (dim, bucket, chunks, longest) of the buckets."""
        sent = asked.join(spread, "dim")
        # no product of the bucket can reach the bound: left out before anything is sent
        sent = sent.where("bound is null or bound <= 0 or qlen * longest >= bound * 0.999999999")
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = chunked.join(spread.select("dim", "bucket"), ["dim", "bucket"]).select("*", copies)
        return _in_chunks(sent.select("dim", "bucket", "chunk", "block", "query_id", "v", "bound"), right, k)

    asked = queries.withColumn("qlen", norm)
    first = sizes.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    seeds = meet(asked.withColumn("bound", F.lit(None).cast("double")), sizes.join(first, ["dim", "bucket"]))
    seeds = work.store(_ranked(seeds, k), "seeds")
    bounds = seeds.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    rest = sizes.join(first, ["dim", "bucket"], "left_anti")
    later = meet(asked.join(bounds, "query_id", "left"), rest)
    hits = seeds.select("query_id", "vec_id", "score").unionByName(later)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
