"""Approximate nearest neighbours by a permutation index.

A fixed number of pivots is drawn from the vectors. Each vector is represented by its nearest pivots in order. The chunks of the index
hold one inverted file per pivot with the rows that list it and the places at which they do. A query reads the files of its own pivots,
sums up the footrule distance between the two orders (a pivot that one list lacks counts as standing just behind its end), takes the
nearest share of the chunk and ranks these by exact cosine.

Every row is indexed; only the pivots are a sample: the ``pivots`` vectors with the smallest hash of their id. Vectors without
structure (random directions) need long permutations and a large share for a high recall; the defaults reach 0.9 there as well.

Equal vectors are one entry with its k + 1 smallest ids, so that a group of copies of any size costs one vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; of rows that
repeat an id the smallest vector counts; vectors of different dimension are never compared; ties go to the smaller id; a query without
candidates gives no row; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace
from logtrends.llm.topk import best_ids, classes, matrix, valid_vectors

PIVOTS, PLACES, SHARE, LEAST = 256, 64, 0.25, 256
CHUNK, BLOCK = 8_192, 4_096


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither huge nor tiny components overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    return np.argsort(-(unit(v) @ unit(pivots).T), axis=1, kind="stable")[:, :places]


def with_places(vectors: DataFrame, pivots: dict[int, np.ndarray], places: int) -> DataFrame:
    """Adds ``near``, the pivots of ``v`` in order, for the pivots of its dimension."""
    names, kinds = vectors.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    v_at, dim_at = names.index("v"), names.index("dim")
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in batch.column(dim_at).unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column(dim_at), dim))
                near = nearest_pivots(matrix(own.column(v_at)), sent.value[dim], places)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns, lists], [*names, "near"])

    return vectors.mapInArrow(run, f"{kinds}, near array<int>")


class InvertedFiles:
    """Per pivot the rows of one chunk that list it, with the places."""

    def __init__(self, near: np.ndarray, pivots: int):
        self.rows, self.places = near.shape
        order = np.argsort(near, axis=None, kind="stable")
        self.row, self.place = order // self.places, (order % self.places).astype(np.int32)
        self.ends = np.searchsorted(near.ravel()[order], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of every row to the query's order; 0 for equal orders."""
        saved = np.zeros(self.rows, np.int32)
        for place, pivot in enumerate(query.tolist()):
            own = slice(self.ends[pivot], self.ends[pivot + 1])
            saved[self.row[own]] += self.places - np.maximum(self.place[own], place)
        return self.places * (self.places + 1) - 2 * saved


def search_chunk(queries: pa.Table, chunk: pa.Table, k: int, share: float, pivots: int) -> Iterator[tuple[int, int, float]]:
    v, near = unit(matrix(chunk["v"])), matrix(chunk["near"])
    files = InvertedFiles(near, pivots)  # pivots that no row of the chunk lists have empty files
    ids, take = chunk["ids"].to_pylist(), max(LEAST, k + 1, int(np.ceil(share * chunk.num_rows)))
    for own, q, listed in zip(queries["query_id"].to_pylist(), unit(matrix(queries["v"])), matrix(queries["near"]), strict=True):
        if take < files.rows:
            rows = np.argpartition(files.footrule(listed), take)[:take]
        else:
            rows = np.arange(files.rows)
        for i, s in best_ids(v[rows] @ q, [ids[r] for r in rows.tolist()], own, k):
            yield own, i, float(s)


def nearest(df: DataFrame, k: int, is_query: Column, key: str = "vec_id", vector: str = "embedding",
            pivots: int = PIVOTS, places: int = PLACES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines found for each query; ``is_query`` selects by the column ``id``."""
    work = Workspace(df.sparkSession, "ann")
    vectors = valid_vectors(df, key, vector).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    vectors = work.store(vectors, "vectors")
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    sample = vectors.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= pivots).select("dim", "v").collect()
    by_dim = {d: np.array([r["v"] for r in sample if r["dim"] == d]) for d in {r["dim"] for r in sample}}
    every = classes(vectors.select("id", "v"), k).withColumn("dim", F.size("v"))
    every = work.store(with_places(every.select("rep", "v", "ids", "dim"), by_dim, places), "index")
    sizes = every.groupBy("dim").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = every.join(sizes, "dim").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    queries = vectors.where(is_query).select(F.col("id").alias("query_id"), "v", "dim")
    queries = work.store(with_places(queries, by_dim, places), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    sent = queries.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("dim", "chunk", "block", "query_id", "v", "near")
    files = placed.select("dim", "chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "v", "ids", "near")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(search_chunk(left, right, k, share, counts[left["dim"][0].as_py()])) if left.num_rows and right.num_rows else []
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    counts = {dim: len(found) for dim, found in by_dim.items()}
    by = ["dim", "chunk", "block"]
    hits = sent.groupBy(*by).cogroup(files.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
