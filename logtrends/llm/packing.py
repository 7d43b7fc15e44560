"""Packing by powers of two: each document is cut into pieces whose lengths are the binary digits of its own length.

A piece is a whole sequence, so that no sequence crosses documents and none is padded. Sequences of one length form a
bucket; ids run bucket by bucket, longest first, without gaps, so that a trainer draws batches of equal lengths by id range.

Defined cases: a null or empty text is a document of its end id alone (one piece of length 1); rows that repeat a document
are packed each by itself; an empty table gives no rows; other columns take no part. Texts are packed whole.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrends.llm.bpe import library_encoder
from logtrends.llm.common import Workspace, byte_slices

#: Bytes of texts, and of their ids, worked on at once.
SLICE = 1 << 21


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first, none above ``longest``."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, longest: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of each piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers. Every task numbers the pieces of each length
    by itself; the numbers of the tasks are then laid end to end with one offset per task and length.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = library_encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        end = array("I", [end_id]).tobytes()
        for batch in byte_slices(batches, 1, SLICE):
            rows: list[list] = [[] for _ in range(6)]
            held = 0
            for row, text_ in enumerate(batch.column(1).to_pylist()):
                ids = encode(text_) + end
                total = len(ids) // 4
                at = 0
                for n in binary_lengths(total, longest):
                    for out, value in zip(rows, (row, at, n, ids[4 * at : 4 * (at + n)], total, made[n]), strict=True):
                        out.append(value)
                    made[n] += 1
                    at += n
                held += len(ids)
                if held > SLICE:
                    yield piece_batch(batch, rows, part)
                    rows, held = [[] for _ in range(6)], 0
            yield piece_batch(batch, rows, part)

    def piece_batch(batch: pa.RecordBatch, rows: list[list], part: int) -> pa.RecordBatch:
        at, start, length, ids, total, local = rows
        ints = [pa.array(x, pa.int64()) for x in (start, length, total, local, [part] * len(at))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), *ints[:2], pa.array(ids, pa.binary()), *ints[2:]],
            [key, "start", "length", "ids", "doc_tokens", "local", "part"])

    kind = docs.schema[key].dataType.simpleString()
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.store(docs.select(key, F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, local long, part long"), "pieces")
    counts = pieces.groupBy("length", "part").agg((F.max("local") + 1).alias("n"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))
    # one row per power of two, and per length one row per task
    bucket = lengths.select("length", (F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).alias("first"))
    within = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = counts.select("length", "part", within.alias("before")).join(F.broadcast(bucket), "length").select(
        "length", "part", (F.col("first") + F.col("before")).alias("first"))
    offsets = work.store(offsets, "offsets")
    return pieces.join(offsets, ["length", "part"]).select(
        key, "start", "length", "ids", "doc_tokens", (F.col("first") + F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
