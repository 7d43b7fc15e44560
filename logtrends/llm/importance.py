"""Resampling of documents towards a target corpus by importance weights of hashed n-grams.

Texts are lower-cased (A-Z only) and cut into words of digits, a-z and everything outside ASCII; the features of a text are its runs of
``shortest`` to ``longest`` words, joined by one space, repeats counted. A feature's bucket is the CRC-32 of its bytes modulo the number of buckets.

1. Per slice of a batch the features are interned in an open-addressed NumPy table: 64-bit xxhash keys, linear probing, and a comparison of
   the bytes with those of the feature that holds the slot. A slot holds bucket and count; slots add up to the counts of the buckets.
2. Counts over the whole source and the whole target give every bucket a gain, the floored scaled log of the ratio of smoothed shares.
3. The slices are interned again; each slot takes the gain of its bucket, each occurrence the gain of its slot, and a document's
   weight is the sum over its occurrences.
4. Scores are weights plus Gumbel noise from a hash of the id; the highest ones are drawn, without replacement, from the documents with enough words.

Only the counts of the buckets (a fixed number) reach the driver. Ranks come from ranges of the sorted scores, not from one task.

Defined cases: a null text has no words, so weight 0, and is not drawn unless ``least_words`` is 0; the noise of a null id is that of an empty id, null ids come last
among equal scores; rows that repeat an id are documents of their own (equal rows in any order); an empty source gives no rows, an empty target counts 0
everywhere; other columns take no part. Texts are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from logtrends.llm.common import Workspace, byte_slices, text_bytes
from logtrends.operators.order import number_all

#: Fixed value: smoothing, scale of gains and of noise.
SCALE = 1_000
#: Bytes of texts whose features are interned together.
SLICE = 1 << 22


def _letters() -> bytes:
    """Bytes of words as they are, A-Z in lower case, every other byte as a space."""
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    found = bytearray(b" " * 256)
    for b in kept:
        found[b] = b
    for b in range(0x41, 0x5B):
        found[b] = b + 32
    return bytes(found)


LETTERS = _letters()


def features(raws: Iterator[np.ndarray], shortest: int, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(features of all texts one after the other, number of features and of words of each text)."""
    found: list[bytes] = []
    n_features, n_words = [], []
    for raw in raws:
        words = raw.tobytes().translate(LETTERS).split()
        before = len(found)
        for n in range(shortest, longest + 1):
            found += words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        n_features.append(len(found) - before)
        n_words.append(len(words))
    return found, np.array(n_features, np.int64), np.array(n_words, np.int64)


class Interned:
    """An open-addressed table of the features of one slice.

    ``slot`` is the slot of each occurrence; ``used`` lists the slots in use, ``bucket`` and ``count`` belong to these slots.
    """

    def __init__(self, found: list[bytes], buckets: int):
        n = len(found)
        size = 1 << max(4, (2 * n - 1).bit_length() if n else 0)
        mask = np.uint64(size - 1)
        self.keys = np.fromiter(map(xxh64_intdigest, found), np.uint64, n)
        holder = np.full(size, -1, np.int64)
        self.slot = (self.keys & mask).astype(np.int64)
        lengths = np.fromiter(map(len, found), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(found), np.uint8)
        open_ = np.arange(n)
        while len(open_):
            at = self.slot[open_]
            free = holder[at] < 0
            holder[at[free]] = open_[free]  # of several that want one free slot the last one gets it
            held = holder[at]
            same = (self.keys[held] == self.keys[open_]) & (lengths[held] == lengths[open_])
            check = np.flatnonzero(same & (held != open_))
            same[check] = equal_bytes(raw, starts[held[check]], starts[open_[check]], lengths[open_[check]])
            open_ = open_[~same]
            self.slot[open_] = (self.slot[open_] + 1) & int(mask)
        self.used = np.flatnonzero(holder >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.used] = [zlib.crc32(found[i]) % buckets for i in holder[self.used].tolist()]
        self.count = np.bincount(self.slot, minlength=size)


def equal_bytes(raw: np.ndarray, one: np.ndarray, two: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether raw[one : one + length] equals raw[two : two + length], for each triple."""
    equal = np.ones(len(one), bool)
    long = lengths > 64  # compared one by one; the rest column by column
    for i in np.flatnonzero(long).tolist():
        equal[i] = np.array_equal(raw[one[i] : one[i] + lengths[i]], raw[two[i] : two[i] + lengths[i]])
    left = np.flatnonzero(~long)
    step = 0
    while len(left := left[lengths[left] > step]):
        equal[left] &= raw[one[left] + step] == raw[two[left] + step]
        step += 1
    return equal


def bucket_counts(texts: DataFrame, buckets: int, shortest: int, longest: int) -> np.ndarray:
    """Features in each bucket over all rows of (text); every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in byte_slices(batches, 0, SLICE):
            found, _, _ = features(text_bytes(batch.column(0)), shortest, longest)
            table = Interned(found, buckets)
            np.add.at(total, table.bucket[table.used], table.count[table.used])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    total = np.zeros(buckets, np.int64)
    for row in rows:
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored scaled log of the ratio of smoothed shares, per bucket."""
    k = len(source)
    all_s, all_t = float(source.sum() + k), float(target.sum() + k)
    return np.array([
        math.floor(SCALE * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t)))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight) of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, SLICE):
            found, n_features, n_words = features(text_bytes(batch.column(1)), shortest, longest)
            table = Interned(found, len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[table.bucket][table.slot])])
            ends = np.cumsum(n_features)
            weight = sums[ends] - sums[ends - n_features]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of seed and id, floored and scaled as gains are."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, buckets: int = 10_000,
             shortest: int = 1, longest: int = 1, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``; rank counts the drawn ones from 1 and is null for the others.

    Drawn is the ``share`` (a fraction as two whole numbers, rounded down) of the documents with at least ``least_words`` words.
    """
    work = Workspace(docs.sparkSession, "importance")
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    source = bucket_counts(rows.select("text"), buckets, shortest, longest)
    wanted = bucket_counts(target.select(F.col(target_text).cast("string").alias("text")), buckets, shortest, longest)
    made = weighted(rows, gains(source, wanted), shortest, longest)
    # stored with a number that parts equal rows, so that no range of the sorted scores is a single hot value
    scored = work.store(made.select(
        "id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("fits"),
        F.monotonically_increasing_id().alias("row")), "scored")
    n = scored.where("fits").count()
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    placed = number_all(scored, order, "place")
    rank = F.when(F.col("fits") & (F.col("place") < n * share[0] // share[1]), F.col("place") + 1).cast("long").alias("rank")
    return placed.select(F.col("id").alias(key), "n_features", "weight", "score", rank)
