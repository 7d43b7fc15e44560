"""Helpers that the operators of this folder share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrends.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ODD = 0x9E3779B97F4A7C15
#: ASCII white space; every other byte belongs to a word.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Workspace:
    """Tables written by one run of an operator, below the shared folder of the session.

    Written tables survive lost executors. Shuffle files of a write are released when it has ended, and
    tables that nothing reads any more are removed by ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


# -- what a Python worker keeps ------------------------------------------------------------------

_KEPT: list = []


def kept_by_worker(make: Callable) -> Callable:
    """``make``, whose results a Python worker keeps for its next tasks until one of them calls ``forget``."""
    _KEPT.append(lru_cache(make))
    return _KEPT[-1]


def forget() -> None:
    """Give up the vocabularies and word caches that earlier tasks left in this Python worker, which outlives them.

    Called by tasks that need none of them, so that they do not work beside idle caches."""
    for cache in _KEPT:
        cache.cache_clear()
    pa.default_memory_pool().release_unused()


# -- words ---------------------------------------------------------------------------------------

#: Words of one generation of a cache, of which it holds two; longer words are never kept.
CACHE_WORDS, CACHE_LENGTH = 250_000, 64


class WordCache(dict):
    """What ``make`` gives for a word. Words that were not asked for while ``CACHE_WORDS`` others came up are forgotten."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, word):
        made = self.before.pop(word, None)
        if made is None:
            made = self.make(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = made
        return made


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Random values for each byte at each place of a word; longer words are hashed by a cryptographic function.
_VALUES = np.random.default_rng(20_240_601).integers(0, 1 << 64, (64, 256), np.uint64)


def word_hashes(data: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """One 64-bit hash per word of UTF-8 bytes, in order. Long texts are walked in pieces cut at white space.

    The sum of random values drawn for each byte at its place, mixed with the length: no pattern of letters makes two words agree.
    """
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and not _SPACE[data[end]]:
            stop = np.flatnonzero(_SPACE[data[end : end + piece]])
            end += int(stop[0]) if len(stop) else min(piece, len(data) - end)
        found.append(_hash_words(data[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def hashes_of_texts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts one after another, and how many each text has. Meant for a slice of small texts or one long text."""
    if len(texts) == 1:
        hashes = word_hashes(texts[0])
        return hashes, np.array([len(hashes)])
    joined = np.frombuffer(b"\n".join([t.data for t in texts]), np.uint8)
    hashes, starts = _hash_words(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def hashed_texts(texts: Iterator[np.ndarray], size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``hashes_of_texts`` of successive groups of texts, of about ``size`` bytes or one text each."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > size:
            yield hashes_of_texts(group)
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield hashes_of_texts(group)


def words_of_texts(texts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The word hashes of each text; those of small texts are made together."""
    for words, counts in hashed_texts(texts):
        yield from np.split(words, np.cumsum(counts)[:-1])


def _hash_words(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of a piece. Words are walked place by place, longest first, so that those with a place are a prefix."""
    inside = np.zeros(len(part) + 2, bool)
    np.logical_not(_SPACE[part], out=inside[1:-1])
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = bounds[::2], bounds[1::2] - bounds[::2]
    places = np.minimum(lengths, 64).astype(np.uint8)
    order = np.argsort(64 - places, kind="stable")
    at, sums = starts[order], np.zeros(len(starts), np.uint64)
    having = len(starts) - np.cumsum(np.bincount(places, minlength=65))
    for place in range(64):
        n = having[place]
        if not n:
            break
        sums[:n] += _VALUES[place][part[at[:n]]]
        at[:n] += 1
    hashes = np.empty(len(starts), np.uint64)
    hashes[order] = sums
    hashes = mix(hashes + lengths.astype(np.uint64) * np.uint64(_ODD))
    for i in np.flatnonzero(lengths > 64).tolist():
        word = part[starts[i] : starts[i] + lengths[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes, starts


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two runs that follow each other; for one side held fixed, a bijection of the other."""
    h = left * np.uint64(_ODD) + right
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, by its first word; none if there are fewer words."""
    return runs_of(words, n)[0]


def runs_of(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """``run_hashes`` for several sizes. Runs of 1, 2, 4 ... words are joined pairwise; the binary digits of a size say which of them make up a run."""
    counts = [max(0, len(words) - n + 1) if n > 0 else 0 for n in sizes]
    made, done = [np.empty(0, np.uint64)] * len(sizes), [0] * len(sizes)
    power, size, largest = mix(words), 1, max([n for n, c in zip(sizes, counts, strict=True) if c], default=0)
    while size <= largest:
        for i, (n, count) in enumerate(zip(sizes, counts, strict=True)):
            if count and n & size:
                here = power[done[i] : done[i] + count]
                made[i], done[i] = _joined(made[i], here) if done[i] else here, done[i] + size
        if 2 * size <= largest:
            power = _joined(power[:-size], power[size:])
        size *= 2
    return [mix(h + np.uint64(n)) if len(h) else h for h, n in zip(made, sizes, strict=True)]


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if data is None:
        yield from (np.empty(0, np.uint8) for _ in range(len(column)))
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i] if nulls[i] else at[i + 1]]


def byte_slices(batches: Iterator[pa.RecordBatch], column: int | Callable[[pa.RecordBatch], pa.Array], size: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``size`` bytes in a column of texts, one row at least; batches without rows are left out."""
    for batch in batches:
        texts = column(batch) if callable(column) else batch.column(column)
        width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + batch.num_rows + 1] if batch.num_rows else np.zeros(1, width)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def is_space(raw: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _SPACE[raw]


def file_system(uri: str):
    """(file system, path) of a folder or file named by a URI or an absolute path; works inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_tasks(index: DataFrame, each: int = 1 << 24) -> int:
    """Tasks that read the byte ranges of an index with a column ``size``, about ``each`` bytes at a time."""
    total = index.agg(F.sum("size")).first()[0] or 0
    return max(index.sparkSession.sparkContext.defaultParallelism, -(-total // each))


# -- connected components ------------------------------------------------------------------------

def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars around the smallest vertex of each piece."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    members = [v for v in parent if root(v) != v]
    yield pa.RecordBatch.from_arrays(
        [pa.array(members, pa.int64()), pa.array([parent[v] for v in members], pa.int64())], ["a", "b"])


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(v, root): for each vertex of the edges (a, b) the smallest vertex it is connected with.

    Star contraction: in turn every vertex hands its larger, then its smaller neighbours to the smallest
    one it knows, until only stars are left. The number of rounds grows with the logarithm of the longest path.
    Hot vertices meet one aggregated row each; these rows are stored before they are joined, so that adaptive execution sees plain
    exchanges on both sides and can split a hot vertex. Each round is written to the shared folder.
    """
    now = work.store(edges.select("a", "b").mapInArrow(_contract, "a long, b long"), f"{name}-0")
    state, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step += 1
        least = work.store(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"{name}-{step}-least")
        large = work.store(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-{step}-large")
        least = work.store(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{step}-least-of-large")
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = work.store(small, f"{name}-{step}")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{step - 1}", *[f"{name}-{step}-{part}" for part in ("least", "large", "least-of-large")])
        now = after
        if state == tuple(seen):
            break
        state = tuple(seen)
    roots = now.select(F.col("b").alias("v")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots.select("v", F.col("v").alias("root")))
