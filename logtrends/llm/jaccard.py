"""Documents that are near copies: Jaccard similarity of their sets of word n-grams, found by MinHash banding and verified.

Band and row counts are chosen for a target recall at the threshold. The steps:

1. Each text becomes its set of n-grams of lower-case words (a text of fewer words is one n-gram of all of them) and a MinHash signature.
   Equal sets are one vertex with a number of copies.
2. Vertices are shuffled on the hashes of their bands. A bucket hands each member only its smallest vertex, so buckets give
   one row per member, never pairs. Connected vertices form a family; whatever shares a band is in one family.
3. Within a family all pairs are verified on the full sets, in blocks of bounded size: small families share a task, a large one is
   cut into blocks that meet pairwise. A task returns per vertex the number of its links and one edge to the group it is linked
   with, never pairs. The work of a family grows with the square of its different texts; rows do not.
4. Classes are the connected components of the verified links.

Defined cases: a null or blank text has no n-grams and is linked with nothing, not even with other blank texts; ids may be null or
repeat (rows of equal id and text are copies); a class is named by its smallest id, nulls last; an empty table gives no rows; other columns take no part
and, where they are carried, may have any names. N-grams are known by 64-bit hashes, sets of them by 128 bits, vertices by the first 64 of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace, byte_slices, components, forget, hashed_texts, mix, run_hashes, text_bytes

#: N-grams of one block of a family; columns of the block products.
BLOCK, COLUMNS = 1 << 20, 4_096
#: Bytes of texts worked on at once.
SLICE = 1 << 21
KEY, SIGNED = "doc_id long, uid long", "high long, low long, size int, bands array<long>"


def band_plan(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes so that two sets at the threshold share a band with probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def ngram_sets(texts: Iterator[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Sorted different n-gram hashes of each lower-case text."""
    for words, counts in hashed_texts(texts):
        runs = run_hashes(words, n)
        for end, count in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            whole = run_hashes(words[end - count : end], count) if count < n else runs[end - count : end - n + 1]
            yield np.unique(whole)


def signature(grams: np.ndarray, keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set; large sets are walked in pieces."""
    least = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = (grams[at : at + 512, None] ^ keys) * factors
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_601)
    high = np.iinfo(np.uint64).max
    return draw.integers(0, high, count, np.uint64), draw.integers(0, high, count, np.uint64) | np.uint64(1)


def _identity(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, free of order."""
    one, two = mix(grams), mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    salt = np.array([len(grams)], np.uint64)
    return int(mix(one.sum(keepdims=True) + salt).view(np.int64)[0]), int(mix(two.sum(keepdims=True) + salt).view(np.int64)[0])


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, uid, high, low, size, bands) of (doc_id, uid, text) rows; texts without words have size 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, factors = _functions(bands * rows)
        number = np.arange(bands, dtype=np.uint64)
        for batch in byte_slices(batches, 2, SLICE):
            out: list[list] = [[], [], [], []]
            for grams in ngram_sets(text_bytes(batch.column(2)), n):
                marks: list[int] = []
                if len(grams):
                    least = signature(grams, keys, factors).reshape(bands, rows)
                    h = number.copy()
                    for r in range(rows):
                        h = mix(h + least[:, r])
                    marks = h.view(np.int64).tolist()
                for column, value in zip(out, (*_identity(grams), len(grams), marks), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["doc_id", "uid", "high", "low", "size", "bands"])

    return docs.mapInArrow(run, f"{KEY}, {SIGNED}")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(v, grams): the sorted n-gram hashes of (v, text) rows, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, 1, SLICE):
            v, sets, held = [], [], 0
            for key, grams in zip(batch.column(0).to_pylist(), ngram_sets(text_bytes(batch.column(1)), n), strict=True):
                v.append(key)
                sets.append(grams.tobytes())
                held += len(sets[-1])
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(sets, pa.binary())], ["v", "grams"])
                    v, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(sets, pa.binary())], ["v", "grams"])

    return docs.mapInArrow(run, "v long, grams binary")


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether left[i] and right[j] (or left[j], without itself) reach the threshold; exact.

    N-grams of a single set cannot be shared: only the others become columns of 0/1 matrices whose product counts shared n-grams.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    row, keep = np.repeat(np.arange(len(sets)), sizes), times[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    m = len(left)
    common = np.zeros((m, len(sets) - m if right else m), np.float64)
    ends = np.searchsorted(column, np.arange(0, int(times.size and (times > 1).sum()) + COLUMNS, COLUMNS))
    for at, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        grid = np.zeros((len(sets), int(column[b - 1]) - at * COLUMNS + 1), np.float32)
        grid[row[a:b], column[a:b] - at * COLUMNS] = 1
        common += grid[:m] @ (grid[m:] if right else grid).T
    union = sizes[:m, None] + (sizes[m:] if right else sizes)[None, :] - common
    near = common >= threshold * union * (1 - 1e-12)
    if not right:
        np.fill_diagonal(near, False)
    return near


def _verify(group: pa.Table, threshold: float) -> pa.Table:
    """Links of one task: (v, links, a). ``side`` is 0 for the left block, 1 for the right, 2 for a family that is one block."""
    group = group.sort_by("family")
    families = np.asarray(group["family"])
    v, copies, side = np.asarray(group["v"]), np.asarray(group["copies"]), np.asarray(group["side"])
    grams = group["grams"]
    out_v, out_links, out_edge = [], [], []
    edges = [0, *(np.flatnonzero(np.diff(families)) + 1).tolist(), len(families)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams.slice(a, b - a)]
        own = np.arange(a, b)
        two = side[a] < 2
        left = np.flatnonzero(side[a:b] == 0) if two else np.arange(b - a)
        right = np.flatnonzero(side[a:b] == 1) if two else left
        if not len(left) or not len(right):
            continue
        near = similar([sets[i] for i in left], [sets[i] for i in right] if two else None, threshold)
        x, y = v[own[left]], v[own[right]]
        label, reached = spread_labels(near, x, y)
        out_v.append(x)
        out_links.append(near @ copies[own[right]])
        out_edge.append(label)
        if two:
            out_v.append(y)
            out_links.append(copies[own[left]] @ near)
            out_edge.append(reached)
    if not out_v:
        return pa.table({"v": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "a": pa.array([], pa.int64())})
    return pa.table({"v": np.concatenate(out_v), "links": np.concatenate(out_links).astype(np.int64), "a": np.concatenate(out_edge)})


def spread_labels(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column vertex of a block the smallest vertex it reaches over the links of the block."""
    none = np.iinfo(np.int64).max
    label = x
    while True:
        reached = np.minimum(np.where(near, label[:, None], none).min(axis=0), y)
        lower = np.minimum(np.where(near, reached[None, :], none).min(axis=1), label)
        if (lower == label).all():
            return label, reached
        label = lower


def near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, rows: int = 6,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, uid, class_id, n_links, first): each row's class, the rows it is linked with, and whether its (id, text) names the class.

    ``uid`` is a hash of the text. ``docs`` must give the same rows each time it is read.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("uid"), F.lower(F.col(text).cast("string")).alias("text"))
    marked = work.store(signed(texts, n, band_plan(threshold, recall, rows), rows), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    vertices = marked.where("size > 0").groupBy("high", "low").agg(
        first.alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    vertices = work.store(vertices.withColumnRenamed("high", "v"), "vertices")
    # buckets: every member learns the smallest member
    members = vertices.select("v", F.explode("bands").alias("band"))
    heads = members.groupBy("band").agg(F.min("v").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    meets = members.join(heads, "band").where("v <> head").select(F.col("v").alias("a"), F.col("head").alias("b")).distinct()
    family = components(meets, work, "families").withColumnRenamed("root", "family")
    placed = work.store(family.join(vertices.select("v", "copies", "size", "first"), "v"), "placed")
    sizes = placed.groupBy("family").agg(F.sum("size").alias("grams"), F.count("*").alias("texts")).withColumn(
        "blocks", F.greatest(F.ceil(F.col("grams") / BLOCK), F.ceil(F.col("texts") / 2048)).cast("int"))
    total = sizes.agg(F.sum("grams")).first()[0] or 0
    tasks = max(1, -(-total // BLOCK), docs.sparkSession.sparkContext.defaultParallelism)
    # a small family shares a task with others; block i of a large one meets every block j >= i
    placed = placed.join(sizes.select("family", "blocks"), "family")
    alone = F.col("blocks") == 1
    block = F.pmod(F.xxhash64("v"), F.col("blocks"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(block, j).cast("int").alias("i"), F.greatest(block, j).cast("int").alias("j"),
        F.when(block == j, 2).when(block < j, 0).otherwise(1).alias("side")))
    sent = placed.select("v", "family", "copies", "first", F.explode(meet).alias("m"), 
        F.when(alone, F.pmod(F.xxhash64("family"), F.lit(tasks))).alias("shared"), F.when(~alone, F.col("family")).alias("large"))
    # whole texts are read and shuffled once more for the vertices that have a family: the list of them grows with the input, so
    # that every size takes the plan of the large ones; the texts are probed as they come, without a sort
    wanted = placed.select(F.col("first.doc_id").alias("f_id"), F.col("first.uid").alias("f_uid"), "v").hint("shuffle_hash")
    chosen = texts.join(wanted, F.expr("doc_id <=> f_id and uid = f_uid")).select("v", "text")
    sets = work.store(gram_sets(chosen.dropDuplicates(["v"]), n), "sets")
    tasked = sent.join(sets, "v").select(
        "shared", "large", "m.i", "m.j", "m.side", "family", "v", "copies", "grams")
    checked = work.store(tasked.groupBy("shared", "large", "i", "j").applyInArrow(lambda t: _verify(t, threshold), "v long, links long, a long"), "checked")
    work.drop("sets", "placed")
    counts = checked.groupBy("v").agg(F.sum("links").alias("links"))
    classes = components(checked.where("v <> a").select(F.col("v").alias("a"), F.col("a").alias("b")).distinct(), work, "classes")
    named = vertices.select("v", "low", "copies", "first").join(counts, "v", "left").join(classes, "v", "left").withColumn("root", F.coalesce("root", "v"))
    names = named.groupBy("root").agg(F.min("first").alias("name"))
    named = work.store(named.join(names, "root").select("v", "low", F.coalesce("links", F.lit(0)).alias("links"), "copies", "name"), "named")
    found = marked.select("doc_id", "uid", F.col("high").alias("v"), "low", "size").join(named, ["v", "low"], "left")
    blank = F.col("name").isNull()
    return found.select(
        "doc_id", "uid", F.when(blank, F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("class_id"),
        F.when(blank, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (blank | (F.col("name.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("name.uid") == F.col("uid")))).alias("first"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, all columns as they are, whatever their names; blank texts stay."""
    found = near_copies(docs, key=key, text=text, **options).where("first").select(
        F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid")).distinct()
    blank = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("uid"), blank.alias("blank"))
    # rows that repeat id and text are copies of each other, unless they are blank
    kept = rows.join(found.hint("shuffle_hash"), F.expr("id <=> keep_id and uid = keep_uid")).withColumn(
        "each", F.when(F.col("blank"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["keep_id", "keep_uid", "each"]).select("row.*")
