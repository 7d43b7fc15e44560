"""Repeated spans of words, found and compacted as a de Bruijn graph.

Every window of ``window`` consecutive words is an edge of the graph. Windows that follow each other and share their minimizer (the
run of MINIMIZER words with the smallest hash in them) are kept together as one path from the start, so that the shuffles carry
paths and not words. The steps:

1. Minimizers that occur once cannot belong to a repeated window: their paths are left out.
2. A minimizer whose paths all have one content is a nonbranching node. Its first place in the order of documents is its source.
3. Nodes that follow each other at their sources and occur equally often are joined edge by edge into longer paths; a document's
   pieces of one path become one span when their coordinates, compared with the source's, leave no gap.
4. A minimizer with several contents is a branching node: its paths are taken apart into single windows and each window has its own source.
   Spans and windows that follow each other, in the document and at one source, are one span in the end.

5. The source verifies: each different span found is read there once more, and a document loses a span only if its own words have the same
   cryptographic digest as the words at the coordinates of the source.

Nothing is capped: hot contents are aggregated before the shuffle, joins have one row per content on the other side, and sources that many
spans ask for are read in as many tasks as the requests need.

On the way a window is known by its minimizer's hash and its own, of 64 bits each. Two different windows
that agree in both are told apart by step 5; a later copy of the second of them then stays as well. With D different windows that share one minimizer this
is to be expected for D^2 / 2^65 of them (3e-5 for 36 million).

Defined cases: words are the runs of bytes other than ASCII white space; a null text has none; documents are ordered by id, null ids last;
rows that repeat an id are one document for the order (a window at the same place of such a row is the same occurrence, one at
an earlier place an earlier one); an empty table gives no rows; other columns take no part and are carried in a struct, so that they may have any
names. Texts are walked whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace, byte_slices, forget, hashes_of_texts, runs_of, text_bytes

#: Words of a minimizer; bytes of a window's hash, all of which are kept.
MINIMIZER, WIDTH = 8, 8
#: Spans that one task reads in one source; bytes of texts worked on at once, and of texts whose words are hashed together.
ASKED, SLICE, TOGETHER = 10_000, 1 << 21, 1 << 19
PATHS = "anchor long, doc_id long, uid long, start int, n int, windows binary"


def paths_of(words: np.ndarray, counts: np.ndarray, window: int, minimizer: int) -> tuple[np.ndarray, ...]:
    """(minimizer hashes, texts, first windows, numbers of windows, hashes of all windows) of the paths of several texts with ``counts`` words each."""
    small, wide = runs_of(words, minimizer, window)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(text[: len(wide)] == text[window - 1 :]) if len(wide) else np.empty(0, np.int64)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    lowest, width, n = small, 1, window - minimizer + 1
    while 2 * width <= n:
        lowest, width = np.minimum(lowest[:-width], lowest[width:]), 2 * width
    if width < n:
        lowest = np.minimum(lowest[: width - n], lowest[n - width :])
    # the place of the minimizer changes where another value is the smallest, and behind the first word that has it
    opens = np.ones(len(lowest), bool)
    opens[1:] = (lowest[1:] != lowest[:-1]) | (small[: len(lowest) - 1] == lowest[:-1])
    opens = opens[at]
    opens[0] = True
    opens[1:] |= np.diff(at) != 1
    first = np.flatnonzero(opens)
    heads = at[first]
    return lowest[heads].view(np.int64), text[heads], heads - (ends - counts)[text[heads]], np.diff(first, append=len(at)), wide[at]


def paths(docs: DataFrame, window: int, minimizer: int) -> DataFrame:
    """All paths of (doc_id, uid, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, 2, TOGETHER):
            anchors, of, starts, counts, wide = paths_of(*hashes_of_texts(list(text_bytes(batch.column(2)))), window, minimizer)
            ends = np.concatenate([[0], np.cumsum(counts)]) * WIDTH
            windows = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(wide.view(np.uint8))])
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32)), windows],
                ["anchor", "doc_id", "uid", "start", "n", "windows"])

    return docs.mapInArrow(run, PATHS)


def _place() -> F.Column:
    """A word's coordinate, ordered as documents are; of several texts with it the one with the smallest hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "uid")


def _is_source() -> F.Column:
    return F.col("src.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("src.start") == F.col("start"))


def repeated_spans(docs: DataFrame, window: int, work: Workspace, minimizer: int = MINIMIZER) -> DataFrame:
    """(doc_id, uid, start, n, src_doc, src_uid, src_start): windows start .. start + n - 1 of the document (0 = first word) also begin
    earlier, at src_start of src_doc (the text with the hash src_uid) on. ``docs`` has doc_id, uid (a hash of the text) and text, and must give the same rows each time it is read."""
    minimizer = min(minimizer, window)
    all_paths = paths(docs, window, minimizer)
    often = work.store(all_paths.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    kept = work.store(all_paths.join(often, "anchor"), "paths")
    content = F.xxhash64("windows")
    nodes = kept.groupBy("anchor").agg(
        F.min(content).alias("low"), F.max(content).alias("high"), F.count("*").alias("times"), F.max("n").alias("size"), F.min(_place()).alias("src"))
    nodes = work.store(nodes.select("anchor", (F.col("low") != F.col("high")).alias("branches"), "times", "size", "src"), "nodes")
    # paths of nodes: one join per edge of the compacted graph, then the start of each path in its source
    plain = nodes.where("not branches and times > 1").select(
        "anchor", "times", F.col("src.doc_id").alias("src_doc"), F.col("src.uid").alias("src_uid"), F.col("src.start").alias("src_start"), (F.col("src.start") + F.col("size")).alias("src_end"))
    before = plain.select(F.col("src_doc").alias("b_doc"), F.col("src_uid").alias("b_uid"), F.col("src_end").alias("b_end"), F.col("times").alias("b_times"))
    linked = plain.join(before, F.expr("src_doc <=> b_doc and src_uid = b_uid and src_start = b_end and times = b_times"), "left")
    in_order = Window.partitionBy("src_doc", "src_uid").orderBy("src_start")
    chained = linked.groupBy("anchor", "src_doc", "src_uid", "src_start").agg(F.max(F.col("b_end").isNull()).alias("opens")).withColumn(
        "path", F.last(F.when(F.col("opens"), F.col("src_start")), ignorenulls=True).over(in_order))
    # stored, so that the next join reads both sides from plain exchanges, of which adaptive execution can split hot keys
    marks = work.store(nodes.select("anchor", "branches", "src").join(chained.select("anchor", "path"), "anchor", "left"), "marks")
    seen = work.store(kept.join(marks, "anchor").where(F.col("branches") | ~_is_source()).select(
        "anchor", "doc_id", "uid", "start", "n", "branches", F.col("src.doc_id").alias("src_doc"), F.col("src.uid").alias("src_uid"),
        F.col("src.start").alias("src_start"), "path",
        F.when(F.col("branches"), F.col("windows")).alias("windows")), "seen")
    work.drop("paths")
    # pieces of one path in one document; one span if their coordinates leave no gap
    piece = F.struct("start", "n", "src_start")
    spans = seen.where("not branches").groupBy("doc_id", "uid", "src_doc", "src_uid", "path", (F.col("start") - F.col("src_start")).alias("shift")).agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.collect_set(piece).alias("pieces"))
    spans = spans.withColumn("n", F.aggregate("pieces", F.lit(0).cast("int"), lambda a, p: a + p["n"]))
    whole = F.array(F.struct("start", (F.col("end") - F.col("start")).alias("n"), (F.col("start") - F.col("shift")).alias("src_start")))
    spans = spans.select("doc_id", "uid", "src_doc", "src_uid", F.explode(F.when(F.col("n") == F.col("end") - F.col("start"), whole).otherwise(F.col("pieces"))).alias("p"))
    spans = spans.select("doc_id", "uid", F.col("p.start"), F.col("p.n"), "src_doc", "src_uid", F.col("p.src_start"))
    # branching nodes, window by window
    single = seen.where("branches").select("anchor", "doc_id", "uid", "start", "windows", F.explode(F.expr("sequence(0, n - 1)")).alias("i")).select(
        "anchor", F.expr(f"substr(windows, {WIDTH} * i + 1, {WIDTH})").alias("w"), "doc_id", "uid", (F.col("start") + F.col("i")).alias("start"))
    sources = single.groupBy("anchor", "w").agg(F.min(_place()).alias("src"), F.count("*").alias("times")).where("times > 1").select("anchor", "w", "src")
    sources = work.store(sources, "sources")
    later = single.join(sources, ["anchor", "w"]).where(~_is_source()).select(
        "doc_id", "uid", "start", F.lit(1).alias("n"), F.col("src.doc_id").alias("src_doc"), F.col("src.uid").alias("src_uid"), F.col("src.start").alias("src_start"))
    return glued(spans.unionByName(later))


def glued(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or follow each other, and whose places at the source do as well, as one span."""
    line = ["doc_id", "uid", "src_doc", "src_uid", "shift"]
    along = Window.partitionBy(*line).orderBy("start")
    ends = F.max(F.col("start") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("shift", F.col("start") - F.col("src_start")).withColumn("opens", (F.coalesce(ends, F.lit(-1)) < F.col("start")).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*line, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return whole.select("doc_id", "uid", "start", (F.col("end") - F.col("start")).alias("n"), "src_doc", "src_uid", (F.col("start") - F.col("shift")).alias("src_start"))


def span_digest(words: list[bytes], start: int, n: int, window: int) -> bytes:
    """128 bits of the words of ``n`` windows."""
    return hashlib.blake2b(b" ".join(words[start : start + n + window - 1]), digest_size=16).digest()


def verified(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """``spans`` and ``digest``, that of the words at the source. ``docs`` has doc_id, uid and text.

    Each different span of a source is read once. A source with many of them is sent to several tasks, ``ASKED`` spans to each.
    """
    place = ["src_doc", "src_uid", "src_start", "n"]
    wanted = spans.select(*place).distinct()
    sizes = wanted.groupBy("src_doc", "src_uid").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    named = sizes.select(F.col("src_doc").alias("d"), F.col("src_uid").alias("u"), "parts")
    same = F.expr("src_doc <=> d and src_uid = u")
    asked = wanted.join(named, same).withColumn("part", F.pmod(F.xxhash64("src_start", "n"), F.col("parts"))).groupBy("src_doc", "src_uid", "part").agg(
        F.collect_list(F.struct("src_start", "n")).alias("asked"))
    # texts are probed as they come; rows that are equal would answer alike
    found = docs.join(asked.select(F.col("src_doc").alias("d"), F.col("src_uid").alias("u"), "part", "asked").hint("shuffle_hash"), F.expr("doc_id <=> d and uid = u"))
    read = found.dropDuplicates(["d", "u", "part"]).select("d", "u", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, 2, SLICE):
            rows = []
            for doc, uid, raw, spans_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = raw.tobytes().split()
                rows += [(doc, uid, s["src_start"], s["n"], span_digest(words, s["src_start"], s["n"], window)) for s in spans_]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "u", "s", "c", "digest"])

    answers = read.mapInArrow(run, "d long, u long, s int, c int, digest binary")
    return spans.join(answers, F.expr("src_doc <=> d and src_uid = u and src_start = s and n = c")).select(*spans.columns, "digest")


def with_kept(docs: DataFrame, window: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_words, n_removed, kept) of each row: ``row`` a struct of all columns of ``docs``, ``kept`` the words that stay, joined by one space.

    Removed is every word covered by a window that also starts earlier; windows are judged on the input."""
    work = Workspace(docs.sparkSession, "substring")
    keyed = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("uid"), F.col(text).cast("string").alias("text"))
    rows = keyed.select("doc_id", "uid", "text")
    spans = work.store(repeated_spans(rows, window, work), "spans")
    work.drop("often", "nodes", "seen", "marks", "sources")
    # a document that repeats a span (words in turn, again and again) asks once for it; its starts are no more than its words
    once = spans.groupBy("doc_id", "uid", "src_doc", "src_uid", "src_start", "n").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    marks = work.store(verified(rows, once, window), "verified").groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(
        F.array_sort(F.collect_list(F.struct("starts", "n", "digest"))).alias("spans"))
    joined = keyed.join(marks, F.expr("doc_id <=> d and uid = u"), "left").select("row", "text", "spans")
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in byte_slices(batches, 1, SLICE):
            total, gone, kept = [], [], []
            for raw, marked in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = raw.tobytes().split()  # bytes are split at ASCII white space only
                total.append(len(words))
                if marked:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for start, n, digest in ((start, span["n"], span["digest"]) for span in marked for start in span["starts"]):
                        if span_digest(words, start, n, window) == digest:
                            edges[start] += 1
                            edges[min(len(words), start + n + window - 1)] -= 1
                    stays = np.cumsum(edges[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"row {kind}, n_words long, n_removed long, kept string")
