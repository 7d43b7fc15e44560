"""Token files: ids ranked by frequency, in byte-aligned codes of one to four bytes with the control bytes apart.

The most frequent id gets rank 0. Four ranks share one control byte (two bits each: bytes less one); the bytes of the ranks
follow without gaps. Frequent ids so take one byte. Decoding looks each control byte up in a table of four lengths.

A file holds the documents of one range of keys in ascending order, in blocks of whole documents:

    documents n, values v | n keys (int64), n null marks, n lengths (uint32) | (v + 3) // 4 control bytes | data bytes

The index (a table) names file, offset and size of each block. Files carry a name of their own per attempt; only those that
the committed index names are ever read, so a lost task leaves nothing behind that counts.

Defined cases: a null text is a document of its end id alone; null keys come last; documents that share a key stand side
by side, ordered by a hash of their ids; an empty table gives no files and no rows; other columns take no part.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrends.llm.bpe import library, library_encoder
from logtrends.llm.common import Workspace, byte_slices, file_system, read_tasks

_HEAD, _HEAD_BYTES = "<QQ", 16
#: Bytes of texts that are coded at once.
SLICE = 1 << 24
#: Byte lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values; all of a block at once."""
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    values = np.zeros(n, np.uint32)
    for k in range(4):
        has = lengths > k
        values[has] |= data[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def id_kind(path: str, end_id: int) -> str:
    return "<u2" if max(library(path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) with the end id appended; ids as little-endian unsigned integers of the narrowest kind that holds the vocabulary."""
    kind = "H" if id_kind(path, end_id) == "<u2" else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_encoder(path, kind), array(kind, [end_id]).tobytes()
        for batch in byte_slices(batches, 1, SLICE):
            ids = [encode(t) + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{key}` long, ids binary")


def id_counts(coded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(coded: DataFrame, folder: str, work: Workspace, kind: str, key: str = "doc_id", block_values: int = 1 << 16) -> tuple[DataFrame, np.ndarray]:
    """Write (key, ids) rows, ids of the given kind, to files below ``folder``; (index, id of each rank).

    The rank table has at most one row per vocabulary entry, so it is collected and sent to the tasks. Blocks close at
    ``block_values`` ids; a longer document is one block.
    """
    by_rank = np.array([r["id"] for r in id_counts(coded, kind).orderBy(F.desc("n"), "id").select("id").collect()], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = coded.sparkSession.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, index = f"part-{part:06d}-{uuid.uuid4().hex}.vb", []
        fs, root = file_system(folder)
        keys: list = []
        held: list[np.ndarray] = []
        out, at, size = None, 0, 0

        def close_block() -> None:
            nonlocal out, at, size
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            values = ranks.value[np.concatenate(held)]
            control, data = encode_values(values)
            block = b"".join([
                struct.pack(_HEAD, len(keys), len(values)), np.array([k or 0 for k in keys], "<i8").tobytes(),
                np.array([k is None for k in keys], np.uint8).tobytes(), np.array([len(h) for h in held], "<u4").tobytes(), control, data])
            out.write(block)
            index.append((part, len(index), name, at, len(block), len(values)))
            at += len(block)
            keys.clear()
            held.clear()
            size = 0

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                held.append(np.frombuffer(ids.as_py(), kind))
                size += len(held[-1])
                if size >= block_values:
                    close_block()
        if keys:
            close_block()
        if out is not None:
            out.close()
        columns = list(zip(*index, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(columns)],
            ["part", "block", "file", "at", "size", "values"])

    order = [F.col(key).asc_nulls_last(), F.xxhash64("ids")]
    ordered = coded.select(key, "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    return work.store(ordered.mapInArrow(run, "part long, block long, file string, at long, size long, values long"), "index"), by_rank


def read_files(index: DataFrame, folder: str, by_rank: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of each document, from the blocks that the index names.

    ``start`` counts the ids of all documents before: sums within a file, then one offset per file.
    """
    before = F.sum("values").over(Window.partitionBy("part").orderBy("block")) - F.col("values")
    files = index.groupBy("part").agg(F.sum("values").alias("values"))
    files = files.select("part", (F.sum("values").over(Window.orderBy("part")) - F.col("values")).alias("first"))
    blocks = index.withColumn("before", before).join(files, "part").select(
        "file", "at", "size", (F.col("first") + F.col("before")).alias("first"))
    # the index is tiny beside the files: the number of tasks follows the bytes to read
    blocks = blocks.repartition(read_tasks(index), "file", "at")
    table = blocks.sparkSession.sparkContext.broadcast(by_rank.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    source.seek(row["at"])
                    raw = np.frombuffer(source.read(row["size"]), np.uint8)
                n, v = struct.unpack(_HEAD, raw[:_HEAD_BYTES].tobytes())
                ends = np.cumsum([_HEAD_BYTES, 8 * n, n, 4 * n, -(-v // 4)])
                keys, nulls, lengths = raw[ends[0] : ends[1]].view("<i8"), raw[ends[1] : ends[2]].astype(bool), raw[ends[2] : ends[3]].copy().view("<u4")
                ids = table.value[decode_values(raw[ends[3] : ends[4]], raw[ends[4] :], v)].tobytes()
                stops = np.cumsum(lengths, dtype=np.int64)
                starts = stops - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls), pa.array(starts + row["first"], pa.int64()), pa.array(lengths.astype(np.int64)),
                     pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())],
                    [key, "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, write the files into the shared folder, and read them back."""
    work = Workspace(docs.sparkSession, "token-files")
    folder = f"{work.root}/files"
    coded = work.store(encode_documents(docs, path, end_id, key, text), "coded")
    index, by_rank = write_files(coded, folder, work, id_kind(path, end_id), key)
    work.drop("coded")
    return read_files(index, folder, by_rank, key)
