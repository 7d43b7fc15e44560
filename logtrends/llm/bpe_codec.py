"""Byte-pair encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never be merged over. Such a pair is a
certain cut: the fragments between cuts are encoded each by itself and joined, with the same ids as encoding the whole.

Defined cases: a null text counts as empty (no ids, empty text); repeated rows are coded one by one; an empty table
gives no rows; other columns take no part. Texts are coded whole; ids are little-endian unsigned 32-bit integers in a binary.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.llm.bpe import Vocabulary, byte_merger, text_coder, vocabulary
from logtrends.llm.common import byte_slices, kept_by_worker


#: Bytes of texts, or of ids, that are worked on at once.
SLICE = 1 << 22
#: Fragments up to this length go to the compiled merger, whose time grows with the square of the length, longer ones to the heap; the ids are the same.
SHORT = 256


def joined_pairs(vocab: Vocabulary) -> set[bytes]:
    """The byte pairs that occur inside some token."""
    return {t[i : i + 2] for t in vocab.bytes.values() for i in range(len(t) - 1)}


def fragments(raw: bytes, joined: set[bytes]) -> list[bytes]:
    """``raw`` cut between every two bytes that no token joins."""
    cuts = [i for i in range(1, len(raw)) if raw[i - 1 : i + 1] not in joined]
    return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)] if cuts else [raw]


@kept_by_worker
def text_encoder(path: str):
    """A function from text to its packed ids."""
    vocab = vocabulary(path)
    if vocab.suffix:
        raise ValueError("a vocabulary with word ends changes the last symbol of a word; fragments need one without")
    joined = joined_pairs(vocab)

    merge = byte_merger(vocab)

    def of_fragment(raw: bytes) -> bytes:
        ids = merge(raw) if len(raw) <= SHORT else vocab.merge([vocab.first[b] for b in raw])[1]
        return array("I", ids).tobytes()

    def of_word(word: str) -> bytes:
        return b"".join(map(of_fragment, fragments(word.encode(), joined)))

    return text_coder(vocab, of_word)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = text_encoder(path)
        for batch in byte_slices(batches, 1, SLICE):
            ids = pa.array([to_ids(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    coded = docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids binary")
    return coded.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as bigint)"))


def decode(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, n_tokens, text): the text whose bytes the ids stand for, special strings included; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).bytes
        for batch in byte_slices(batches, 1, SLICE):
            texts = [
                b"".join(map(token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [key, "ids", "n_tokens", "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "ids", "n_tokens").mapInArrow(run, f"`{key}` {kind}, ids binary, n_tokens long, text string")
