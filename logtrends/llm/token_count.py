"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

A word starts as one symbol per byte. The lowest-ranked adjacent pair is popped again and again; the count is the
number of first symbols less the number of merges. Words repeat, so each worker keeps the counts of a bounded number of them.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted one by one; an empty
table gives no rows; other columns of the input, whatever their names, take no part. Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.llm.bpe import vocabulary
from logtrends.llm.common import WordCache, byte_slices, kept_by_worker


@kept_by_worker
def text_counter(path: str):
    """A function from text to its number of tokens; one per worker, with the words it has seen."""
    vocab = vocabulary(path)

    def of_word(word: str) -> int:
        symbols = vocab.symbols(word)
        return len(symbols) - vocab.merge(symbols, keep=False)[0]

    cache = WordCache(of_word)

    def count(text: str | None) -> int:
        return sum(1 if isinstance(part, int) else sum(map(cache.__getitem__, part)) for part in vocab.sections(text or ""))

    return count


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of ``docs`` under the vocabulary file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(path)
        for batch in byte_slices(batches, 1, 1 << 24):
            texts = batch.column(1)
            found = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, found], [key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
