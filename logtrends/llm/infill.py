"""Fill-in-middle: a text is cut in prefix, middle and suffix at word ends, and the middle is moved behind the rest.

All work is done on the UTF-8 bytes. Cuts are ends of units (a word with the white space before it; white space at the end is a unit of its
own), which are byte offsets. A sparse exception index holds only the characters of several bytes: where they begin and how many bytes in excess
of one the text has up to and with each. A binary search in it turns a byte offset into a code point and back; a text without such characters needs plain arithmetic only.

Two numbers from a hash of seed and id choose the cuts, two more the form: ``plain`` (as it is), ``psm`` or ``spm``.

    psm:  <P> prefix <S> suffix <M> middle
    spm:  <S> suffix <P> prefix <M> middle

Defined cases: a null text counts as empty; an empty text, and one that holds a mark itself, stays plain; a null id is hashed as an empty one; rows
that repeat an id are cut alike if their texts are equal; an empty table gives no rows; other columns take no part. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.llm.common import byte_slices, is_space, text_bytes

# The marks and the order of the parts of each form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SLICE = 1 << 24


class Exceptions:
    """The characters of several bytes of a UTF-8 text: their places, in bytes and in code points, and the excess bytes with each."""

    def __init__(self, raw: np.ndarray):
        self.at_byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at_byte]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.cumsum(extra)
        self.at_char = self.at_byte - (self.excess - extra)

    def chars(self, cut: int) -> int:
        """Code points before a byte offset that is a border between characters."""
        found = int(np.searchsorted(self.at_byte, cut)) if len(self.at_byte) else 0
        return cut - int(self.excess[found - 1]) if found else cut

    def byte(self, chars: int) -> int:
        """The byte offset behind so many code points."""
        found = int(np.searchsorted(self.at_char, chars)) if len(self.at_char) else 0
        return chars + int(self.excess[found - 1]) if found else chars


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets behind each unit."""
    space = is_space(raw)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw)) if len(raw) else ends


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits from a hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut_text(raw: np.ndarray, seed: int, key: object, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    whole, ends = raw.tobytes(), unit_ends(raw)
    n = len(ends)
    one, two, kind, order = draws(seed, key)
    if not whole or kind % 100 >= rate or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, whole
    low, high = (int(ends[u - 1]) if u else 0 for u in sorted((one % (n + 1), two % (n + 1))))
    index = Exceptions(raw)
    form = "spm" if order % 100 < spm else "psm"
    parts = {PREFIX: whole[:low], MIDDLE: whole[low:high], SUFFIX: whole[high:]}
    before = index.chars(low)
    return n, form, before, index.chars(high) - before, b"".join([x for mark in ORDERS[form] for x in (mark, parts[mark])])


def rebuilt(form: str, output: bytes) -> bytes:
    """The text that ``output`` was made of. No mark can begin within another one, so each is found where it was put."""
    if form == "plain":
        return output
    first, second, third = ORDERS[form]
    parts, rest = {}, output[len(first) :]
    parts[first], _, rest = rest.partition(second)
    parts[second], _, parts[third] = rest.partition(third)
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row: ``rate`` of 100 texts are cut, ``spm`` of 100 of these in that form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, SLICE):
            made = [cut_text(raw, seed, k, rate, spm) for k, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            n, form, before, middle, output = (pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, form, before, middle, output.cast(pa.string())], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``transform`` and ``restored``, the text rebuilt from output and form alone."""
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 5, SLICE):
            texts = [rebuilt(form, raw.tobytes()) for form, raw in zip(batch.column(2).to_pylist(), text_bytes(batch.column(5)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "restored"])

    rows = made.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, restored string")
