"""Byte-pair vocabularies read from a tokenizer file, and their merging rule on plain symbols.

The file's path is a parameter; it is read once by a Python worker, which keeps it until tasks of another kind call ``forget``.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

from logtrends.llm.common import WordCache, kept_by_worker

#: White space beyond ASCII; ``_agrees`` checks it against the library like every other character.
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@kept_by_worker
def library(path: str):
    """The tokenizers library's own reading of the file, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache
def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


@lru_cache
def _characters(kind: str) -> str:
    """The characters below U+10000 of a general category, as ranges of a character class."""
    found = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind]
    first = [c for c, before in zip(found, [-2, *found], strict=False) if c != before + 1]
    last = [c for c, after in zip(found, [*found[1:], -2], strict=True) if after != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last, strict=True))


def plain_pattern(pattern: str) -> re.Pattern:
    """A word pattern with Unicode classes as one for Python's faster matcher, right for characters below U+10000."""
    classes = {r"\p{L}": _characters("L"), r"\p{N}": _characters("N"), r"\s": WHITE}
    made, inside = [], False
    for piece in re.findall(r"\\p\{.\}|\\.|.", pattern):
        inside = piece == "[" or inside and piece != "]"
        if piece == r"\S" and not inside:
            piece = f"[^{WHITE}]"
        elif piece in classes:
            piece = classes[piece] if inside else f"[{classes[piece]}]"
        made.append(piece)
    return re.compile("".join(made))


class Vocabulary:
    """Merges, first symbols, special strings and the word pattern of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.path = path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.suffix] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        of_letter = {c: b for b, c in enumerate(letters)}
        self.bytes: dict[int, bytes] = {
            i: bytes(of_letter[c] for c in t.removesuffix(self.suffix) if c in of_letter) for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pieces = spec["pre_tokenizer"].get("pretokenizers")
        if pieces:
            pattern = pieces[0]["pattern"]["Regex"]
        else:
            from public_tokenizers import PATTERN as pattern
        self._word = plain_pattern(pattern)
        self.lowers = bool(spec["normalizer"])
        self._good: set[str] = {chr(c) for c in range(128)}
        self._odd: set[str] = set()

    def _agrees(self, char: str) -> bool:
        """Whether this Python and the library class and lower this character alike (their Unicode versions differ)."""
        lib = library(self.path)
        probe = f"a{char}1{char}.{char}"
        text = lib.normalizer.normalize_str(probe) if self.lowers else probe
        mine = self._normal(probe) if self.lowers else probe
        cut = [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]
        return regex.sub(r"\s+", " ", mine) == text and self._word.findall(mine) == cut

    def _normal(self, text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii() and (new := set(text) - self._good):
            for char in new - self._odd:
                (self._good if char < "\U00010000" and self._agrees(char) else self._odd).add(char)
            if new & self._odd:
                lib = library(self.path)
                text = lib.normalizer.normalize_str(text) if self.lowers else text
                return [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]
        return self._word.findall(self._normal(text) if self.lowers else text)

    def sections(self, text: str) -> Iterator[list[str] | int]:
        """The words between special strings, and the id of each special string, in order."""
        at = 0
        if "<|" in text or not all("<|" in s for s in self.special):
            for match in self._special.finditer(text):
                yield self._plain_words(text[at : match.start()])
                yield self.special[match.group()]
                at = match.end()
        yield self._plain_words(text[at:] if at else text)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        return [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]] if raw else []

    def merge(self, ids: list[int], keep: bool = True) -> tuple[int, list[int]]:
        """Pop the lowest-ranked adjacent pair from a heap, the leftmost first, and relink its neighbours.

        Returns the number of merges and, with ``keep``, the ids left over.
        """
        merges, n = self.merges, len(ids)
        heap = [(*found, i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        if not heap:
            return 0, ids if keep else []
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        ids = [*ids, -1]
        after, before, done = list(range(1, n + 2)), list(range(-1, n)), 0
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (-1, -1)) != (rank, new):
                continue
            done += 1
            k = after[j]
            ids[i], ids[j], after[i], before[k] = new, -1, k, i
            if k < n and (found := merges.get((new, ids[k]))):
                heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return done, [x for x in ids if x >= 0] if keep else []


@kept_by_worker
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def byte_merger(vocab: Vocabulary) -> Callable[[bytes], list[int]]:
    """The bytes of a word, or of a fragment where words have no ends -> ids, merged by the compiled merger of tiktoken.

    It merges bytes by the rank of what they make. So each first symbol (a byte; with word ends, also a byte that ends a word) is written as a
    character of two bytes, which rank before all merges. What a pair makes decides as the pair itself would: every token has one merge.
    """
    import tiktoken

    ends = bool(vocab.suffix)
    signs = [chr(0x80 + i) for i in range(512)]
    of_symbol = {vocab.first[b]: signs[b] for b in range(256)}
    if ends:
        of_symbol |= {vocab.last[b]: signs[256 + b] for b in range(256)}
    spelled, ids = dict(of_symbol), list(of_symbol)
    for (left, right), (_, new) in sorted(vocab.merges.items(), key=lambda m: m[1][0]):
        spelled[new] = spelled[left] + spelled[right]
        ids.append(new)
    if len(set(ids)) != len(ids):
        raise ValueError("a token with two merges")
    ranks = {spelled[i].encode(): rank for rank, i in enumerate(ids)}
    ranks |= {bytes([b]): len(ids) + b for b in range(256)}
    merge = tiktoken.Encoding("merger", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of_bytes(raw: bytes) -> list[int]:
        if not raw:
            return []
        last = signs[256 + raw[-1]] if ends else signs[raw[-1]]
        return [ids[rank] for rank in merge("".join([signs[b] for b in raw[:-1]]) + last)]

    return of_bytes


def word_merger(vocab: Vocabulary) -> Callable[[str], list[int]]:
    """Word -> ids."""
    merge = byte_merger(vocab)
    return lambda word: merge(word.encode())


def text_coder(vocab: Vocabulary, of_word: Callable[[str], bytes], kind: str = "I") -> Callable[[str | None], bytes]:
    """Text -> what its words give and the ids of its special strings, as little-endian unsigned integers of 32 bits (kind I) or 16 (H)."""
    cache = WordCache(of_word)

    def encode(text: str | None) -> bytes:
        return b"".join([
            array(kind, [found]).tobytes() if isinstance(found, int) else b"".join(map(cache.__getitem__, found))
            for found in vocab.sections(text or "")])

    return encode


@kept_by_worker
def library_encoder(path: str, kind: str = "I") -> Callable[[str | None], bytes]:
    """Text -> its ids as the tokenizers library gives them, without added tokens, special strings as it does by default.

    The words are cut as the library cuts them; each is merged once while it stays in the cache.
    """
    vocab = vocabulary(path)
    merge = word_merger(vocab)
    return text_coder(vocab, lambda word: array(kind, merge(word)).tobytes(), kind)
