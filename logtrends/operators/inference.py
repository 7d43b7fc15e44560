"""The greedy rule of template inference, on shapes that arrive in blocks.

The rule, on all shapes of a verb key in order: the first shape that is still there is the seed; the first later one with which it has a
common template is its partner; the template takes out every shape that it covers. A seed without partner is its own template.

Blocks give the same result as one list. A row is (position, shape, taken), ``taken`` being the position of the seed whose template took it out
(``NEVER`` while it is there): for an earlier seed the row is still there. A seed that finds no partner in its block waits for the next
ones. Its template will hold a word of its own, so it can touch only shapes that share a word with it: later seeds go on as long as
neither they nor their partners do; those that do wait as well.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np

from logtrends.functions.text import WILDCARD

NEVER = 2**62
#: Words of the first block inside a task; every further one is twice as long.
FIRST_BLOCK = 20_000
#: Lines that are compared without a look at the order of their words; share of the lines from which a word counts as common. Neither changes a result.
FEW, COMMON = 3, 32
NEVER_HERE = 2**30
Row = tuple[int, str, int]


# -- two shapes -----------------------------------------------------------------------------

def lcs_table(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all prefixes."""
    codes: dict[str, int] = {}
    a, b = _codes(left, codes), _codes(right, codes)
    return _lcs_rows(a, b, np.zeros(len(b) + 1, np.int32))


def _codes(words: list[str], codes: dict[str, int]) -> np.ndarray:
    return np.array([codes.setdefault(w, len(codes)) for w in words])


def _lcs_rows(a: np.ndarray, b: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The row ``above`` and the rows of the table that follow it, one for each word of ``a``."""
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    table[0] = above
    for i, word in enumerate(a, start=1):
        grown = np.where(b == word, table[i - 1, :-1] + 1, table[i - 1, 1:])
        table[i, 1:] = np.maximum.accumulate(grown)
    return table


def common_template(left: str, right: str) -> str | None:
    """The template covering both shapes, or None when only a wildcard would remain.

    Of the table of subsequence lengths only every n-th row is kept, n the square root of their number; the rows between are
    worked out again on the way back. Memory grows with the words of one shape times the root of those of the other.
    """
    a, b = left.split(" "), right.split(" ")
    codes: dict[str, int] = {}
    x, y = _codes(a, codes), _codes(b, codes)
    step = math.isqrt(len(a)) + 1
    kept = [np.zeros(len(b) + 1, np.int32)]
    for at in range(0, len(a), step):
        kept.append(_lcs_rows(x[at : at + step], y, kept[-1])[-1].copy())
    base, table = len(a) + 1, np.empty((0, 0), np.int32)
    i, j = len(a), len(b)
    reversed_words: list[str] = []

    def put(word: str) -> None:
        if word != WILDCARD or not reversed_words or reversed_words[-1] != WILDCARD:
            reversed_words.append(word)

    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            put(a[i - 1])
            i, j = i - 1, j - 1
        else:
            put(WILDCARD)
            if i and i <= base:
                base = (i - 1) // step * step
                table = _lcs_rows(x[base : base + step], y, kept[base // step])
            if j and (not i or table[i - base, j - 1] > table[i - 1 - base, j]):
                j -= 1
            else:
                i -= 1
    words = reversed_words[::-1]
    return None if words == [WILDCARD] else " ".join(words)


# -- templates and what they cover ----------------------------------------------------------

def literals(shape: str) -> frozenset[str]:
    return frozenset(shape.split(" ")) - {WILDCARD}


def template_matcher(template: str) -> re.Pattern:
    """Full match of a shape against a template; a wildcard stands for zero or more words."""
    pieces = re.split(r"(?:^| )<\*>(?= |$)", template)
    quoted = [re.escape(p.lstrip(" ")) for p in pieces]
    if len(quoted) == 1:
        return re.compile(quoted[0])
    head = quoted[0] and quoted[0] + r"(?= |\Z)"
    inner = "".join(rf"(?>.*?(?:^| ){p}(?= |\Z))" for p in quoted[1:-1])
    tail = rf".*(?:^| ){quoted[-1]}" if quoted[-1] else ".*"
    return re.compile(head + inner + tail, re.DOTALL)


class Template:
    """A template as its runs of literal words, to test shapes without compiling an expression."""

    def __init__(self, seed: int, text: str):
        self.seed, self.needed = seed, literals(text)
        runs = f" {text} ".split(f" {WILDCARD} ")
        # between two wildcards in a row, and at open ends, there is nothing
        self.whole = f" {text} " if len(runs) == 1 else ""
        self.head = f"{runs[0]} " if runs[0] else ""
        self.tail = f" {runs[-1]}" if len(runs) > 1 and runs[-1] else ""
        self.inner = [f" {r.strip(' ')} " for r in runs[1:-1] if r.strip(" ")]

    def covers(self, shape: str) -> bool:
        """Whether the runs stand in the shape in this order; neighbours may share the space between them."""
        text = f" {shape} "
        if self.whole:
            return text == self.whole
        low, high = 0, len(text)
        if self.head:
            if not text.startswith(self.head):
                return False
            low = len(self.head) - 1
        if self.tail:
            high = len(text) - len(self.tail)
            if high < low or not text.endswith(self.tail):
                return False
            high += 1
        for run in self.inner:
            at = text.find(run, low, high)
            if at < 0:
                return False
            low = at + len(run) - 1
        return True


class Cover:
    """Templates by their rarest word."""

    def __init__(self, templates: Iterable[Template], count: Counter):
        self.by_word: dict[str, list[Template]] = {}
        for template in sorted(templates, key=lambda t: t.seed):
            self.by_word.setdefault(min(template.needed, key=lambda w: (count[w], w)), []).append(template)

    def taken(self, at: int, shape: str, words: frozenset[str], before: int) -> int:
        """The earliest seed whose template takes out the shape, ``before`` if none is earlier than that."""
        for word in words & self.by_word.keys():
            for template in self.by_word[word]:
                if template.seed >= before:
                    break
                if template.seed < at and template.needed <= words and template.covers(shape):
                    before = template.seed
                    break
        return before


class Lines:
    """Different lines, to be asked for those that a template matches. A set of lines is a whole number with one bit for each.

    A template is first told from its words: the lines with all of them, then those with the right word at a closed end and with each word before the one
    that follows it in the template. Only the few that are left are compared, so that a line does not meet every template that shares a word with it.
    """

    def __init__(self, texts: list[str]):
        self.texts, self.codes = texts, {}
        codes: dict[str, int] = self.codes
        words, lengths = array("i"), np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.split(" ")
            words.extend([codes.setdefault(w, len(codes)) for w in own])
            lengths[i] = len(own)
        code, ends = np.frombuffer(words, np.int32), np.cumsum(lengths)
        self._ends = {"first": code[ends - lengths], "last": code[ends - 1]} if texts else {}
        order = np.argsort(code, kind="stable")
        self._line = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[order]
        self._place = (np.arange(len(code)) - np.repeat(ends - lengths, lengths)).astype(np.int32)[order]
        self._from = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(codes)))]).tolist()
        self._sets: dict[tuple, int] = {}
        self._places: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _count(self, word: str) -> int:
        code = self.codes[word]
        return self._from[code + 1] - self._from[code]

    def _set(self, members: np.ndarray) -> int:
        if len(members) < 20:
            found = 0
            for i in members.tolist():
                found |= 1 << i
            return found
        marks = np.zeros(len(self.texts), bool)
        marks[members] = True
        return _number(marks)

    def _own(self, word: str) -> slice:
        code = self.codes[word]
        return slice(self._from[code], self._from[code + 1])

    def _with(self, word: str) -> int:
        if (found := self._sets.get((word,))) is None:
            found = self._sets[word,] = self._set(self._line[self._own(word)])
        return found

    def _at_end(self, end: str, word: str) -> int:
        if (found := self._sets.get((end, word))) is None:
            found = self._sets[end, word] = self._set(np.flatnonzero(self._ends[end] == self.codes[word]))
        return found

    def _around(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last place of a word in each line."""
        if (found := self._places.get(word)) is None:
            line, place = self._line[self._own(word)], self._place[self._own(word)]
            found = self._places[word] = np.full(len(self.texts), NEVER_HERE, np.int32), np.full(len(self.texts), -1, np.int32)
            found[0][line[::-1]], found[1][line] = place[::-1], place
        return found

    def _before(self, left: str, right: str) -> int:
        """Lines in which ``left`` stands somewhere before ``right``."""
        if (found := self._sets.get(("before", left, right))) is None:
            found = self._sets["before", left, right] = _number(self._around(left)[0] < self._around(right)[1])
        return found

    def matching(self, template: str, among: int) -> list[int]:
        """The numbers of the lines of the set ``among`` that the template matches."""
        words = template.split(" ")
        needed = set(words)
        needed.discard(WILDCARD)
        if not among or not needed <= self.codes.keys():
            return []
        for word in sorted(needed, key=self._count):
            among &= self._with(word)
            if not among:
                return []
        for end, word in (("first", words[0]), ("last", words[-1])):
            if word != WILDCARD:
                among &= self._at_end(end, word)
        if among.bit_count() > FEW:
            common = len(self.texts) // COMMON
            plain = [w for w in words if w != WILDCARD]
            for left, right in set(pairwise(plain)):
                if self._count(left) > common and self._count(right) > common:
                    among &= self._before(left, right)
                    if not among:
                        return []
        covers = Template(0, template).covers
        return [i for i in _members(among) if covers(self.texts[i])]


def _number(marks: np.ndarray) -> int:
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def _members(found: int) -> list[int]:
    if found.bit_count() > FEW:
        raw = np.frombuffer(found.to_bytes(-(-found.bit_length() // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()
    out = []
    while found:
        lowest = found & -found
        out.append(lowest.bit_length() - 1)
        found ^= lowest
    return out


def match_all(texts: list[str], templates: Iterable[tuple[tuple, str]], equal: list[tuple | None] | None = None) -> Iterator[tuple[int, tuple]]:
    """(number of the line, rank of the template) for all different lines and the templates, (rank, text) in the order of their ranks.

    With ``equal``, only the first template of each line, and none unless it stands before the rank that ``equal`` has for the line.
    """
    lines, left = Lines(texts), (1 << len(texts)) - 1
    known = sorted((rank, i) for i, rank in enumerate(equal or []) if rank is not None)
    known.reverse()
    for rank, template in templates:
        while known and known[-1][0] <= rank:
            left &= ~(1 << known.pop()[1])
        if not left:
            break
        found = _members(left) if template == WILDCARD else lines.matching(template, left)
        for i in found:
            yield i, rank
        if equal is not None and found:
            left &= ~lines._set(np.array(found))


class Waiting:
    """The words of seeds that wait, each with the earliest of them."""

    def __init__(self, rows: Iterable[Row]):
        self.first: dict[str, int] = {}
        for at, shape, taken in rows:
            if taken == NEVER:
                for word in literals(shape):
                    self.first[word] = min(at, self.first.get(word, NEVER))

    def need(self, words: frozenset[str], taken: int) -> bool:
        """Whether a row with these words, taken out at ``taken``, may still be a partner of one of them."""
        return any(self.first[w] < taken for w in words & self.first.keys())


def left_of(rows: list[Row], found: Iterable[tuple[int, str]], waiting: Iterable[Row]) -> list[Row]:
    """``rows`` behind the seeds of ``found`` (seed, template) and ``waiting``, without what no seed will look at any more."""
    words = [literals(shape) for _, shape, _ in rows]
    count: Counter = Counter()  # only to choose a rare word of each template: a share of the rows will do
    for own in words[::8]:
        count.update(own)
    cover, held = Cover([Template(*f) for f in found], count), Waiting(waiting)
    kept = []
    for (at, shape, taken), own in zip(rows, words, strict=True):
        taken = cover.taken(at, shape, own, taken)
        if taken == NEVER or held.need(own, taken):
            kept.append((at, shape, taken))
    return kept


# -- the rule -------------------------------------------------------------------------------

class Block:
    """Rows by position, found by their literal words."""

    def __init__(self, rows: list[Row]):
        self.text = {at: shape for at, shape, _ in rows}
        self.taken = {at: taken for at, _, taken in rows}
        self.words = {at: literals(shape) for at, shape, _ in rows}
        self._listed: dict[str, list[int]] = {}
        self._first: dict[str, int] = {}
        for at, words in self.words.items():
            for word in words:
                self._listed.setdefault(word, []).append(at)

    def partners(self, seed: int) -> Iterator[int]:
        """Rows behind ``seed`` that are there for it and share a literal word, in order. Seeds must be asked for in order."""
        last = seed
        for at in heapq.merge(*(self._from(word, seed) for word in self.words[seed])):
            if at > last and self.taken[at] > seed:
                last = at
                yield at

    def _from(self, word: str, seed: int) -> Iterator[int]:
        listed, i = self._listed[word], self._first.get(word, 0)
        while i < len(listed) and (listed[i] <= seed or self.taken[listed[i]] <= seed):
            i += 1
        self._first[word] = i
        return (listed[k] for k in range(i, len(listed)))

    def take_out(self, template: Template) -> None:
        """Mark what the template covers behind its seed."""
        seed, none = template.seed, []
        rarest = min(template.needed, key=lambda w: (len(self._listed.get(w, none)), w))
        there = [at for at in self._listed.get(rarest, none) if at > seed and self.taken[at] > seed]
        for at in there:
            if template.needed <= self.words[at] and template.covers(self.text[at]):
                self.taken[at] = seed
        self._listed[rarest], self._first[rarest] = [at for at in there if self.taken[at] > seed], 0


def decide(rows: list[Row], last: bool) -> tuple[list[tuple[int, str, bool]], list[Row]]:
    """What can be decided within the rows (in order): (seed, template, whether two shapes made it), and the rows that are still needed.

    With ``last`` there are no further rows and everything is decided.
    """
    block = Block(rows)
    found: list[tuple[int, str, bool]] = []
    held: set[str] = set()
    waits: set[int] = set()
    for seed, shape, _ in rows:
        if block.taken[seed] < NEVER:
            continue
        merged, sure = None, held.isdisjoint(block.words[seed])
        if sure:
            for partner in block.partners(seed):
                sure = held.isdisjoint(block.words[partner])
                merged = common_template(shape, block.text[partner]) if sure else None
                if merged or not sure:
                    break
        if merged or sure and last:
            found.append((seed, merged or shape, bool(merged)))
            block.taken[seed] = seed
            if merged:
                block.take_out(Template(seed, merged))
        else:
            waits.add(seed)
            held |= block.words[seed]
    now = [(at, shape, block.taken[at]) for at, shape, _ in rows]
    waiting = Waiting(r for r in now if r[0] in waits)
    return found, [r for r in now if r[0] in waits or r[2] < NEVER and waiting.need(block.words[r[0]], r[2])]


def run_blocks(waiting: list[Row], rows: list[Row], last: bool, first_block: int = FIRST_BLOCK) -> tuple[list[tuple[int, str, bool]], list[Row]]:
    """``decide`` on blocks of growing size: the first templates take out most of the rows before these are looked at closely."""
    found: list[tuple[int, str, bool]] = []
    hand, rest, size = sorted(waiting), sorted(rows), first_block
    while True:
        ends = np.cumsum([shape.count(" ") + 1 for _, shape, _ in rest])
        n = bisect_right(ends, size) + 1
        block, rest = rest[:n], rest[n:]
        new, hand = decide(sorted(hand + block), last and not rest)
        found += new
        if not rest:
            return found, hand
        rest, size = left_of(rest, [f[:2] for f in new if f[2]], hand), 2 * size
        if not rest:
            return (found + (ended := decide(hand, True))[0], ended[1]) if last else (found, hand)
