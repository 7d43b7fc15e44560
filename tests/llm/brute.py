"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_counts(docs, path, limit):
    lib = library(path)
    for doc_id, text in docs:
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        yield doc_id, len((text or "").encode()), n, n > limit


def codes(docs, path):
    lib = library(path)
    for doc_id, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        yield doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def token_files(docs, path, end_id):
    lib, at = library(path), 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, end_id]
        yield doc_id, at, len(ids), zlib.crc32(packed(ids))
        at += len(ids)


def records(pages):
    first = {}
    for page_id, html in pages:
        digest = base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
        if page_id is not None:
            first[digest] = min(first.get(digest, page_id), page_id)
    for page_id, html in pages:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = digest in first and first[digest] != page_id
        yield page_id, len(raw), digest, "revisit" if again else "response", first[digest] if again else None


def fine_vectors(rows):
    return {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}


def top(vectors, score, k, every=50):
    for q in sorted(i for i in vectors if i % every == 0):
        found = sorted((-score(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1))


def ngrams(text, n=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_copies(docs, threshold=0.8):
    """(class id, links) by row."""
    sets = [ngrams(text) for _, text in docs]
    label, links = list(range(len(docs))), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = label[i], label[j]
                    if a != b:
                        label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {}
    for (doc_id, _), x in zip(docs, label, strict=True):
        ids.setdefault(x, []).append(doc_id)
    names = {x: min((i for i in found if i is not None), default=None) for x, found in ids.items()}
    return [(doc_id, names[x], n) for (doc_id, _), x, n in zip(docs, label, links, strict=True)]


def repeated(docs, window=20):
    """(id, words, removed, kept text) by row; rows that share an id are one document for the order."""
    first, rows = {}, [(doc_id, WORD.findall(text or "")) for doc_id, text in docs]
    order = lambda doc_id, at: (doc_id is None, doc_id or 0, at)
    for doc_id, words in rows:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, order(doc_id, at)), order(doc_id, at))
    for doc_id, words in rows:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < order(doc_id, at):
                gone.update(range(at, at + window))
        yield doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)
