"""Operators on texts against plain versions, on the smallest tables and on hand-made odd rows."""

import hashlib
import math
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logtrends.llm import bpe, bpe_codec, jaccard, packing, quality, substring, token_count, vbyte
from logtrends.llm.common import CACHE_WORDS, WordCache, Workspace, byte_slices, components, run_hashes, table, word_hashes
from logtrends.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
BYTE, WORDS = bpe.default_path("byte_bpe_50k.json"), bpe.default_path("word_bpe_49k.json")
DOC = "doc_id long, text string, start long, ids string, n int, family string"


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 8))) for _ in range(3000)]
    long = " ".join(words)
    passage = " ".join(draw.choices(words, k=60))
    near = words[:300]
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one two three"), (None, "no id here at all"), (None, None), (6, long), (6, long),
        (7, "x" * 50_000), (8, "It's <|endoftext|>here<|startoftext|>  now 　Σ İ ǅ é é 'Ᲊ \U00016ea0 12٣ ½ \U0001f600"),
        (9, "a " * 400), (10, passage + " tail one"), (11, "head two " + passage), (12, " ".join(near)), (13, " ".join(near[:150] + ["zz"] + near[151:])),
        (14, " ".join(near[:100] + ["yy"] + near[101:])), (15, " ".join(near).upper()), (16, "\x1cone two\x85three\x0bfour"), (-3, passage), (2**40, long + " end"),
    ]
    return texts + [(100 + i, " ".join(near[:i] + [f"v{i}"] + near[i + 1 :])) for i in range(0, 120, 4)]


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, 7, "x", 1, "y") for row in odd], DOC)


def documents(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def as_rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_counts(spark, odd, odd_docs, path):
    assert as_rows(token_count.count_tokens(odd_docs, path, 100)) == sorted(brute.token_counts(odd, path, 100), key=repr)
    assert as_rows(token_count.count_tokens(empty(odd_docs), path, 100)) == []


def test_counts_query(spark):
    assert as_rows(QUERIES["op5_heap_token_counts"](spark, SF)) == sorted(brute.token_counts(documents(spark), WORDS, 2048), key=repr)


def test_every_character_is_classed_as_the_library_does():
    lib = brute.library(WORDS)
    for path, lib in ((WORDS, lib), (BYTE, brute.library(BYTE))):
        encode = bpe.library_encoder(path)
        for low in range(0, 0x32000, 97):
            text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(low, low + 97) if not 0xD800 <= c < 0xE000)
            assert encode(text) == brute.packed(lib.encode(text, add_special_tokens=False).ids), hex(low)


def coded(docs):
    return bpe_codec.decode(bpe_codec.encode(docs, BYTE), BYTE).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2("text", 256).alias("b"))


def test_codec(spark, odd, odd_docs):
    assert as_rows(coded(odd_docs)) == sorted(brute.codes(odd, BYTE), key=repr)
    assert as_rows(coded(empty(odd_docs))) == []
    assert as_rows(QUERIES["op10_forced_boundary_bpe"](spark, SF)) == sorted(brute.codes(documents(spark), BYTE), key=repr)


def test_forced_boundaries_are_never_merged_over():
    vocab = bpe.vocabulary(BYTE)
    joined = bpe_codec.joined_pairs(vocab)
    assert any(len(bpe_codec.fragments(bytes([a, b]), joined)) == 2 for a in range(256) for b in range(256))
    assert b"".join(bpe_codec.fragments("straße中qz".encode(), joined)) == "straße中qz".encode()


def check_pieces(rows, docs, longest=1024):
    lib = brute.library(BYTE)
    want = sorted(([*lib.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs), key=repr)
    by_doc: dict = {}
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and 0 < r["length"] <= longest and r["offset"] == 0
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], bytes(r["ids"])))
    got = []
    for (_, total), pieces in by_doc.items():
        copies = sum(s == 0 for s, _, _ in pieces)
        ids = {s: x for s, _, x in pieces}
        whole = np.frombuffer(b"".join(ids[s] for s in sorted(ids)), "<u4").tolist()
        assert len(whole) == total
        got += [whole] * copies
    assert sorted(got, key=repr) == want
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    in_order = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in in_order] == sorted((r["length"] for r in rows), reverse=True)


def test_packing(spark, odd, odd_docs):
    check_pieces(packing.pack(odd_docs, BYTE).collect(), odd)
    check_pieces(packing.pack(odd_docs, BYTE, longest=64).collect(), odd, 64)
    assert as_rows(packing.pack(empty(odd_docs), BYTE)) == []
    check_pieces(packing.pack(table(spark, SF, "documents"), BYTE).collect(), documents(spark))
    lib = brute.library(BYTE)
    ids = {d: brute.packed([*lib.encode(t, add_special_tokens=False).ids, 0]) for d, t in documents(spark)}
    for r in QUERIES["op1_pack_pow2"](spark, SF).collect():
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_token_files(spark, odd, odd_docs):
    crc = F.crc32("ids").alias("crc")
    assert as_rows(vbyte.token_files(odd_docs, WORDS, 1).where("doc_id is not null").select("doc_id", "n_tokens", crc)) == sorted(
        ((d, n, c) for d, _, n, c in brute.token_files(odd, WORDS, 1) if d is not None), key=repr)
    found = sorted((r["start"], r["n_tokens"]) for r in vbyte.token_files(odd_docs, WORDS, 1).collect())
    assert [a for a, _ in found] == [0, *np.cumsum([n for _, n in found]).tolist()[:-1]]
    assert as_rows(vbyte.token_files(empty(odd_docs), WORDS, 1)) == []
    assert as_rows(QUERIES["op9_vbyte_files"](spark, SF)) == sorted(brute.token_files(documents(spark), WORDS, 1), key=repr)


def test_value_codes():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 3], np.uint32)
    for n in range(len(values) + 1):
        control, data = vbyte.encode_values(values[:n])
        assert vbyte.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == values[:n].tolist()
    assert len(vbyte.encode_values(values)[1]) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1


def links(docs):
    return as_rows(jaccard.near_copies(docs), "doc_id", "class_id", "n_links")


def test_near_copies(spark, odd, odd_docs):
    assert links(odd_docs) == sorted(brute.near_copies(odd), key=repr)
    assert links(empty(odd_docs)) == []


def test_near_copies_query(spark):
    assert as_rows(QUERIES["op7_ngram_jaccard"](spark, SF)) == sorted(brute.near_copies(documents(spark)), key=repr)


def test_large_families_are_checked_in_blocks(spark, odd, odd_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    assert links(odd_docs) == sorted(brute.near_copies(odd), key=repr)


def test_one_of_each(spark, odd, odd_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = brute.near_copies(odd)
    want = sorted({(c, None) for (d, c, _), (_, t) in zip(classes, odd, strict=True) if brute.ngrams(t) and d is not None}, key=repr)
    got = sorted({(r["doc_id"], None) for r in kept.collect() if brute.ngrams(r["text"]) and r["doc_id"] is not None}, key=repr)
    assert got == want and kept.count() == len(want) + sum(not brute.ngrams(t) for _, t in odd) + 1


def test_block_products_are_exact():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    want = [[i != j and len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert jaccard.similar(sets, None, 0.6).tolist() == want
    assert jaccard.similar(sets[:10], sets[10:], 0.6).tolist() == [row[10:] for row in want[:10]]


def test_band_plan():
    bands = jaccard.band_plan(0.8, 0.9995, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9995 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_components(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)] + [(1000 + i, 1000) for i in range(1, 80)] + [(draw.randint(2000, 2300), draw.randint(2000, 2300)) for _ in range(150)]
    label: dict = {}
    for a, b in chain:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        label = {v: min(x, y) if r in (x, y) else r for v, r in label.items()}
    edges = spark.createDataFrame([(a, b) for a, b in chain if a != b], "a long, b long").repartition(7)
    found = {r["v"]: r["root"] for r in components(edges, Workspace(spark, "test"), "c").collect()}
    assert found == {v: r for v, r in label.items() if v in found} and len(found) == len({v for a, b in chain if a != b for v in (a, b)})


def spans(docs, window=20):
    return as_rows(substring.with_kept(docs, window), "row.doc_id", "n_words", "n_removed", "kept")


@pytest.mark.parametrize("window", [20, 5])
def test_repeated_spans(spark, odd, odd_docs, window):
    assert spans(odd_docs, window) == sorted(brute.repeated(odd, window), key=repr)


def test_repeated_spans_query(spark):
    docs = documents(spark)
    want = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute.repeated(docs)), key=repr)
    assert as_rows(QUERIES["op8_repeated_spans"](spark, SF)) == want and any(g for _, _, g, _ in want)


def test_repeated_spans_of_few_words(spark):
    """Many branching nodes: texts over a small alphabet."""
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices("abc", k=draw.randint(0, 90)))) for i in range(60)]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for window in (4, 6, 9):
        assert spans(made, window) == sorted(brute.repeated(docs, window), key=repr)
    assert spans(empty(made)) == []


def test_windows_are_known_by_all_bits_of_their_hash(spark):
    """Two windows with one minimizer whose hashes agree in 40 bits: as the only ones of a node, and window by window in a branching node."""
    base = " ".join(f"w{i}" for i in range(19))
    one, two = (f"{base} v{i}" for i in (627941, 346004))
    hashes = [run_hashes(word_hashes(np.frombuffer(t.encode(), np.uint8)), 20)[0].tobytes() for t in (one, two)]
    assert hashes[0][:5] == hashes[1][:5] and hashes[0] != hashes[1]
    for docs in ([(1, one), (2, two)], [(1, one), (2, two), (3, f"{base} x"), (4, two)]):
        made = spark.createDataFrame(docs, "doc_id long, text string")
        assert spans(made) == sorted(brute.repeated(docs), key=repr)


def test_words_of_one_pattern_do_not_collide(spark):
    """Words that agree under sums of powers of one number modulo 2^64: a and b by the parity of the bits of their place, and the other way round."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest} end"), (4, " ".join(one)), (5, " ".join(two))]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    assert spans(made) == sorted(brute.repeated(docs), key=repr)
    assert len({int(word_hashes(np.frombuffer(w.encode(), np.uint8))[0]) for w in (one, two)}) == 2


def test_sources_verify(spark, monkeypatch):
    """The digest of a span is that of the words at its source: it is not that of a document that holds other words. Also with many tasks for a source."""
    monkeypatch.setattr(substring, "ASKED", 3)
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words), 10), (2, " ".join(words[:50]), 20), (None, "x " + " ".join(words), 30)], "doc_id long, text string, uid long")
    wanted = [(2, 20, i, 1, 1, 10, i + d) for i in range(30) for d in (0, 1)] + [(2, 20, 0, 20, None, 30, 1)]
    spans_ = spark.createDataFrame(wanted, "doc_id long, uid long, start int, n int, src_doc long, src_uid long, src_start int")
    found = substring.verified(docs, spans_, 20).collect()
    own = [w.encode() for w in words[:50]]
    assert len(found) == len(wanted)
    for r in found:
        true = r["src_doc"] is None or r["start"] == r["src_start"]
        assert (substring.span_digest(own, r["start"], r["n"], 20) == bytes(r["digest"])) == true


def test_a_span_is_asked_for_once_by_each_document(spark, monkeypatch):
    """Two words in turn make a span of two windows after the other, all with one place at the source."""
    asked, verified = [], substring.verified
    monkeypatch.setattr(substring, "verified", lambda docs, spans_, window: asked.append(spans_.count()) or verified(docs, spans_, window))
    docs = [(i, f"w{i} " + "over under " * (60 + i)) for i in range(6)]
    assert spans(spark.createDataFrame(docs, "doc_id long, text string")) == sorted(brute.repeated(docs), key=repr)
    assert asked[0] <= 3 * len(docs)


CLASHES = ("_key _uid _d _u _spans _n_words _n_removed _kept _keep_id _keep_uid _each _host _path _good _toxic _u_good _u_toxic s_n s_good s_host s_path s_r_good _p_good _p_toxic "
           "_rejected row uid id each blank keep_id keep_uid d u spans n_words n_removed kept start n words good toxic h_n r_good quality _text _id").split()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    """A column for every name that the operators use inside; each cell says where it belongs."""
    return spark.createDataFrame([(*row, *[f"{i} {name}" for name in CLASHES]) for i, row in enumerate(odd)],
                                 "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in CLASHES))


def belong(rows, names=CLASHES):
    return all(r[name].split(" ")[1] == name and len({r[x].split(" ")[0] for x in names}) == 1 for r in rows for name in names)


def test_clashing_names(spark, odd, clashing):
    cut = substring.with_kept(clashing, 20)
    assert as_rows(cut, "row.doc_id", "n_words", "n_removed", "kept") == sorted(brute.repeated(odd), key=repr) and belong(cut.select("row.*").collect())
    once = jaccard.one_of_each(clashing)
    assert once.columns == clashing.columns and belong(once.collect()) and once.count() == jaccard.one_of_each(clashing.select("doc_id", "text")).count()
    labels = spark.createDataFrame([(4, 1, 0, "x", "y"), (9, 0, 1, "x", "y")], "doc_id long, quality int, toxic int, _id string, _text string")
    graded = quality.classify(clashing, labels, clashing.columns, F.col("_host"), F.col("_path"))
    assert belong(graded.select("row.*").collect()) and graded.count() == len(odd)
    plain = quality.classify(clashing, labels, ["doc_id"], F.col("_host"), F.col("_path"))
    assert as_rows(graded, "row.doc_id", "_p_good", "_p_toxic") == as_rows(plain, "row.doc_id", "_p_good", "_p_toxic")


def test_texts_are_worked_on_in_slices(spark, odd, odd_docs, monkeypatch):
    """Many slices of a batch give what one does; slices are cut by bytes."""
    for module in (substring, jaccard, quality, vbyte, bpe_codec):
        monkeypatch.setattr(module, "SLICE", 1_000)
    assert spans(odd_docs) == sorted(brute.repeated(odd), key=repr)
    assert links(odd_docs) == sorted(brute.near_copies(odd), key=repr)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abc", None, "", "d" * 50, "e", "f"])], ["k", "t"]).slice(1)
    assert [b.column(0).to_pylist() for b in byte_slices(iter([batch, batch.slice(5)]), 1, 10)] == [[1, 2], [3], [4, 5]]


def test_pieces_are_made_in_slices(spark, odd, odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 1_000)
    check_pieces(packing.pack(odd_docs, BYTE).collect(), odd)


def test_words_of_the_sample_are_listed_in_slices(monkeypatch):
    texts = ["Bad words here, " + "x" * n for n in range(50)] + [None, "unjudged"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1] * 52), pa.array([n % 2 for n in range(50)] + [1, None])], ["t", "q", "toxic"])
    whole = [r for b in quality.listed_words(iter([batch])) for r in b.to_pylist()]
    assert whole == [{"word": w, "toxic": n % 2} for n, t in enumerate(texts[:50]) for w in sorted(quality.lower_words(np.frombuffer(t.encode(), np.uint8)))]
    monkeypatch.setattr(quality, "LISTED", 100)
    parts = list(quality.listed_words(iter([batch])))
    assert len(parts) > 10 and [r for b in parts for r in b.to_pylist()] == whole


class Here:
    """Stands for a DataFrame whose only batch is worked on in this process."""

    def __init__(self, *columns):
        self.batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_tasks_give_up_what_others_left():
    """A Python worker outlives its tasks: those that need no vocabulary don't work beside one, nor beside the words it has seen."""
    ids, texts = pa.array([1]), pa.array(["some words of a text " * 9])
    for task in (lambda: substring.paths(Here(ids, ids, texts), 20, 8), lambda: jaccard.signed(Here(ids, ids, texts), 5, 2, 6), lambda: jaccard.gram_sets(Here(ids, texts), 5),
                 lambda: list(quality.listed_words(iter([Here(texts, ids, ids).batch])))):
        left = [weakref.ref(made) for made in (bpe.library_encoder(BYTE), bpe_codec.text_encoder(BYTE), token_count.text_counter(BYTE), bpe.vocabulary(BYTE))]
        assert all(made() for made in left)
        assert task() and not any(made() for made in left)


def brute_posteriors(rows, prior):
    """Plain version of the rates of hosts and paths for one kind of evidence: (id, host, path, log odds) -> probability."""
    share = [round(1_000_000 / (1 + math.exp(-(x + quality.logit(prior))))) / 1e6 for _, _, _, x in rows]
    paths, hosts = {}, {}
    for (_, host, path, _), s in zip(rows, share, strict=True):
        for key, into in (((host, path), paths), (host, hosts)):
            n, total = into.get(key, (0, 0.0))
            into[key] = n + 1, total + s
    mean = min(max(sum(share) / len(share), 1e-6), 1 - 1e-6)

    def strength(sites):
        if len(sites) < 2:
            return 10.0
        n = sum(n for n, _ in sites)
        spread = max(sum(k * (t / k - mean) ** 2 for k, t in sites) / n - mean * (1 - mean) * len(sites) / n, 1e-6)
        return min(max(mean * (1 - mean) / spread - 1, 2.0), 10_000.0)

    k_host, k_path = strength(list(hosts.values())), strength(list(paths.values()))
    for (i, host, path, x), s in zip(rows, share, strict=True):
        above = (hosts[host][1] + k_host * mean) / (hosts[host][0] + k_host)
        n, total = paths[host, path]
        site = min(max((total - s + k_path * above) / (n - 1 + k_path), 1e-6), 1 - 1e-6)
        yield i, 1 / (1 + math.exp(-(x + math.log(site / (1 - site)))))


def test_posteriors(spark):
    draw = random.Random(12)
    sites = [(f"h{draw.choice([0, 0, 0, 1, 2, None])}", f"p{draw.randint(0, 4)}" if draw.random() < 0.9 else None) for _ in range(400)] + [("rare", "one"), (None, None)]
    rows = [(i, h, p, draw.gauss(2.0 if h == "h0" else -1.0, 2), draw.gauss(-4, 3)) for i, (h, p) in enumerate(sites)]
    scored = spark.createDataFrame(rows, "doc_id long, _host string, _path string, _good double, _toxic double").repartition(4)
    found = {r["doc_id"]: r for r in quality.posteriors(scored, 0.7, Workspace(spark, "test"), 0.05).collect()}
    for name, at, prior in (("_p_good", 3, 0.7), ("_p_toxic", 4, 0.05)):
        for i, p in brute_posteriors([(*r[:3], r[at]) for r in rows], prior):
            assert abs(found[i][name] - p) < 1e-9
    assert all(r["_rejected"] == (r["_p_good"] < 0.5 or r["_p_toxic"] > 0.5) for r in found.values())


def test_merger_is_the_library():
    """Words of many kinds, one by one, against the library's model."""
    draw = random.Random(7)
    words = ["".join(draw.choices("etaoinsrhldcu", k=draw.randint(1, 30))) for _ in range(4_000)] + ["a" * n for n in range(1, 200)] + ["\x00\x01", "é中\U0001f600" * 9]
    words += ["".join(chr(draw.choice([draw.randint(1, 0x7FF), draw.randint(0x4E00, 0x9FFF), draw.randint(0x1F300, 0x1F6FF)])) for _ in range(draw.randint(1, 9))) for _ in range(2_000)]
    for path in (BYTE, WORDS):
        vocab, letters = bpe.vocabulary(path), bpe._byte_letters()
        merge, model = bpe.word_merger(vocab), bpe.library(path).model
        for w in [*words, *[t.removesuffix(vocab.suffix) if vocab.suffix else t for t in list(vocab.ids)[::7]]]:
            assert merge(w) == [t.id for t in model.tokenize("".join([letters[b] for b in w.encode()]))], w
        assert merge("") == []


def test_caches_forget():
    made = []
    cache = WordCache(lambda w: made.append(w) or len(w))
    for w in [f"w{i}" for i in range(CACHE_WORDS)] + ["w0", "new", "w0", "w1"]:
        assert cache[w] == len(w)
    assert made.count("w0") == made.count("w1") == 1 and len(cache) <= CACHE_WORDS
    assert cache["x" * 65] == 65 and "x" * 65 not in cache


def test_spans_are_compacted(spark):
    text = " ".join(f"w{i}" for i in range(500))
    docs = spark.createDataFrame([(1, text, 1), (2, "new " + text, 2)], "doc_id long, text string, uid long")
    found = substring.repeated_spans(docs.select("doc_id", "uid", "text"), 20, Workspace(spark, "test")).collect()
    assert [(r["doc_id"], r["start"], r["n"], r["src_doc"], r["src_start"]) for r in found if r["n"] > 400] != []


def test_word_hashes_do_not_depend_on_pieces():
    raw = np.frombuffer(("the cat\tsat  on\x0bthe " + "x" * 50 + " mat é the cat").encode(), np.uint8)
    whole = word_hashes(raw)
    assert len(whole) == 10 and whole[0] == whole[4] == whole[8] and whole[1] == whole[9]
    for piece in (1, 3, 8, 20):
        assert word_hashes(raw, piece).tolist() == whole.tolist()
    assert run_hashes(whole, 2)[0] == run_hashes(whole, 2)[8]


def test_quality(spark):
    """Learns from half of the labels what the other half says; empty tables and missing labels do no harm."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = labels.where("doc_id % 2 = 0")
    found = quality.classify(docs, half, ["doc_id"], F.col("source"), F.col("lang")).select("row.doc_id", "_rejected").join(labels.where("doc_id % 2 = 1"), "doc_id")
    clean = found.where("quality = 1 and toxic = 0").agg(F.avg(F.col("_rejected").cast("int")), F.count("*")).first()
    bad = found.where("quality = 0").agg(F.avg(F.col("_rejected").cast("int")), F.count("*")).first()
    toxic = found.where("toxic = 1").agg(F.avg(F.col("_rejected").cast("int")), F.count("*")).first()
    assert clean[0] < 0.02 and bad[0] > 0.9 and toxic[0] > 0.85, (clean, bad, toxic)


def test_diversity_sees_every_word():
    """Junk that cycles over five words behind a clean opening lowers the evidence, wherever it stands and however long the text is."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(4_000)]
    cycle = [w for _ in range(400) for w in words[:5]]
    opening, whole = (np.frombuffer(" ".join(found).encode(), np.uint8) for found in (words[:500], words[:500] + cycle))
    assert quality._shares(whole, word_hashes(whole))[-2] < 0.5 < quality._shares(opening, word_hashes(opening))[-2]
    at = len(quality.features(np.empty(0, np.uint8))) // 3 - 2
    of = lambda found: quality.features(np.frombuffer(" ".join(found).encode(), np.uint8)).reshape(3, -1)[:, at]
    clean, tail, middle = of(words), of(words[:500] + cycle), of(words[:500] + cycle + words[500:1_000])
    assert (clean > 0.99).all() and tail[0] < 0.5 and middle[0] < 0.6
    assert tail[1] > 0.99 and tail[2] < 0.1 and middle[2] < 0.1
    few = [draw.choice(words[:300]) for _ in range(40_000)]
    assert abs(of(few[:400])[0] - of(few)[0]) < 0.05
    short = ["x"] * 900 + ["y"] * 99  # one part of more than a stretch
    assert of([f"{i}" for i in range(400)] + short[:50])[0] < of([f"{i}" for i in range(400)])[0] and quality.diversity(np.empty(0, np.uint64)) == 0
    assert quality.diversity(np.arange(400, dtype=np.uint64).repeat(2)) == 0.5


def test_moderate_words_for_toxicity_add_up():
    """Eight words, each three times as frequent in toxic texts, of which there are few: no word tells by itself, many together do."""
    draw = np.random.default_rng(6)
    toxic = draw.random(6_000) < 0.03
    has = [np.flatnonzero(draw.random(8) < (0.75 if t else 0.25)).tolist() for t in toxic]
    *found, bias = quality.fit_words(has, toxic.astype(float), 8).tolist()
    model = quality.Model(toxic_prior=float(toxic.mean()), words=dict(zip("abcdefgh", found, strict=True)), word_bias=bias)
    odds = [model.toxic(set(some)) + quality.logit(model.toxic_prior) for some in ("a", "abcdefgh")]
    assert odds[0] < 0 < odds[1] and all(1.5 < w < 3 for w in found)
    x = np.array([[i in one for i in range(8)] for one in has], float)
    z = np.column_stack([x, np.ones(len(x))]) @ np.array([*found, bias])
    assert np.abs(x.T @ (toxic - 1 / (1 + np.exp(-z))) - np.array(found)).max() < 1e-3


def test_toxicity_is_weighed_with_the_site(spark):
    rows = [(f"h{h}", f"p{p}", 3.0 if h == 3 else -3.0) for h in range(4) for p in range(3) for _ in range(30)] + [("h0", "new", 0.0), ("h3", "new", 0.0)]
    scored = spark.createDataFrame([(i, h, p, 9.0, t) for i, (h, p, t) in enumerate(rows)], "doc_id long, _host string, _path string, _good double, _toxic double")
    found = {r["_host"]: (r["_p_toxic"], r["_rejected"]) for r in quality.posteriors(scored, 0.5, Workspace(spark, "test"), 0.5).where("_path = 'new'").collect()}
    assert found["h0"][0] < 0.35 < 0.65 < found["h3"][0] and not found["h0"][1] and found["h3"][1]


def test_quality_of_odd_rows(spark, odd, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        found = quality.classify(odd_docs, some, odd_docs.columns, F.col("family"), F.col("ids"))
        assert found.select("row.*").columns == odd_docs.columns and found.count() == len(odd)
    assert found.where("_rejected").count() == 0
    assert quality.classify(empty(odd_docs), labels, ["doc_id"], F.col("family"), F.lit(None)).count() == 0


def test_sparse_sites_are_drawn_to_the_level_above(spark):
    rows = [(f"h{h}", f"p{p}", 3.0 if h else -3.0) for h in range(4) for p in range(3) for _ in range(30)] + [("h0", "new", 0.0), ("h3", "new", 0.0)]
    scored = spark.createDataFrame([(i, *r, -9.0) for i, r in enumerate(rows)], "doc_id long, _host string, _path string, _good double, _toxic double")
    found = {r["_host"]: r["_p_good"] for r in quality.posteriors(scored, 0.5, Workspace(spark, "test")).where("_path = 'new'").collect()}
    assert found["h0"] < 0.35 < 0.65 < found["h3"]
