"""Archives, vector searches and the pipeline against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtrends.llm import ann, topk, warc
from logtrends.llm.common import table
from logtrends.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def archived(pages, **options):
    return as_rows(warc.archive_pages(pages, **options).select("page_id", "payload_bytes", "digest", "record_type", "refers_to"))


def test_archives(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "", ""), (5, "é", "ü" * 100_000), (None, "n", "x"), (7, "z", "\r\n\r\nWARC/1.1"),
            (7, "z", "\r\n\r\nWARC/1.1"), (8, "z", "\r\n\r\nWARC/1.1"), (None, "m", "only")]
    pages = spark.createDataFrame([(*r, 0, "d") for r in rows], "page_id long, url string, html string, at int, digest string")
    assert archived(pages) == sorted(brute.records([(r[0], r[2]) for r in rows]), key=repr)
    assert {r[3] for r in archived(pages, min_revisit_bytes=10**6)} == {"response"}
    assert archived(pages.where("false")) == []
    pages = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "html").collect()]
    assert as_rows(QUERIES["op2_warc_index"](spark, SF)) == sorted(brute.records(pages), key=repr)


def test_many_copies_of_a_page(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'same', concat('own', id)) as html")
    found = warc.archive_pages(pages).groupBy("record_type").count().collect()
    assert {r[0]: r[1] for r in found} == {"response": 2001, "revisit": 999}


def test_ranges_are_merged():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 0, 7), ("b", 1000, 7)]
    assert [(f, x, y, len(m)) for f, x, y, m in warc.merge_ranges(iter(rows), gap=30, span=44)] == [("a", 0, 15, 2), ("a", 40, 45, 1), ("b", 0, 7, 1), ("b", 1000, 1007, 1)]


def odd_vectors():
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=6) * (1 + i % 7)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]  # copies
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 3.0, 4.0, 5.0, 6.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2050, [0.0] * 6), (2100, [1.0, 2.0]),
             (2150, [2.0, 1.0]), (None, [1.0] * 6), (2200, [1e6] * 6)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in odd_vectors()], "vec_id long, embedding array<double>, bucket int, v int").repartition(6)


@pytest.mark.parametrize("chunk,block", [(8192, 4096), (50, 4)])
def test_top_products(spark, vectors, monkeypatch, chunk, block):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    whole = {i: np.floor(v * 256) for i, v in brute.fine_vectors(odd_vectors()).items()}
    want = [(q, r, i, int(s)) for q, r, i, s in brute.top(whole, lambda a, b: float(a @ b), 5)]
    found = topk.top_products(vectors, 5, F.col("id") % 50 == 0, prepare=F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    assert as_rows(found) == sorted(want, key=repr)


def test_no_pruning_loses_a_hit():
    draw = np.random.default_rng(2)
    for steep in range(200):
        v = draw.normal(size=(300, 5)) * draw.uniform(0.5, 1, (300, 1))
        q = draw.normal(size=5) if steep % 3 else np.eye(5)[steep % 5] * 3
        length = np.sqrt((v * v).sum(axis=1))
        bound = float(np.sort(v @ q)[-1 - steep % 8])
        rows = topk.survivors(v, length, v / length[:, None], q, bound)
        assert set(np.flatnonzero(v @ q >= bound)) <= set(rows.tolist())


def test_searches_of_nothing(spark, vectors):
    for some in (vectors.where("false"), vectors.where("vec_id = 3"), vectors.where("vec_id = 100")):
        assert topk.top_products(some, 5, F.col("id") % 50 == 0).count() == 0
        assert ann.nearest(some, 5, F.col("id") % 50 == 0).count() == 0


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float((a / np.sqrt(a @ a)) @ (b / np.sqrt(b @ b)))


def test_top_products_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    whole = {i: np.floor(v * 256) for i, v in brute.fine_vectors(rows).items()}
    want = [(q, r, i, int(s)) for q, r, i, s in brute.top(whole, lambda a, b: float(a @ b), 5)]
    assert as_rows(QUERIES["op3_norm_buckets"](spark, SF)) == sorted(want, key=repr)


def test_nearest_with_everything_reranked_is_exact(spark, vectors):
    fine = {i: v for i, v in brute.fine_vectors(odd_vectors()).items() if v.any()}
    want = list(brute.top(fine, cosine, 5))
    got = sorted((tuple(r) for r in ann.nearest(vectors, 5, F.col("id") % 50 == 0, share=1.0).collect()))
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, sorted(want), strict=True))
    copies = {q: [i for x, _, i, _ in got if x == q] for q in (1000, 1050)}
    assert copies == {1000: [1001, 1002, 1003, 1004, 1005], 1050: [1000, 1001, 1002, 1003, 1004]}


def test_recall(spark):
    """At least 0.9 against brute force on directions without structure, with the registered parameters."""
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()]
    fine = brute.fine_vectors(rows)
    ids, m = np.array(list(fine)), np.array(list(fine.values()))
    m = m / np.linalg.norm(m, axis=1)[:, None]
    got = {}
    for r in QUERIES["op6_permutation_index"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -2
        want = set(ids[np.argsort(-s, kind="stable")[:5]].tolist())
        hits, total = hits + len(want & got[q]), total + 5
    assert hits / total >= 0.9, hits / total


def test_footrule():
    near = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5], [1, 5, 0]])
    files = ann.InvertedFiles(near, 6)
    want = []
    for row in near.tolist():
        place = lambda x, pivot: x.index(pivot) if pivot in x else 3
        want.append(sum(abs(place(row, p) - place([0, 1, 2], p)) for p in range(6)))
    assert files.footrule(np.array([0, 1, 2])).tolist() == want


def test_pipeline_stages(spark):
    """Each stage against the plain version of its operator, on what the stage before has kept."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    columns = docs.columns
    good = spark.createDataFrame(corpus_pipeline.keep_quality(spark, docs, SF).collect(), docs.schema)
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert good.columns == columns and sum(d in kept for d in clean) >= 0.97 * len(clean)
    once = spark.createDataFrame(corpus_pipeline.keep_one_of_near_copies(spark, good, SF).collect(), docs.schema)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert once.columns == columns and sorted(r["doc_id"] for r in once.collect()) == sorted({c for _, c, _ in brute.near_copies(rows)})
    cut = corpus_pipeline.cut_repeated_spans(spark, once, SF)
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    want = {d: k if gone else texts[d] for d, _, gone, k in brute.repeated(list(texts.items()))}
    assert cut.columns == columns and {r["doc_id"]: r["text"] for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(texts) and corpus_pipeline.ORACLE_SQL is None
