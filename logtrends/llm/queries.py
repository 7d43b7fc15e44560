"""The registered queries of this folder, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrends.llm import ann, bpe_codec, importance, infill, jaccard, packing, quality, secrets, substring, token_count, topk, vbyte, warc
from logtrends.llm.bpe import default_path
from logtrends.llm.common import table
from logtrends.llm.oracle import ORACLE  # noqa: F401

BYTE_LEVEL, WORD_ENDS = "byte_bpe_50k.json", "word_bpe_49k.json"
K, EVERY, WINDOW, LIMIT = 5, 50, 20, 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pack_pow2(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), default_path(BYTE_LEVEL))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_warc_index(spark, sf):
    records = warc.archive_pages(table(spark, sf, "pages"))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@query
def op3_norm_buckets(spark, sf):
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    return topk.top_products(table(spark, sf, "embeddings"), K, F.col("id") % EVERY == 0, prepare=whole)


@query
def op4_quality_bayes(spark, sf):
    docs = table(spark, sf, "documents")
    found = quality.classify(docs, table(spark, sf, "labels"), ["doc_id"], F.col("source"), F.col("lang"))
    return found.select("row.doc_id", F.round("_p_good", 9).alias("p_good"), F.round("_p_toxic", 9).alias("p_toxic"), F.col("_rejected").alias("rejected"))


@query
def op5_heap_token_counts(spark, sf):
    return token_count.count_tokens(table(spark, sf, "documents"), default_path(WORD_ENDS), LIMIT)


@query
def op6_permutation_index(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), K, F.col("id") % EVERY == 0)


@query
def op7_ngram_jaccard(spark, sf):
    return jaccard.near_copies(table(spark, sf, "documents")).select("doc_id", "class_id", "n_links")


@query
def op8_repeated_spans(spark, sf):
    kept = substring.with_kept(table(spark, sf, "documents").select("doc_id", "text"), WINDOW)
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_vbyte_files(spark, sf):
    found = vbyte.token_files(table(spark, sf, "documents"), default_path(WORD_ENDS), end_id=1)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_forced_boundary_bpe(spark, sf):
    path = default_path(BYTE_LEVEL)
    coded = bpe_codec.decode(bpe_codec.encode(table(spark, sf, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op11_owned_secrets(spark, sf):
    """``documents`` has no repository: a source stands for an owner, its documents in one language for a repository."""
    owner = F.col("source")
    found = secrets.scan(table(spark, sf, "documents"), F.concat_ws("/", owner, "lang"), owner)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long")
    told = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")], F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"), *[told(verdict).alias(f"n_{verdict}") for verdict in ("live", "shared", "example")])


@query
def op12_importance_resampling(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_fill_in_middle(spark, sf):
    made = infill.restore(infill.transform(table(spark, sf, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
