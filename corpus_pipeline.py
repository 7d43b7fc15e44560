"""A corpus pipeline: classify by quality, keep one of each near copy, cut repeated spans, pack.

Each stage gets what its predecessor kept, as written and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrends.llm import jaccard, packing, quality, substring
from logtrends.llm.bpe import default_path
from logtrends.llm.common import Workspace, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    found = quality.classify(docs, table(spark, sf_dir, "labels"), docs.columns, F.col("source"), F.col("lang"))
    return found.where("not _rejected").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words, similarity 0.8."""
    return jaccard.one_of_each(docs).select(docs.columns)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of spans that begin earlier elsewhere; texts without such spans stay byte for byte."""
    found, cut = substring.with_kept(docs, window=20), F.col("n_removed") > 0
    own = {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.when(cut, F.col("kept")).otherwise(own["text"])
    own["n_chars"] = F.when(cut, F.length("kept").cast("long")).otherwise(own["n_chars"])
    return found.select(*[value.alias(name) for name, value in own.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids."""
    return packing.pack(docs, default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near copies", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_spans),
    ("packing", pack),
]
#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage on the whole table of documents."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = work.store(stage(spark, docs, sf_dir), str(number))
        if number:
            work.drop(str(number - 1))
    return docs
