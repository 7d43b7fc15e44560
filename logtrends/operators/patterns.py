"""Runs of lines whose templates follow a given sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.operators.order import ROWS_PER_BLOCK, number_rows, with_next


def pattern_matches(assigned: DataFrame, patterns: DataFrame, rows_per_block: int = ROWS_PER_BLOCK,
                    with_line_nos: bool = False) -> DataFrame:
    """All spans of lines that match a pattern, in every log.

    ``patterns``: ``pattern_id, path``. Lines without a template do not break a run. A pair
    of neighbouring lines that is pair s of a pattern votes for the start s lines before it;
    a start with votes for all pairs is a match. Lines whose neighbour does not fit never
    leave the join. ``with_line_nos`` adds the numbers of the lines of each span.
    """
    ordinals = number_rows(
        assigned.select("log_id", "line_no", "template_id"),
        ["log_id"], ["line_no"], F.floor(F.col("line_no") / rows_per_block), "ordinal",
    )
    following = {"dst": "template_id", "next_line": "line_no"}
    pairs = with_next(ordinals, ["log_id"], "ordinal", following, rows_per_block).withColumnRenamed("template_id", "src")

    # a pattern of one line is a pair without second half
    size = F.size("path")
    steps = patterns.select(
        "pattern_id", size.alias("_size"), "path", F.explode(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0)))).alias("_step")
    ).select(
        "pattern_id", "_size", "_step", F.element_at("path", F.col("_step") + 1).alias("src"),
        F.when(F.col("_size") > 1, F.try_element_at("path", F.col("_step") + 2)).alias("dst"),
    )
    votes = (
        pairs.join(steps.filter("_size > 1"), ["src", "dst"]).withColumn("_end", F.col("next_line"))
        .unionByName(
            pairs.drop("dst").join(steps.filter("_size = 1").drop("dst"), "src")
            .withColumn("dst", F.lit(None).cast("int")).withColumn("_end", F.col("line_no"))
        )
        .withColumn("_start", F.col("ordinal") - F.col("_step"))
    )
    numbers = []
    if with_line_nos:
        both = F.concat(F.collect_list("line_no"), F.collect_list("_end"))
        numbers = [F.array_sort(F.array_distinct(both)).alias("line_nos")]
    return (
        votes.groupBy("log_id", "pattern_id", "_start", "_size")
        .agg(F.count(F.lit(1)).alias("_votes"), F.min("line_no").alias("start_line"), F.max("_end").alias("end_line"), *numbers)
        .filter(F.col("_votes") == F.greatest(F.col("_size") - 1, F.lit(1)))
        .select("pattern_id", "log_id", "start_line", "end_line", F.col("_size").cast("bigint").alias("n_lines"),
                *(["line_nos"] if with_line_nos else []))
    )


def with_texts(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans with ``lines``, number and text of each of their lines. ``spans`` is read twice and should be stored."""
    span = ["pattern_id", "log_id", "start_line"]
    texts = (
        spans.select(*span, F.explode("line_nos").alias("line_no"))
        .join(lines.select("log_id", "line_no", "line"), ["log_id", "line_no"])
        .groupBy(*span).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    )
    return spans.drop("line_nos").join(texts, span)
