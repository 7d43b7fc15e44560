"""Template-presence vectors of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.functions.vectors import set_distance


def mav(matches: DataFrame) -> DataFrame:
    """Sorted set of the templates that occur in each log.

    Pairs are made distinct first, so that a log is never larger than the template table
    when its array is built.
    """
    return (
        matches.select("log_id", "template_id").distinct()
        .groupBy("log_id").agg(F.array_sort(F.collect_list("template_id")).alias("template_ids"))
    )


def difflog_mav(difflog_edges: DataFrame) -> DataFrame:
    """Sorted set of the templates on the missing transitions of each log, at each threshold."""
    return (
        difflog_edges.select("threshold", "log_id", F.explode(F.array("src", "dst")).alias("template_id")).distinct()
        .groupBy("threshold", "log_id").agg(F.array_sort(F.collect_list("template_id")).alias("template_ids"))
    )


def patterns(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with the number of logs that share them, named by their smallest log."""
    return vectors.groupBy("template_ids").agg(
        F.min("log_id").alias("pattern_id"), F.count(F.lit(1)).alias("weight")
    )


def distance_to_medoid(clustered: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distance of every log from the medoid of its cluster."""
    medoids = vectors.select(F.col("log_id").alias("medoid_log_id"), F.col("template_ids").alias("_medoid"))
    return (
        clustered.join(vectors, "log_id").join(medoids, "medoid_log_id")
        .select("cluster_id", "log_id", "medoid_log_id",
                set_distance(F.col("template_ids"), F.col("_medoid")).alias("distance"))
    )
