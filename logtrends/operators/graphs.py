"""Transition graphs of logs and their outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.operators import sets
from logtrends.operators.order import ROWS_PER_BLOCK, with_next


def transitions(assigned: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per log each pair (template, next template) with first line and count; ``dst`` is null
    for the last line of the log.

    Lines without a template are not in ``assigned``, so a transition spans them. The table
    grows with logs and templates, not with lines.
    """
    pairs = with_next(
        assigned.select("log_id", "line_no", "template_id"), ["log_id"], "line_no",
        {"dst": "template_id"}, rows_per_block,
    )
    return pairs.groupBy("log_id", F.col("template_id").alias("src"), "dst").agg(
        F.min("line_no").alias("first_pos"), F.count(F.lit(1)).alias("n")
    )


def nodes_of(steps: DataFrame) -> DataFrame:
    return steps.groupBy("log_id", F.col("src").alias("template_id")).agg(F.min("first_pos").alias("first_pos"))


def edges_of(steps: DataFrame) -> DataFrame:
    return steps.filter("dst is not null")


def mfg_nodes(assigned: DataFrame) -> DataFrame:
    """Templates of each log with the line of their first occurrence."""
    return assigned.groupBy("log_id", "template_id").agg(F.min("line_no").alias("first_pos"))


def mfg_edges(assigned: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Distinct transitions (template to next template) of each log."""
    return edges_of(transitions(assigned, rows_per_block))


def out_degree(edges: DataFrame) -> DataFrame:
    """Number of different successors of each vertex."""
    return edges.groupBy("log_id", "src").agg(F.count(F.lit(1)).alias("degree"))


def graph_items(edges: DataFrame, metric: str = "edges") -> DataFrame:
    """Each log's graph as a set of (src, x) pairs packed into one number.

    ``edges``: x is the successor. ``out_degree``: x runs from 0 to the out-degree minus 1,
    so the set distance is the sum of the out-degree differences.
    """
    if metric == "edges":
        pairs = edges.select("log_id", "src", F.col("dst").alias("x"))
    elif metric == "out_degree":
        pairs = out_degree(edges).select(
            "log_id", "src", F.explode(F.sequence(F.lit(0), F.col("degree").cast("int") - 1)).alias("x")
        )
    else:
        raise ValueError("metric must be 'edges' or 'out_degree'")
    return pairs.select("log_id", (F.col("src").cast("bigint") * F.lit(2**31) + F.col("x")).alias("item"))


def nn_distance(clusters: DataFrame, edges: DataFrame, metric: str = "edges",
                sets_per_task: int = sets.SETS_PER_TASK) -> DataFrame:
    """Distance of each log's graph to its nearest neighbour in the same cluster.

    Logs without any transition take part with an empty graph. A log that is alone in its
    cluster has no neighbour and no row.
    """
    items = graph_items(edges, metric).groupBy("log_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    graphs = clusters.select("cluster_id", "log_id").join(items, "log_id", "left").select(
        "cluster_id", "log_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items")
    )
    distinct = graphs.groupBy("cluster_id", "items").agg(
        F.min("log_id").alias("set_id"), F.count(F.lit(1)).alias("weight")
    )
    nearest = sets.nearest(distinct, sets_per_task)
    return (
        graphs.join(nearest, ["cluster_id", "items"])
        .select("cluster_id", "log_id", "nn").filter("nn is not null")
    )


def mfg_outliers(nn: DataFrame, k: float = 2.0) -> DataFrame:
    """Logs whose nearest neighbour is farther than mean + k times the population deviation.

    The comparison is done on whole-number sums, so the result does not depend on the order
    in which Spark adds up.
    """
    d = "decimal(19,0)"
    sums = nn.groupBy("cluster_id").agg(
        F.count(F.lit(1)).cast(d).alias("_n"),
        F.sum("nn").cast(d).alias("_s"),
        F.sum(F.col("nn") * F.col("nn")).cast(d).alias("_q"),
    )
    above = (F.col("_n") * F.col("nn").cast(d) - F.col("_s")).cast("double")
    spread = F.sqrt((F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double"))
    return nn.join(sums, "cluster_id").filter(above > F.lit(float(k)) * spread).select("cluster_id", "log_id", "nn")


def graph_distance(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Size of the symmetric difference between the graph of ``log_id`` and of ``baseline_log_id``.

    Counted from the shared edges: |A| + |B| - 2 |A and B|.
    """
    plain = edges.select("log_id", "src", "dst")
    size = plain.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    base = plain.withColumnRenamed("log_id", "baseline_log_id")
    shared = (
        pairs.select("log_id", "baseline_log_id").join(plain, "log_id")
        .join(base, ["baseline_log_id", "src", "dst"])
        .groupBy("log_id", "baseline_log_id").agg(F.count(F.lit(1)).alias("shared"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        pairs.select("log_id", "baseline_log_id")
        .join(size.withColumnRenamed("n", "_a"), "log_id", "left")
        .join(size.select(F.col("log_id").alias("baseline_log_id"), F.col("n").alias("_b")), "baseline_log_id", "left")
        .join(shared, ["log_id", "baseline_log_id"], "left")
        .select(
            "log_id", "baseline_log_id",
            (F.coalesce("_a", zero) + F.coalesce("_b", zero) - 2 * F.coalesce("shared", zero)).alias("distance"),
        )
    )
