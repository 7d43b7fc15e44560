"""Abnormal logs, the transitions they have and normal logs lack, and what these have in common."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtrends.operators.graphs import mfg_outliers, nn_distance


def abnormal_logs(clusters: DataFrame, edges: DataFrame, metric: str = "edges", k: float = 2.0) -> DataFrame:
    """Logs of small clusters (baseline null: every normal log) and graph outliers of the
    others (baseline: medoid of the cluster). Input: clusters of any number of thresholds
    with their verdict."""
    keyed = clusters.withColumn("_key", F.concat_ws("|", F.col("threshold").cast("string"), "cluster_id"))
    graphs = keyed.filter("verdict = 'MFG'")
    nn = nn_distance(graphs.select(F.col("_key").alias("cluster_id"), "log_id"), edges, metric)
    outliers = mfg_outliers(nn, k).select(F.col("cluster_id").alias("_key"), "log_id")
    return (
        graphs.join(outliers, ["_key", "log_id"])
        .select("threshold", "log_id", F.lit("MFG").alias("reason"), F.col("medoid_log_id").alias("baseline_log_id"))
        .unionByName(
            keyed.filter("verdict = 'AA'").select(
                "threshold", "log_id", F.lit("MAV").alias("reason"), F.lit(None).cast("string").alias("baseline_log_id")
            )
        )
    )


def normal_edges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Transitions of any baseline log, i.e. of any medoid of a cluster sent to graph analysis."""
    medoids = clusters.filter("verdict = 'MFG'").select("threshold", F.col("medoid_log_id").alias("log_id")).distinct()
    return medoids.join(edges, "log_id").select("threshold", "src", "dst").distinct()


def difflog_edges(abnormal: DataFrame, edges: DataFrame) -> DataFrame:
    """Transitions of an abnormal log that its baseline log does not have."""
    base = edges.select(F.col("log_id").alias("baseline_log_id"), "src", "dst")
    return (
        abnormal.filter("baseline_log_id is not null").select("threshold", "log_id", "baseline_log_id")
        .join(edges.select("log_id", "src", "dst"), "log_id")
        .join(base, ["baseline_log_id", "src", "dst"], "left_anti")
        .select("threshold", "log_id", "src", "dst")
    )


def difflog_edges_all(abnormal: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Transitions of an abnormal log that no baseline log has.

    The intersection of the differences to all baselines is the difference to their union.
    """
    return (
        abnormal.filter("baseline_log_id is null").select("threshold", "log_id")
        .join(edges.select("log_id", "src", "dst"), "log_id")
        .join(normal_edges(clusters, edges), ["threshold", "src", "dst"], "left_anti")
        .select("threshold", "log_id", "src", "dst")
    )


# -- paths ----------------------------------------------------------------------------------

def missing_paths(rows: list[tuple[int, int, bool, bool]], order: list[int]) -> list[tuple[int, ...]]:
    """Paths of missing transitions in one graph, depth first.

    ``rows``: (src, dst, missing, dst is normal) in first-seen order. ``order``: vertices in
    first-seen order. A path goes on through vertices that are not normal and are met for the
    first time; it ends at a normal vertex, at one already visited or at a leaf.
    """
    successors: dict[int, list[tuple[int, bool]]] = {}
    normal: dict[int, bool] = {}
    for src, dst, missing, dst_normal in rows:
        successors.setdefault(src, []).append((dst, missing))
        normal[dst] = dst_normal
    for src, dst, missing, _ in rows:
        if not missing:
            normal[src] = True
    visited: set[int] = set()
    paths: dict[tuple[int, ...], None] = {}
    for start in order:
        if start in visited:
            continue
        todo: list[tuple[int, tuple[int, ...]]] = [(start, ())]
        while todo:
            vertex, before = todo.pop()
            out = successors.get(vertex, [])
            if vertex in visited or normal.get(vertex, False) or not out:
                if before:
                    paths[(*before, vertex)] = None
            if vertex in visited:
                continue
            visited.add(vertex)
            carried = () if normal.get(vertex, False) else before
            for dst, missing in reversed(out):
                todo.append((dst, (*carried, vertex) if missing else ()))
    return list(paths)


def _paths_of_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of many logs, one row each with its transitions as lists in first-seen order."""
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(name).to_pylist() for name in ("threshold", "log_id", "src", "dst", "missing", "dst_normal")]
        for threshold, log, src, *rest in zip(*columns, strict=True):
            found = missing_paths(list(zip(src, *rest, strict=True)), list(dict.fromkeys(src)))
            out += [(threshold, log, i, list(path)) for i, path in enumerate(found)]
        fields = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(fields, (pa.float64(), pa.string(), pa.int32(), pa.list_(pa.int32())), strict=True)],
                                         names=["threshold", "log_id", "path_id", "path"])


def difflog_paths(difflog: DataFrame, edges: DataFrame, normal_vertices: DataFrame) -> DataFrame:
    """Missing transitions of each log put together to paths.

    ``normal_vertices``: (threshold, log_id, template_id) of what the log is compared with.
    The transition graph of one log is one row; it is bounded by the square of the number of templates and not by the length of the log.
    Many logs share a call.
    """
    logs = difflog.select("threshold", "log_id").distinct()
    flagged = (
        logs.join(edges.select("log_id", "src", "dst", "first_pos"), "log_id")
        .join(difflog.withColumn("missing", F.lit(True)), ["threshold", "log_id", "src", "dst"], "left")
        .join(
            normal_vertices.select("threshold", "log_id", F.col("template_id").alias("dst"), F.lit(True).alias("dst_normal")),
            ["threshold", "log_id", "dst"], "left",
        )
        .select("threshold", "log_id", "src", "dst", "first_pos",
                F.coalesce("missing", F.lit(False)).alias("missing"),
                F.coalesce("dst_normal", F.lit(False)).alias("dst_normal"))
    )
    values = ["src", "dst", "missing", "dst_normal"]
    graphs = flagged.groupBy("threshold", "log_id").agg(F.array_sort(F.collect_list(F.struct("first_pos", *values))).alias("_steps"))
    listed = graphs.select("threshold", "log_id", *[F.col("_steps")[name].alias(name) for name in values])
    return listed.mapInArrow(_paths_of_logs, "threshold double, log_id string, path_id int, path array<int>")


def normal_vertices(abnormal: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Templates of the baseline of each abnormal log (of all baselines where it has none of its own)."""
    plain = nodes.select("log_id", "template_id")
    own = (
        abnormal.filter("baseline_log_id is not null")
        .join(plain.withColumnRenamed("log_id", "baseline_log_id"), "baseline_log_id")
        .select("threshold", "log_id", "template_id")
    )
    medoids = clusters.filter("verdict = 'MFG'").select("threshold", F.col("medoid_log_id").alias("log_id")).distinct()
    anywhere = medoids.join(plain, "log_id").select("threshold", "template_id").distinct()
    # only templates that the abnormal log has itself can matter to its paths
    every = (
        abnormal.filter("baseline_log_id is null").select("threshold", "log_id").join(plain, "log_id")
        .join(anywhere, ["threshold", "template_id"], "left_semi").select("threshold", "log_id", "template_id")
    )
    return own.unionByName(every)


# -- what difflogs of a cluster share -------------------------------------------------------

def _keys(difflog_clusters: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that name a difflog cluster and those that name a difflog; clusters of one analysis may leave out its thresholds."""
    thresholds = [c for c in ("threshold", "diff_threshold") if c in difflog_clusters.columns]
    return [*thresholds, "cluster_id"], [*thresholds[:1], "log_id"]


def common_edges(difflog_clusters: DataFrame, difflog: DataFrame) -> DataFrame:
    """Transitions that are missing in every log of a difflog cluster."""
    group, log = _keys(difflog_clusters)
    members = difflog_clusters.select(*group, "log_id", "size")
    return (
        members.join(difflog.select(*log, "src", "dst").distinct(), log)
        .groupBy(*group, "src", "dst").agg(F.count(F.lit(1)).alias("n_logs"), F.max("size").alias("_size"))
        .filter("n_logs = _size").drop("_size")
    )


def common_paths(difflog_clusters: DataFrame, difflog: DataFrame, paths: DataFrame) -> DataFrame:
    """Common sequences of a difflog cluster: the paths of its smallest difflog, cut to runs of
    common transitions."""
    group, log = _keys(difflog_clusters)
    length = paths.groupBy(*log).agg(F.sum(F.size("path")).alias("_length"))
    pivots = difflog_clusters.select(*group, "log_id").join(length, log).groupBy(*group).agg(
        F.min_by("log_id", F.struct("_length", "log_id")).alias("log_id")
    )
    steps = (
        pivots.join(paths.select(*log, "path_id", "path"), log)
        .select(*group, "log_id", "path_id", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("step"))
        .select(*group, "log_id", "path_id", "step",
                F.element_at("path", F.col("step")).alias("src"), F.element_at("path", F.col("step") + 1).alias("dst"))
    )
    kept = steps.join(common_edges(difflog_clusters, difflog), [*group, "src", "dst"], "left_semi")
    along = Window.partitionBy(*group, "log_id", "path_id").orderBy("step")  # one path, at most one step per template
    runs = kept.withColumn("_run", F.col("step") - F.row_number().over(along))
    return (
        runs.groupBy(*group, "log_id", "path_id", "_run")
        .agg(F.array_sort(F.collect_list(F.struct("step", "src", "dst"))).alias("_edges"))
        .select(
            *group,
            F.concat(F.array(F.col("_edges")[0]["src"]), F.transform("_edges", lambda e: e["dst"])).alias("path"),
        ).distinct()
    )


def detection_counts(abnormal: DataFrame, labelled: DataFrame, thresholds: list[float]) -> DataFrame:
    """True and false positives per threshold; ``labelled``: ids of the logs that really are faulty.

    A threshold without any abnormal log has a row with zeros.
    """
    spark = abnormal.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    marked = abnormal.join(labelled.select("log_id").distinct().withColumn("_label", F.lit(True)), "log_id", "left")
    counts = marked.groupBy("threshold").agg(
        F.count_if(F.col("_label").isNotNull()).alias("true_positive"),
        F.count_if(F.col("_label").isNull()).alias("false_positive"),
    )
    zero = F.lit(0).cast("bigint")
    return wanted.join(counts, "threshold", "left").select(
        "threshold", F.coalesce("true_positive", zero).alias("true_positive"),
        F.coalesce("false_positive", zero).alias("false_positive"),
    )
