"""The whole log analysis and the threshold sweep."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.operators import cluster, difflog, graphs, patterns, templates, vectors
from logtrends.session import cut_lineage, store_table

# Thresholds of the sweep, 0.1 to 2.9 in steps of 0.1.
SWEEP = tuple(round(0.1 * i, 1) for i in range(1, 30))


def clusters_at(vectors_: DataFrame, thresholds: list[float], small: int = 4) -> DataFrame:
    """Clusters with verdict at every threshold, from one tree."""
    tree = cluster.cluster_tree(vectors_, thresholds)
    return cluster.cluster_verdict(cluster.cut_tree(tree, vectors_, thresholds), small)


def matched_lines(lines: DataFrame, templates_: DataFrame, policy: str = "most_specific") -> DataFrame:
    """Every line's templates, tested once and stored: ``log_id, line_no, template_ids``."""
    matched = templates.match_sets(lines, templates_, policy)
    return store_table(matched.select("log_id", "line_no", "template_ids"), "matched")


def assigned_lines(matched: DataFrame) -> DataFrame:
    return matched.select("log_id", "line_no", F.col("template_ids")[0].alias("template_id"))


def behaviour(lines: DataFrame, templates_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, nodes and edges of all logs.

    The three tables grow with logs and templates only.
    """
    return behaviour_of(matched_lines(lines, templates_))


def behaviour_of(matched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from stored matches."""
    every = matched.select("log_id", F.explode("template_ids").alias("template_id"))
    vectors_ = cut_lineage(vectors.mav(every))
    steps = cut_lineage(graphs.transitions(assigned_lines(matched)))
    return vectors_, graphs.nodes_of(steps), graphs.edges_of(steps)


def find_abnormal(vectors_: DataFrame, edges: DataFrame, thresholds: list[float], small: int = 4,
                  metric: str = "edges", k: float = 2.0) -> tuple[DataFrame, DataFrame]:
    clusters = cut_lineage(clusters_at(vectors_, thresholds, small))
    return clusters, cut_lineage(difflog.abnormal_logs(clusters, edges, metric, k))


def all_difflog_edges(abnormal: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    return difflog.difflog_edges(abnormal, edges).unionByName(difflog.difflog_edges_all(abnormal, clusters, edges))


def cluster_difflogs(difflog_edges: DataFrame, thresholds: Sequence[float], diff_thresholds: Sequence[float]) -> DataFrame:
    """Difflogs of each threshold regrouped by the templates on their missing transitions, at each ``diff_threshold``.

    The difflogs of a threshold are clustered by themselves: one tree for each threshold, cut at all ``diff_thresholds``.
    """
    vectors_ = cut_lineage(vectors.difflog_mav(difflog_edges))
    found = []
    for t in dict.fromkeys(float(t) for t in thresholds):
        own = vectors_.filter(F.col("threshold") == t).select("log_id", "template_ids")
        cut = cluster.cut_tree(cluster.cluster_tree(own, list(diff_thresholds)), own, list(dict.fromkeys(diff_thresholds)))
        found.append(cut.withColumnRenamed("threshold", "diff_threshold").withColumn("threshold", F.lit(t)))
    return reduce(DataFrame.unionByName, found)


def analyze(lines: DataFrame, templates_: DataFrame | None = None, thresholds: Sequence[float] = (0.5,),
            diff_thresholds: Sequence[float] = (0.5,), small: int = 4, metric: str = "edges", k: float = 2.0) -> dict[str, DataFrame]:
    """From lines to the spans of lines that show the common abnormal sequences.

    Every pair of a threshold and a ``diff_threshold`` is an analysis of its own; both are columns of the results. The lines are
    matched once, and patterns are searched in the stored matches; texts are joined to the spans found.
    """
    if templates_ is None:
        templates_ = cut_lineage(templates.infer_templates(lines))
    matched = matched_lines(lines, templates_)
    vectors_, nodes, edges = behaviour_of(matched)
    clusters, abnormal = find_abnormal(vectors_, edges, list(dict.fromkeys(thresholds)), small, metric, k)
    missing = cut_lineage(all_difflog_edges(abnormal, clusters, edges))
    result = {
        "templates": templates_, "vectors": vectors_, "nodes": nodes, "edges": edges,
        "clusters": clusters, "abnormal": abnormal, "difflog_edges": missing,
    }
    paths = cut_lineage(difflog.difflog_paths(missing, edges, difflog.normal_vertices(abnormal, clusters, nodes)))
    groups = cut_lineage(cluster_difflogs(missing, thresholds, diff_thresholds))
    common = cut_lineage(difflog.common_paths(groups, missing, paths))
    group = ["threshold", "diff_threshold", "cluster_id"]
    named = common.select(*group, F.array_join("path", ">").alias("pattern_id"), "path")
    spans = patterns.pattern_matches(
        # only logs that belong to a difflog cluster are searched
        assigned_lines(matched).join(groups.select("log_id").distinct(), "log_id", "left_semi"),
        named.select("pattern_id", "path").distinct(), with_line_nos=True,
    )
    shown = patterns.with_texts(store_table(spans, "spans"), lines)
    members = groups.select(*group, "log_id")
    matches = shown.join(members, "log_id").join(named.select(*group, "pattern_id"), [*group, "pattern_id"])
    return result | {"difflog_paths": paths, "difflog_clusters": groups, "common_paths": common, "matches": matches}


def sweep(lines: DataFrame, templates_: DataFrame, labelled: DataFrame, thresholds: list[float] = list(SWEEP),
          small: int = 4, k: float = 2.0) -> DataFrame:
    """True and false positives for many thresholds.

    Distances are whole numbers, so thresholds with the same whole part have the same clusters and the same abnormal logs: these are found and counted once for all of them.
    """
    vectors_, _, edges = behaviour(lines, templates_)
    first: dict[int, float] = {}
    tried = [first.setdefault(math.floor(t), t) if t > 0 else t for t in thresholds]
    _, abnormal = find_abnormal(vectors_, edges, list(dict.fromkeys(tried)), small, k=k)
    counts = difflog.detection_counts(abnormal, labelled, list(dict.fromkeys(tried)))
    alike = F.map_from_entries(F.array(*[
        F.struct(F.lit(float(tried_)), F.array(*[F.lit(float(t)) for t, own in zip(thresholds, tried, strict=True) if own == tried_])) for tried_ in dict.fromkeys(tried)]))
    return counts.select(F.explode(alike[F.col("threshold")]).alias("threshold"), "true_positive", "false_positive")


def labelled_by_line(lines: DataFrame, word: str = "error") -> DataFrame:
    """Logs that contain ``word``."""
    return lines.filter(F.col("line").contains(word)).select("log_id").distinct()


def labelled_by_name(lines: DataFrame, word: str = "error") -> DataFrame:
    """Logs whose id contains ``word``."""
    return lines.filter(F.col("log_id").contains(word)).select("log_id").distinct()
