"""Divisive two-medoid clustering of log vectors.

Logs with the same vector are one weighted pattern. A cluster is split as long as its
diameter is above the smallest requested threshold; all thresholds are answered from the one
tree. Open clusters of a level are handled together. A cluster with few patterns is finished,
whole subtree at a time, inside one task; a larger one is split by joins and by the block
visits of ``sets``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrends.functions.vectors import set_distance
from logtrends.operators import sets
from logtrends.operators.vectors import patterns
from logtrends.session import cut_lineage

PATTERNS_PER_TASK = 2_000
NO_PARENT = 2**31 - 1
_TREE = (
    "node_id string, pattern_id string, diameter bigint, parent_diameter bigint, medoid_log_id string, "
    "n_logs bigint, n_patterns bigint"
)


# -- small clusters -------------------------------------------------------------------------

def split_small(d: np.ndarray, weight: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of ``members`` (sorted by vector) around two medoids.

    Start: the pattern farthest from the first one, and the one farthest from that. Then the
    second and after it the first medoid is replaced by the member of its part that lowers
    the weighted cost most. Ties go to the smaller vector.
    """
    dm, w = d[np.ix_(members, members)], weight[members]
    one = int(dm[0].argmax())
    two = int(dm[one].argmax())
    closer = dm[one] < dm[two]
    first, second = np.flatnonzero(closer), np.flatnonzero(~closer)

    def best(candidates: np.ndarray, kept: int, current: int) -> int:
        costs = np.minimum(dm[candidates], dm[kept][None, :]) @ w
        cost_now = np.minimum(dm[current], dm[kept]) @ w
        i = int(costs.argmin())
        return int(candidates[i]) if costs[i] < cost_now else current

    two = best(second, one, two)
    one = best(first, two, one)
    closer = dm[one] < dm[two]
    return members[closer], members[~closer]


def _finish_subtree(floors: tuple[int, ...]):
    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = [tuple(v) for v in pdf["template_ids"]]
        order = sorted(range(len(vectors)), key=lambda i: vectors[i])
        names = pdf["pattern_id"].to_numpy()[order]
        weight = pdf["weight"].to_numpy()[order].astype(np.int64)
        ordered = [vectors[i] for i in order]
        d = sets.distance_matrix(ordered, ordered)
        out: list[tuple] = []
        todo = [(np.arange(len(ordered)), int(pdf["parent_diameter"].iloc[0]))]
        while todo:
            members, above = todo.pop()
            inside = d[np.ix_(members, members)]
            diameter = int(inside.max())
            if any(diameter <= t < above for t in floors):
                total = inside @ weight[members]
                medoid = min(names[m] for m, c in zip(members, total) if c == total.min())
                node, n_logs = min(names[members]), int(weight[members].sum())
                out += [(node, names[m], diameter, above, medoid, n_logs, len(members)) for m in members]
            if diameter > floors[0]:
                todo += [(part, diameter) for part in split_small(d, weight, members)]
        columns = [c.split(" ")[0] for c in _TREE.split(", ")]
        return pd.DataFrame(out, columns=columns)

    return finish


# -- large clusters -------------------------------------------------------------------------

def _node_rows(nodes: DataFrame) -> DataFrame:
    """Rows of whole nodes; the medoid has the smallest weighted sum of distances.

    The sum needs no pairs: over a cluster it is W|a| + sum of all sizes - 2 * (weight of the
    vectors that hold an element, added over the elements of a).
    """
    per_node = nodes.groupBy("cluster_id").agg(
        F.sum("weight").alias("n_logs"), F.count(F.lit(1)).alias("n_patterns"), F.min("pattern_id").alias("node_id")
    )
    elements = nodes.select("cluster_id", "pattern_id", "weight", F.explode("items").alias("item"))
    held = elements.groupBy("cluster_id", "item").agg(F.sum("weight").alias("held"))
    overlap = elements.join(held, ["cluster_id", "item"]).groupBy("cluster_id", "pattern_id").agg(F.sum("held").alias("overlap"))
    # the sum of all sizes is the same for every member and is left out
    cost = F.col("n_logs") * F.size("items") - 2 * F.coalesce("overlap", F.lit(0))
    medoids = (
        nodes.join(overlap, ["cluster_id", "pattern_id"], "left").join(per_node.select("cluster_id", "n_logs"), "cluster_id")
        .groupBy("cluster_id").agg(F.min_by("pattern_id", F.struct(cost, F.col("pattern_id"))).alias("medoid_log_id"))
    )
    return (
        nodes.join(per_node, "cluster_id").join(medoids, "cluster_id")
        .select("node_id", "pattern_id", "diameter", "parent_diameter", "medoid_log_id", "n_logs", "n_patterns")
    )


def _gains_between(candidates: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """What each candidate saves the members, whose distances to the kept medoid are known."""
    d = sets.distance_matrix(candidates["items"].tolist(), members["items"].tolist())
    saved = np.maximum(members["kept_distance"].to_numpy()[None, :] - d, 0)
    return pd.DataFrame({
        "cluster_id": candidates["cluster_id"].to_numpy(),
        "pattern_id": candidates["pattern_id"].to_numpy(),
        "items": candidates["items"].to_numpy(),
        "gain": saved @ members["weight"].to_numpy(),
    })


def useful_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of a block with candidates and a block with a member that may be nearer to one of them than to the kept medoid."""
    return sets.block_pairs(blocks).filter("a_candidates > 0 and at_least < b_kept")


def _improve(nodes: DataFrame, part: str, kept: str, current: str) -> DataFrame:
    """Per cluster the medoid that replaces ``current``: a member of ``part`` (a condition)
    with the smallest cost beside the medoid ``kept``, or ``current`` if none is cheaper.

    Beside ``kept`` a candidate costs what ``kept`` alone costs less what it saves, and it saves nothing in a block whose members are all nearer to
    ``kept`` than the pivots allow the candidate to be: such pairs of blocks are not visited.
    """
    members = nodes.select(
        "cluster_id", "block", "items", "weight", "dp", "dq", F.expr(part).alias("_part"), "pattern_id",
        set_distance(F.col("items"), F.col(kept)).alias("kept_distance"), set_distance(F.col("items"), F.col(current)).alias("now_distance"), kept, current)
    blocks = sets.block_table(members, F.max("kept_distance").alias("kept"), F.count_if("_part").alias("candidates"))
    gains = (
        sets.visit_pairs(members.filter("_part").select("cluster_id", "block", "items", "pattern_id"),
                         members.select("cluster_id", "block", "items", "weight", "kept_distance"), useful_pairs(blocks), _gains_between,
                         "cluster_id string, pattern_id string, items array<bigint>, gain bigint")
        .groupBy("cluster_id", "pattern_id").agg(F.sum("gain").alias("gain"), F.first("items").alias("items"))
    )
    now = members.groupBy("cluster_id").agg(
        F.sum(F.col("weight") * F.col("kept_distance")).alias("alone"),
        F.sum(F.col("weight") * F.least("kept_distance", "now_distance")).alias("cost_now"), F.first(current).alias("_current"))
    best = gains.groupBy("cluster_id").agg(
        F.max("gain").alias("best_gain"), F.min_by("items", F.struct(-F.col("gain"), F.col("items"))).alias("_best"))
    cheaper = F.col("alone") - F.col("best_gain") < F.col("cost_now")
    return now.join(best, "cluster_id", "left").select("cluster_id", F.when(cheaper, F.col("_best")).otherwise(F.col("_current")).alias(current))


def _split_large(nodes: DataFrame, limit: int) -> DataFrame:
    """Split every cluster in two; same rules as :func:`split_small`."""
    smallest = nodes.groupBy("cluster_id").agg(F.min("items").alias("_p"))
    a = nodes.join(smallest, "cluster_id").withColumn("_d", set_distance(F.col("items"), F.col("_p")))
    ones = a.groupBy("cluster_id").agg(F.min_by("items", F.struct(-F.col("_d"), F.col("items"))).alias("one"))
    b = nodes.join(ones, "cluster_id").withColumn("dp", set_distance(F.col("items"), F.col("one")))
    twos = b.groupBy("cluster_id").agg(F.min_by("items", F.struct(-F.col("dp"), F.col("items"))).alias("two"))
    b = b.join(twos, "cluster_id").withColumn("dq", set_distance(F.col("items"), F.col("two")))
    b = cut_lineage(sets.into_blocks(b.withColumn("_closer", F.col("dp") < F.col("dq")), limit))
    c = cut_lineage(b.drop("two").join(_improve(b, "not _closer", "one", "two"), "cluster_id"))
    e = c.drop("one").join(_improve(c, "_closer", "two", "one"), "cluster_id")
    closer = set_distance(F.col("items"), F.col("one")) < set_distance(F.col("items"), F.col("two"))
    halves = cut_lineage(e.select(
        "cluster_id", closer.alias("_half"), "pattern_id", "items", "weight", F.col("diameter").alias("parent_diameter")
    ))
    # a part is named after its smallest pattern
    names = halves.groupBy("cluster_id", "_half").agg(F.min("pattern_id").alias("_name"))
    return halves.join(names, ["cluster_id", "_half"]).select(
        F.col("_name").alias("cluster_id"), "pattern_id", "items", "weight", "parent_diameter"
    )


def _equal_vectors(distinct: DataFrame) -> DataFrame:
    """One node per distinct vector."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return distinct.select(
        F.col("pattern_id").alias("node_id"), "pattern_id", zero.alias("diameter"), F.col("parent_diameter"),
        F.col("pattern_id").alias("medoid_log_id"), F.col("weight").alias("n_logs"), one.alias("n_patterns"))


# -- public ---------------------------------------------------------------------------------

def cluster_tree(vectors: DataFrame, thresholds: list[float], patterns_per_task: int = PATTERNS_PER_TASK) -> DataFrame:
    """Nodes of the cluster tree that are a cluster at one of the thresholds, one row per
    node and pattern.

    Distances are whole numbers, so only the whole part of a threshold matters. A node is a
    cluster at t when its diameter is at most t and its parent's is above t. Below 1 the clusters are the
    groups of equal vectors: no tree is built, and ``parent_diameter`` is not worked out.
    """
    floors = tuple(sorted({math.floor(t) for t in thresholds if t > 0}))
    if not floors:
        raise ValueError("at least one threshold above 0 is needed")
    open_ = patterns(vectors).select(
        F.lit("").alias("cluster_id"), "pattern_id",
        F.col("template_ids").cast("array<bigint>").alias("items"), F.col("weight").cast("bigint").alias("weight"),
        F.lit(NO_PARENT).cast("bigint").alias("parent_diameter"),
    )
    if floors == (0,):
        return _equal_vectors(open_)
    finish = _finish_subtree(floors)
    parts: list[DataFrame] = []
    while True:
        open_ = cut_lineage(open_)
        small, large = sets.split_by_size(open_, patterns_per_task)
        parts.append(
            small.withColumnRenamed("items", "template_ids").groupBy("cluster_id").applyInPandas(finish, _TREE)
        )
        if large is None:
            break
        sized = cut_lineage(large.join(sets.diameters(large, patterns_per_task), "cluster_id"))
        is_cut = " or ".join(f"(diameter <= {t} and parent_diameter > {t})" for t in floors)
        parts.append(cut_lineage(_node_rows(sized.filter(is_cut))))
        splitting = sized.filter(F.col("diameter") > floors[0])
        if splitting.isEmpty():
            break
        open_ = _split_large(splitting.drop("parent_diameter"), patterns_per_task)
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.unionByName(part)
    return tree


def cut_tree(tree: DataFrame, vectors: DataFrame, thresholds: list[float]) -> DataFrame:
    """Cluster of every log at every threshold. ``cluster_id`` is the smallest log of the cluster."""
    wanted = F.array(*[F.lit(float(t)) for t in thresholds if t > 0])
    valid = F.filter(wanted, lambda t: (F.col("diameter") <= t) & (t < F.col("parent_diameter")))
    cut = tree.select("*", F.explode(valid).alias("threshold"))
    names = vectors.join(patterns(vectors).select("template_ids", "pattern_id"), "template_ids").select("log_id", "pattern_id")
    return names.join(cut, "pattern_id").select(
        "threshold", F.col("node_id").alias("cluster_id"), "log_id", "medoid_log_id", "diameter",
        F.col("n_logs").alias("size"),
    )


def cluster_verdict(clusters: DataFrame, small: int = 4) -> DataFrame:
    """``AA`` (all abnormal) for clusters of at most ``small`` logs, else ``MFG`` (graph analysis)."""
    return clusters.withColumn("verdict", F.when(F.col("size") <= small, F.lit("AA")).otherwise(F.lit("MFG")))


def cluster_diameter(clusters: DataFrame, vectors: DataFrame, sets_per_task: int = sets.SETS_PER_TASK) -> DataFrame:
    """Largest distance between the vectors of two logs of the same cluster."""
    distinct = (
        clusters.select("cluster_id", "log_id").join(vectors, "log_id")
        .select("cluster_id", F.col("template_ids").cast("array<bigint>").alias("items")).distinct()
    )
    return sets.diameters(distinct, sets_per_task)
