"""Farthest and nearest neighbours among distinct sets of a cluster.

Distances are symmetric-difference sizes. Nothing here writes one row per pair: a cluster is
cut into blocks of bounded size, a task holds two blocks as 0/1 matrices and returns only the
extreme value per block or per set. Results are exact.

Farthest: which block pairs have to be visited follows from the triangle inequality: every block knows the range of its distances to two
pivots, and a pair is skipped when these ranges show that it cannot change the result.

Nearest: the own block gives a bound b. A set at a distance below b lacks less than b items of this one, so it holds one of any b of them:
only the sets that share one of the b rarest items are looked up, in an inverted index, and only those whose size differs by less than b.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.functions.vectors import set_distance
from logtrends.session import cut_lineage

SETS_PER_TASK = 2_000
_SHELLS_PER_PIVOT = 16
_COLUMNS_AT_ONCE = 4_096
_SALTS = 32


def distance_matrix(left: list, right: list) -> np.ndarray:
    """Symmetric-difference sizes between two lists of sets (arrays without repeats)."""
    n_left = len(left)
    sizes = np.array([len(s) for s in [*left, *right]], dtype=np.int64)
    shared = np.zeros((n_left, len(right)), dtype=np.int64)
    if sizes.sum():
        rows = np.repeat(np.arange(len(sizes)), sizes)
        _, codes = np.unique(np.concatenate([np.asarray(s) for s in [*left, *right] if len(s)]), return_inverse=True)
        for start in range(0, int(codes.max()) + 1, _COLUMNS_AT_ONCE):
            part = (codes >= start) & (codes < start + _COLUMNS_AT_ONCE)
            ones = np.zeros((len(sizes), _COLUMNS_AT_ONCE if codes.max() >= _COLUMNS_AT_ONCE else int(codes.max()) + 1),
                            dtype=np.float32)
            ones[rows[part], codes[part] - start] = 1
            shared += np.rint(ones[:n_left] @ ones[n_left:].T).astype(np.int64)
    return sizes[:n_left, None] + sizes[None, n_left:] - 2 * shared


# -- blocks ---------------------------------------------------------------------------------

def split_by_size(distinct: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Sets of clusters that fit into one task, and of those that do not (None if there are none)."""
    sizes = distinct.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    if sizes.filter(F.col("_n") > limit).isEmpty():
        return distinct, None
    large = sizes.filter(F.col("_n") > limit).select("cluster_id")
    return distinct.join(large, "cluster_id", "left_anti"), distinct.join(large, "cluster_id", "left_semi")


def with_pivots(large: DataFrame) -> DataFrame:
    """Distances to the smallest set (``dp``) and to the set farthest from it (``dq``)."""
    first = large.groupBy("cluster_id").agg(
        F.min_by("items", F.struct(F.size("items"), F.col("items"))).alias("_p")
    )
    near = large.join(first, "cluster_id").withColumn("dp", set_distance(F.col("items"), F.col("_p"))).drop("_p")
    second = near.groupBy("cluster_id").agg(F.min_by("items", F.struct(-F.col("dp"), F.col("items"))).alias("_q"))
    return near.join(second, "cluster_id").withColumn("dq", set_distance(F.col("items"), F.col("_q"))).drop("_q")


def into_blocks(pivoted: DataFrame, limit: int) -> DataFrame:
    """Blocks of about ``limit`` sets with similar distances to both pivots."""
    reach = pivoted.groupBy("cluster_id").agg(
        F.ceil((F.max("dp") + 1) / _SHELLS_PER_PIVOT).alias("_wp"), F.ceil((F.max("dq") + 1) / _SHELLS_PER_PIVOT).alias("_wq")
    )
    shelled = pivoted.join(reach, "cluster_id").withColumn(
        "_shell", F.floor(F.col("dp") / F.col("_wp")) * _SHELLS_PER_PIVOT + F.floor(F.col("dq") / F.col("_wq"))
    ).drop("_wp", "_wq")
    slices = shelled.groupBy("cluster_id", "_shell").agg(F.ceil(F.count(F.lit(1)) / limit).alias("_slices"))
    return shelled.join(slices, ["cluster_id", "_shell"]).withColumn(
        "block", F.concat_ws("/", "_shell", F.pmod(F.xxhash64("items"), F.col("_slices")))
    ).drop("_shell", "_slices")


def block_table(blocked: DataFrame, *extra: Column) -> DataFrame:
    return blocked.groupBy("cluster_id", "block").agg(
        F.min("dp").alias("p_lo"), F.max("dp").alias("p_hi"), F.min("dq").alias("q_lo"), F.max("dq").alias("q_hi"), *extra
    )


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Ordered pairs of blocks of a cluster with bounds for the distances between them."""
    def side(name: str) -> DataFrame:
        return blocks.select("cluster_id", *[F.col(c).alias(f"{name}_{c}") for c in blocks.columns if c != "cluster_id"])

    def gap(p: str) -> Column:
        return F.greatest(F.col(f"a_{p}_lo") - F.col(f"b_{p}_hi"), F.col(f"b_{p}_lo") - F.col(f"a_{p}_hi"), F.lit(0))

    # a cluster's blocks meet in several tasks
    salted = side("a").withColumn("_salt", F.pmod(F.xxhash64("a_block"), F.lit(_SALTS)).cast("int"))
    every = side("b").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(every, ["cluster_id", "_salt"]).drop("_salt").withColumn("at_least", F.greatest(gap("p"), gap("q"))).withColumn(
        "at_most", F.least(F.col("a_p_hi") + F.col("b_p_hi"), F.col("a_q_hi") + F.col("b_q_hi"))
    )


def visit_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(sets of block a, sets of block b)`` for every chosen pair of blocks."""
    key = ["cluster_id", "a_block", "b_block"]
    chosen = pairs.select(*key)
    left = chosen.join(a.withColumnRenamed("block", "a_block"), ["cluster_id", "a_block"])
    right = chosen.join(b.withColumnRenamed("block", "b_block"), ["cluster_id", "b_block"])
    # both sides come from the same tables: new columns keep them apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(fn, schema)


# -- diameter -------------------------------------------------------------------------------

def _largest_inside(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = pdf["items"].tolist()
    return pd.DataFrame({"cluster_id": [pdf["cluster_id"].iloc[0]], "diameter": [int(distance_matrix(sets, sets).max())]})


def _largest_between(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    d = distance_matrix(left["items"].tolist(), right["items"].tolist())
    return pd.DataFrame({"cluster_id": [left["cluster_id"].iloc[0]], "diameter": [int(d.max())]})


def diameters(distinct: DataFrame, limit: int = SETS_PER_TASK) -> DataFrame:
    """Largest distance inside each cluster; input ``cluster_id, items``, one row per distinct set."""
    schema = "cluster_id string, diameter bigint"
    distinct = cut_lineage(distinct.select("cluster_id", "items"))
    small, large = split_by_size(distinct, limit)
    result = small.groupBy("cluster_id").applyInPandas(_largest_inside, schema)
    if large is None:
        return result
    blocked = cut_lineage(into_blocks(with_pivots(large), limit))
    blocks = block_table(blocked)
    known = blocks.groupBy("cluster_id").agg(F.greatest(F.max("p_hi"), F.max("q_hi")).alias("diameter"))
    pairs = block_pairs(blocks).filter("a_block <= b_block").join(known, "cluster_id").filter("at_most > diameter")
    sets = blocked.select("cluster_id", "block", "items")
    found = visit_pairs(sets, sets, pairs, _largest_between, schema)
    both = known.unionByName(found).groupBy("cluster_id").agg(F.max("diameter").alias("diameter"))
    return result.unionByName(both)


# -- nearest neighbour ----------------------------------------------------------------------

_NEAREST = "cluster_id string, items array<bigint>, nn bigint"


def _nearest_rows(pdf: pd.DataFrame, nearest: np.ndarray, known: np.ndarray) -> pd.DataFrame:
    values = pd.array(np.where(known, nearest, 0), dtype="Int64")
    values[~known] = pd.NA
    return pd.DataFrame({"cluster_id": pdf["cluster_id"].to_numpy(), "items": pdf["items"].to_numpy(), "nn": values})


def _nearest_inside(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = pdf["items"].tolist()
    d = distance_matrix(sets, sets)
    far = np.iinfo(np.int64).max
    np.fill_diagonal(d, far)
    nearest = np.where(pdf["weight"].to_numpy() > 1, 0, d.min(axis=1))
    return _nearest_rows(pdf, nearest, nearest != far)


def nearest_listed(probes: list[tuple[int, np.ndarray, int]], listed: list[tuple[int, np.ndarray]], limit: int = 512) -> tuple[dict[int, int], int]:
    """Of sets (id, items, bound) that look up an item and the sets (id, items) that hold it: (nearest distance below the bound by id, pairs looked at).

    Both sides are taken in order of size, so that a piece meets only the pieces of fitting sizes.
    """
    probes, listed = sorted(probes, key=lambda p: len(p[1])), sorted(listed, key=lambda p: len(p[1]))
    sizes = np.array([len(items) for _, items in listed])
    found: dict[int, int] = {}
    visited = 0
    for at in range(0, len(probes), limit):
        some = probes[at : at + limit]
        widest = max(bound for _, _, bound in some)
        low = int(np.searchsorted(sizes, len(some[0][1]) - widest, "right"))
        high = int(np.searchsorted(sizes, len(some[-1][1]) + widest, "left"))
        own, bounds = np.array([i for i, _, _ in some]), np.array([b for _, _, b in some])
        for start in range(low, high, limit):
            others = listed[start : min(start + limit, high)]
            d = distance_matrix([items for _, items, _ in some], [items for _, items in others])
            visited += d.size
            d[own[:, None] == np.array([i for i, _ in others])[None, :]] = 2**62
            for i, least in zip(own[(low_ := d.min(axis=1)) < bounds].tolist(), low_[low_ < bounds].tolist(), strict=True):
                found[i] = min(least, found.get(i, least))
    return found, visited


def _look_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """All look-ups of one task: per set the nearest of those that share the looked-up items."""
    by_item: dict[tuple, tuple[list, list]] = {}
    for cluster, item, sid, items, bound in zip(pdf["cluster_id"], pdf["item"], pdf["sid"], pdf["items"], pdf["bound"], strict=True):
        probes, listed = by_item.setdefault((cluster, item), ([], []))
        if bound >= 0:
            probes.append((sid, items, bound))
        else:
            listed.append((sid, items))
    best: dict[int, int] = {}
    for probes, listed in by_item.values():
        for sid, d in nearest_listed(probes, listed)[0].items():
            best[sid] = min(d, best.get(sid, d))
    return pd.DataFrame({"sid": pd.Series(list(best), dtype="int64"), "nn": pd.Series(list(best.values()), dtype="int64")})


def rarest_items(bounded: DataFrame) -> DataFrame:
    """(cluster_id, sid, item): of every set the ``bound`` items that the fewest sets of its cluster hold; input cluster_id, sid, items, bound."""
    held = bounded.select("cluster_id", "sid", "bound", F.explode("items").alias("item"))
    count = held.groupBy("cluster_id", "item").agg(F.count(F.lit(1)).alias("n"))
    ranked = held.join(count, ["cluster_id", "item"]).groupBy("cluster_id", "sid").agg(
        F.first("bound").alias("bound"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))  # the items of one set
    kept = F.slice("ranked", F.lit(1), F.greatest(F.least(F.col("bound"), F.size("ranked").cast("long")), F.lit(0)).cast("int"))
    return ranked.select("cluster_id", "sid", F.explode(kept).alias("r")).select("cluster_id", "sid", F.col("r.item").alias("item"))


def nearest_by_index(bounded: DataFrame, limit: int) -> DataFrame:
    """(sid, nn): distances below ``bound``; input cluster_id, sid, items, bound, every cluster large.

    A popular item is looked up by many sets and held by many: both sides are dealt into parts of about ``limit`` sets, which meet pairwise.
    """
    asked = cut_lineage(rarest_items(bounded).join(bounded, ["cluster_id", "sid"]))
    wanted = asked.select("cluster_id", "item").distinct()
    listed = bounded.select("cluster_id", "sid", "items", F.explode("items").alias("item")).join(wanted, ["cluster_id", "item"], "left_semi")
    parts = asked.groupBy("cluster_id", "item").agg(F.count(F.lit(1)).alias("p")).join(
        listed.groupBy("cluster_id", "item").agg(F.count(F.lit(1)).alias("l")), ["cluster_id", "item"]).select(
        "cluster_id", "item", F.ceil(F.col("p") / limit).cast("int").alias("p"), F.ceil(F.col("l") / limit).cast("int").alias("l"), (F.col("p") + F.col("l")).alias("n"))
    parts = cut_lineage(parts)
    total = parts.agg(F.sum("n")).first()[0] or 0
    tasks = max(bounded.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * limit)))
    part = F.pmod(F.xxhash64("sid"), F.col("p")).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("l")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = asked.join(parts, ["cluster_id", "item"]).select("cluster_id", "item", "sid", "items", "bound", part.alias("i"), F.explode(upto("l")).alias("j"), "p", "l")
    right = listed.join(parts, ["cluster_id", "item"]).select(
        "cluster_id", "item", "sid", "items", F.lit(-1).cast("long").alias("bound"), F.explode(upto("p")).alias("i"), own.alias("j"), "p", "l")
    rows = left.unionByName(right)
    alone = (F.col("p") == 1) & (F.col("l") == 1)
    rows = rows.select("cluster_id", "item", "sid", "items", "bound", F.when(alone, F.pmod(F.xxhash64("cluster_id", "item"), F.lit(tasks))).alias("shared"),
                       F.when(~alone, F.struct("cluster_id", "item", "i", "j")).alias("large"))
    return rows.groupBy("shared", "large").applyInPandas(_look_up, "sid long, nn long").groupBy("sid").agg(F.min("nn").alias("nn"))


def nearest(distinct: DataFrame, limit: int = SETS_PER_TASK) -> DataFrame:
    """Distance of each set to the nearest other one of its cluster.

    Input ``cluster_id, items, weight``; a set with weight above 1 has a twin at distance 0.
    ``nn`` is null for a set that is alone.
    """
    distinct = cut_lineage(distinct.select("cluster_id", "items", F.col("weight").cast("bigint").alias("weight")))
    small, large = split_by_size(distinct, limit)
    result = small.groupBy("cluster_id").applyInPandas(_nearest_inside, _NEAREST)
    if large is None:
        return result
    blocked = cut_lineage(into_blocks(with_pivots(large), limit))
    inside = (
        blocked.withColumn("_cluster", F.col("cluster_id"))
        .groupBy("_cluster", "block").applyInPandas(lambda pdf: _nearest_inside(pdf), _NEAREST)
    )
    # sets that share nothing are as far apart as both are large: the two smallest sets of a cluster bound what the index does not see
    smallest = blocked.select("cluster_id", F.size("items").cast("long").alias("n")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("n"))).filter("rank <= 2").groupBy("cluster_id").agg(
        F.min("n").alias("_one"), F.max("n").alias("_two"))
    own = F.size("items").cast("long")
    apart = own + F.when(own == F.col("_one"), F.col("_two")).otherwise(F.col("_one"))
    # a pivot itself is at distance 0 from itself, so its distance is no bound for it
    bounded = blocked.join(inside, ["cluster_id", "items"]).join(smallest, "cluster_id").select(
        "cluster_id", "items", F.monotonically_increasing_id().alias("sid"),
        F.least("nn", apart, *[F.when(F.col(c) > 0, F.col(c).cast("long")) for c in ("dp", "dq")]).alias("bound"))
    bounded = cut_lineage(bounded)
    found = nearest_by_index(bounded, limit)
    both = bounded.join(found, "sid", "left").select("cluster_id", "items", F.coalesce("nn", "bound").alias("nn"))
    return result.unionByName(both)
