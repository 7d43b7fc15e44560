"""Positions, graphs, set distances, clusters and outliers against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtrends.operators import cluster, graphs, order, sets, vectors


def assigned_df(spark, logs):
    """{log: [template or None, ...]}; None is a line without template."""
    data = [(log, i, t) for log, ts in logs.items() for i, t in enumerate(ts, 1) if t is not None]
    return spark.createDataFrame(data, "log_id string, line_no bigint, template_id int")


def random_logs(seed, n=40, longest=12, kinds=5):
    rng = random.Random(seed)
    return {f"log{i:03d}": [rng.choice([*range(kinds), None]) for _ in range(rng.randint(1, longest))] for i in range(n)}


def plain_edges(ts):
    known = [t for t in ts if t is not None]
    return set(zip(known, known[1:]))


@pytest.mark.parametrize("per_block", [1, 3, 1000])
def test_next_and_edges(spark, rows, per_block):
    logs = random_logs(3)
    found = graphs.mfg_edges(assigned_df(spark, logs), per_block)
    expected = sorted((log, *e) for log, ts in logs.items() for e in plain_edges(ts))
    assert rows(found, "log_id", "src", "dst") == sorted(expected, key=repr)
    assert rows(found.select("log_id", "src", "dst", "first_pos", "n")) == rows(
        graphs.mfg_edges(assigned_df(spark, logs).repartition(5)).select("log_id", "src", "dst", "first_pos", "n")
    )


def test_edges_golden(spark, rows):
    found = graphs.mfg_edges(assigned_df(spark, {"gap": [1, None, 2], "three": [1, 2, 3], "one": [4]}))
    assert rows(found, "log_id", "src", "dst") == [("gap", 1, 2), ("three", 1, 2), ("three", 2, 3)]
    nodes = graphs.mfg_nodes(assigned_df(spark, {"one": [4]}))
    assert rows(nodes) == [("one", 4, 1)]


def test_nodes_from_transitions(spark, rows):
    df = assigned_df(spark, random_logs(5))
    assert rows(graphs.nodes_of(graphs.transitions(df, 2))) == rows(graphs.mfg_nodes(df))


def test_number_rows_with_null_key(spark, rows):
    df = spark.createDataFrame([("a", 5), ("a", 1), (None, 2), (None, None)], "k string, v bigint")
    found = order.number_rows(df, ["k"], ["v"], F.floor(F.col("v") / 2), "n")
    assert rows(found) == sorted([("a", 1, 1), ("a", 5, 2), (None, None, 1), (None, 2, 2)], key=repr)


def test_number_all(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    found = order.number_all(df, [F.col("v")], "n").collect()
    assert all(r.v == r.n for r in found) and len(found) == 1000


def random_sets(seed, clusters=4, n=30, universe=9):
    rng = random.Random(seed)
    out = {}
    for c in range(clusters):
        out[f"c{c}"] = [sorted(rng.sample(range(universe), rng.randint(0, universe))) for _ in range(n if c else 1)]
    return out


def sets_df(spark, data):
    flat = [(c, f"{c}-{i}", s) for c, ss in data.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(flat, "cluster_id string, set_id string, items array<bigint>")
    return df.groupBy("cluster_id", "items").agg(F.min("set_id").alias("set_id"), F.count(F.lit(1)).alias("weight"))


@pytest.mark.parametrize("seed,limit", [(1, 1000), (1, 4), (2, 1)])
def test_diameter_and_nearest(spark, rows, seed, limit):
    data = random_sets(seed)
    d = lambda a, b: len(set(a) ^ set(b))
    found = dict(rows(sets.diameters(sets_df(spark, data), limit)))
    assert found == {c: max(d(a, b) for a in ss for b in ss) for c, ss in data.items()}
    nearest = {(r.cluster_id, tuple(r["items"])): r.nn for r in sets.nearest(sets_df(spark, data), limit).collect()}
    for c, ss in data.items():
        for i, a in enumerate(ss):
            others = [d(a, b) for j, b in enumerate(ss) if j != i]
            assert nearest[c, tuple(a)] == (min(others) if others else None)


def test_nearest_of_skewed_sets(spark):
    """Items of very different popularity, one of them in nearly every set; many look-ups per popular item, in parts of 8 sets."""
    rng = random.Random(9)
    weights = [1 / (i + 1) for i in range(300)]
    data = {"c": [sorted({0, *rng.choices(range(300), weights, k=rng.randint(3, 25))}) for _ in range(150)] + [[], [299]], "d": [[1, 2], [3]], "e": [[5]]}
    nearest = {(r.cluster_id, tuple(r["items"])): r.nn for r in sets.nearest(sets_df(spark, data), 8).collect()}
    for c, ss in data.items():
        for i, a in enumerate(ss):
            others = [len(set(a) ^ set(b)) for j, b in enumerate(ss) if j != i]
            assert nearest[c, tuple(a)] == (min(others) if others else None)


def test_few_pairs_are_looked_at():
    """Sets with near twins among many strangers: looking up rare items visits a small share of all pairs."""
    rng = random.Random(10)
    weights = [1 / (i + 1) for i in range(2000)]
    base = [sorted(set(rng.choices(range(2000), weights, k=30))) for _ in range(400)]
    all_sets = base + [sorted(set(s) ^ {rng.randrange(2000)}) for s in base]
    count = {}
    for s in all_sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    by_item, visited, found = {}, 0, {}
    for i, s in enumerate(all_sets):
        for x in s:
            by_item.setdefault(x, ([], []))[1].append((i, s))
        for x in sorted(s, key=lambda x: (count[x], x))[:4]:
            by_item[x][0].append((i, s, 4))
    for probes, listed in by_item.values():
        some, pairs = sets.nearest_listed(probes, listed)
        visited += pairs
        for i, d in some.items():
            found[i] = min(d, found.get(i, d))
    want = [min(len(set(a) ^ set(b)) for j, b in enumerate(all_sets) if j != i) for i, a in enumerate(all_sets)]
    assert all(found.get(i, 4) == min(4, w) for i, w in enumerate(want)) and visited < len(all_sets) ** 2 / 10


def test_distance_matrix_many_columns(monkeypatch):
    rng = random.Random(4)
    a, b = [[sorted(rng.sample(range(40), rng.randint(0, 20))) for _ in range(8)] for _ in range(2)]
    expected = [[len(set(x) ^ set(y)) for y in b] for x in a]
    for at_once in (3, 4096):
        monkeypatch.setattr(sets, "_COLUMNS_AT_ONCE", at_once)
        assert sets.distance_matrix(a, b).tolist() == expected


def test_edge_and_out_degree_metric(spark, rows):
    edges = graphs.mfg_edges(assigned_df(spark, {"a": [1, 2], "b": [1, 3]}))
    clusters = spark.createDataFrame([("c", "a"), ("c", "b")], "cluster_id string, log_id string")
    assert rows(graphs.nn_distance(clusters, edges), "nn") == [(2,), (2,)]
    assert rows(graphs.nn_distance(clusters, edges, "out_degree"), "nn") == [(0,), (0,)]


def test_outlier_rule(spark, rows):
    nn = spark.createDataFrame([("c", f"l{i}", 10 if i == 9 else 0) for i in range(10)], "cluster_id string, log_id string, nn bigint")
    assert rows(graphs.mfg_outliers(nn), "log_id") == [("l9",)]
    assert graphs.mfg_outliers(nn.filter("nn = 0")).count() == 0


# -- clusters -------------------------------------------------------------------------------

def vectors_df(spark, seed=1, n=60, universe=7):
    rng = random.Random(seed)
    data = [(f"l{i:03d}", sorted(rng.sample(range(universe), rng.randint(1, universe)))) for i in range(n)]
    return spark.createDataFrame(data, "log_id string, template_ids array<int>")


THRESHOLDS = [0.5, 1.0, 1.9, 2.0, 3.0, 100.0]


def test_tree_properties(spark):
    df = vectors_df(spark)
    members = {r.log_id: set(r.template_ids) for r in df.collect()}
    cut = cluster.cut_tree(cluster.cluster_tree(df, THRESHOLDS), df, THRESHOLDS).collect()
    by = {}
    for r in cut:
        by.setdefault((r.threshold, r.cluster_id), []).append(r)
    for t in THRESHOLDS:
        assert sorted(r.log_id for r in cut if r.threshold == t) == sorted(members)
    for (t, name), rs in by.items():
        inside = [members[r.log_id] for r in rs]
        diameter = max(len(a ^ b) for a in inside for b in inside)
        assert {r.diameter for r in rs} == {diameter} and diameter <= t
        assert {r["size"] for r in rs} == {len(rs)} and name == min(r.log_id for r in rs)
        cost = {r.log_id: sum(len(members[r.log_id] ^ b) for b in inside) for r in rs}
        medoid = rs[0].medoid_log_id
        assert cost[medoid] == min(cost.values())
    # cuts nest: a cluster at a lower threshold lies inside one at a higher threshold
    at = {(r.threshold, r.log_id): r.cluster_id for r in cut}
    for low, high in itertools.pairwise(THRESHOLDS):
        for (t, _), rs in by.items():
            if t == low:
                assert len({at[high, r.log_id] for r in rs}) == 1
    assert {r.cluster_id for r in cut if r.threshold == 1.9} == {r.cluster_id for r in cut if r.threshold == 1.0}


def test_distributed_splits_are_the_same(spark, rows):
    df = vectors_df(spark, seed=2, n=14, universe=5)
    thresholds = [1.0, 2.0, 3.0]
    assert rows(cluster.cluster_tree(df, thresholds, 5)) == rows(cluster.cluster_tree(df, thresholds))


def test_equal_vectors_need_no_tree(spark, rows):
    df = vectors_df(spark, seed=4, n=80, universe=4)
    columns = ["pattern_id", "node_id", "diameter", "medoid_log_id", "n_logs", "n_patterns"]
    assert rows(cluster.cluster_tree(df, [0.5]), *columns) == rows(cluster.cluster_tree(df, [0.5, 1.0]).filter("diameter = 0 and n_patterns = 1"), *columns)
    assert rows(cluster.cut_tree(cluster.cluster_tree(df, [0.5]), df, [0.5])) == rows(
        cluster.cut_tree(cluster.cluster_tree(df, [0.5, 3.0]), df, [0.5, 3.0]).filter("threshold = 0.5"))


def test_blocks_that_save_nothing_are_not_visited(spark):
    """Two far groups around their medoids: candidates of one never meet the members of the other."""
    near = [(f"n{i:02d}", sorted({1, 2, 3, 4, 5, 6, 7, 8} ^ {i % 8 + 1})) for i in range(8)]
    far = [(f"f{i:02d}", sorted({101, 102, 103, 104, 105, 106, 107, 108} ^ {i % 8 + 101})) for i in range(8)]
    df = spark.createDataFrame([("c", n, s, 1) for n, s in near + far], "cluster_id string, pattern_id string, items array<bigint>, weight bigint")
    blocked = sets.into_blocks(sets.with_pivots(df), 2)
    medoid = F.array(*[F.lit(x).cast("bigint") for x in range(1, 9)])
    kept = blocked.withColumn("kept_distance", F.size(F.array_except("items", medoid)) + F.size(F.array_except(medoid, "items"))).withColumn("_far", F.col("items")[0] > 100)
    table = sets.block_table(kept, F.max("kept_distance").alias("kept"), F.count_if("_far").alias("candidates"))
    pairs = cluster.useful_pairs(table).count()
    candidates = table.filter("candidates > 0").count()
    assert 0 < pairs <= candidates * table.filter("kept > 2").count() < candidates * table.count()


def test_cut_golden(spark, rows):
    df = spark.createDataFrame([("a", [1]), ("b", [1, 2]), ("c", [1, 2, 3, 4])], "log_id string, template_ids array<int>")
    cut = cluster.cut_tree(cluster.cluster_tree(df, [0.5, 1.0, 3.0]), df, [0.5, 1.0, 3.0])
    assert [cut.filter(F.col("threshold") == t).select("cluster_id").distinct().count() for t in (0.5, 1.0, 3.0)] == [3, 2, 1]


def test_small_cluster_rule(spark, rows):
    df = spark.createDataFrame([(f"l{i}", [1] if i < 4 else [1, 2]) for i in range(9)], "log_id string, template_ids array<int>")
    cut = cluster.cluster_verdict(cluster.cut_tree(cluster.cluster_tree(df, [0.5]), df, [0.5]))
    assert rows(cut.groupBy("size", "verdict").count()) == [(4, "AA", 4), (5, "MFG", 5)]


def test_split_small_lowers_cost():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.integers(0, 2, (9, 6))
        x = np.unique(x, axis=0)
        d = np.abs(x[:, None] - x[None]).sum(axis=2)
        one, two = cluster.split_small(d, np.ones(len(x), dtype=int), np.arange(len(x)))
        assert sorted([*one, *two]) == list(range(len(x))) and len(one) and len(two)


def test_mav_and_distance(spark, rows):
    matches = assigned_df(spark, {"a": [2, 1, 2], "b": [3]})
    vs = vectors.mav(matches)
    assert rows(vs) == [("a", [1, 2]), ("b", [3])]
    clustered = spark.createDataFrame([("c", "a", "b"), ("c", "b", "b")], "cluster_id string, log_id string, medoid_log_id string")
    assert rows(vectors.distance_to_medoid(clustered, vs), "log_id", "distance") == [("a", 3), ("b", 0)]
