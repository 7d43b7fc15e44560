"""Difflogs, common sequences, matching spans and the whole analysis."""

import random

import pytest
from pyspark.sql import functions as F

from logtrends.operators import difflog, graphs, patterns, templates
from logtrends.plans import analysis
from tests.test_graphs import assigned_df, plain_edges, random_logs
from tests.test_templates import lines_df, pattern_df

ABNORMAL = "threshold double, log_id string, reason string, baseline_log_id string"
CLUSTERS = "threshold double, cluster_id string, log_id string, medoid_log_id string, diameter bigint, size bigint, verdict string"


def paths_of(spark, abnormal_logs, baseline, all_baselines=()):
    """Edges and paths of the logs in ``abnormal_logs`` against one baseline or against all."""
    logs = {**abnormal_logs, **({"base": baseline} if baseline else {}), **dict(all_baselines)}
    assigned = assigned_df(spark, logs)
    edges, nodes = graphs.mfg_edges(assigned), graphs.mfg_nodes(assigned)
    abnormal = spark.createDataFrame([(0.5, log, "x", "base" if baseline else None) for log in abnormal_logs], ABNORMAL)
    clusters = spark.createDataFrame([(0.5, n, n, n, 0, 9, "MFG") for n, _ in all_baselines], CLUSTERS)
    missing = analysis.all_difflog_edges(abnormal, clusters, edges)
    return missing, difflog.difflog_paths(missing, edges, difflog.normal_vertices(abnormal, clusters, nodes))


def test_golden_edges_and_path(spark, rows):
    missing, paths = paths_of(spark, {"a": [1, 5, 2]}, [1, 2])
    assert rows(missing, "src", "dst") == [(1, 5), (5, 2)]
    assert rows(paths, "path") == [([1, 5, 2],)]


def test_all_baselines(spark, rows):
    missing, _ = paths_of(spark, {"a": [1, 2, 3]}, None, [("n1", [1, 2]), ("n2", [2, 3])])
    assert missing.count() == 0
    missing, paths = paths_of(spark, {"a": [1, 2, 9, 3]}, None, [("n1", [1, 2]), ("n2", [2, 3])])
    assert rows(missing, "src", "dst") == [(2, 9), (9, 3)]
    assert rows(paths, "path") == [([2, 9, 3],)]


def test_two_grams_are_the_missing_edges(spark, rows):
    logs = random_logs(11, n=60, kinds=7)
    base = [0, 1, 2, 3, 1]
    missing, paths = paths_of(spark, logs, base)
    grams = {(r.log_id, *e) for r in paths.collect() for e in zip(r.path, r.path[1:])}
    assert grams == {tuple(r) for r in missing.select("log_id", "src", "dst").collect()}
    assert grams == {(log, *e) for log, ts in logs.items() for e in plain_edges(ts) - plain_edges(base)}


def test_paths_stop_at_normal_vertices():
    # 1 -> 5 -> 6 -> 2 with 2 normal, 5 -> 7 leaf, 2 -> 1 present
    rows_ = [(1, 5, True, False), (5, 6, True, False), (6, 2, True, True), (2, 1, False, True), (5, 7, True, False)]
    assert difflog.missing_paths(rows_, [1, 5, 6, 2]) == [(1, 5, 6, 2), (1, 5, 7)]


def test_deep_chain_needs_no_recursion():
    rows_ = [(i, i + 1, True, False) for i in range(5000)]
    assert difflog.missing_paths(rows_, [0]) == [tuple(range(5001))]


def test_common_sequence(spark, rows):
    missing, paths = paths_of(spark, {"a": [1, 5, 2, 7], "b": [1, 5, 2]}, [1, 2])
    groups = spark.createDataFrame([("g", "a", 2), ("g", "b", 2)], "cluster_id string, log_id string, size bigint")
    assert rows(difflog.common_edges(groups, missing), "src", "dst") == [(1, 5), (5, 2)]
    assert rows(difflog.common_paths(groups, missing, paths)) == [("g", [1, 5, 2])]


def test_common_sequence_with_break(spark, rows):
    missing, paths = paths_of(spark, {"a": [1, 5, 6, 7, 8], "b": [1, 5, 6, 9, 3, 7, 8, 4, 4, 4, 4, 2]}, [1, 2])
    groups = spark.createDataFrame([("g", "a", 2), ("g", "b", 2)], "cluster_id string, log_id string, size bigint")
    assert rows(difflog.common_paths(groups, missing, paths), "path") == [([1, 5, 6],), ([7, 8],)]


def test_pattern_with_gap_and_prefix(spark, rows):
    wanted = spark.createDataFrame([("long", [1, 5, 2]), ("short", [1, 5])], "pattern_id string, path array<int>")
    found = patterns.pattern_matches(assigned_df(spark, {"gap": [1, None, 5, 2], "other": [1, 5, 9]}), wanted)
    assert rows(found, "pattern_id", "log_id", "start_line", "end_line") == [
        ("long", "gap", 1, 4), ("short", "gap", 1, 3), ("short", "other", 1, 2),
    ]


@pytest.mark.parametrize("per_block", [2, 1000])
def test_patterns_brute_force(spark, rows, per_block):
    logs = random_logs(21, n=20, longest=15, kinds=3)
    wanted = {"ab": [0, 1], "aba": [0, 1, 0], "aa": [1, 1], "c": [2], "abca": [0, 1, 2, 0]}
    df = spark.createDataFrame(list(wanted.items()), "pattern_id string, path array<int>")
    expected = []
    for log, ts in logs.items():
        known = [(i, t) for i, t in enumerate(ts, 1) if t is not None]
        for name, path in wanted.items():
            for s in range(len(known) - len(path) + 1):
                if [t for _, t in known[s:s + len(path)]] == path:
                    expected.append((name, log, known[s][0], known[s + len(path) - 1][0]))
    found = patterns.pattern_matches(assigned_df(spark, logs), df, per_block)
    assert rows(found, "pattern_id", "log_id", "start_line", "end_line") == sorted(expected, key=repr)


def make_lines(spark, logs):
    data = [(log, i, line) for log, lines in logs.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(data, "log_id string, line_no bigint, line string")


def normal_and_strange():
    """Enough equal logs, and two with an extra step in the middle that keeps the same set of templates."""
    logs = {f"log_{i:02d}": ["open 1", "work 2", "work 3", "close 4"] for i in range(30)}
    logs["log_error_1"] = ["open 1", "work 2", "open 5", "close 4"]
    logs["log_error_2"] = ["open 1", "close 8", "work 2", "open 5", "close 4"]
    return logs


def test_whole_analysis(spark, rows):
    lines = make_lines(spark, normal_and_strange())
    result = analysis.analyze(lines, pattern_df(spark, "close *", "open *", "work *"))
    assert rows(result["abnormal"], "log_id") == [("log_error_1",), ("log_error_2",)]
    found = result["matches"].filter("log_id = 'log_error_1'")
    spans = [[(x.line_no, x.line) for x in r["lines"]] for r in found.collect()]
    assert sorted(spans) == [[(2, "work 2"), (3, "open 5")], [(3, "open 5"), (4, "close 4")]]
    counts = analysis.sweep(lines, pattern_df(spark, "close *", "open *", "work *"), analysis.labelled_by_name(lines), [0.5, 2.9])
    assert rows(counts) == [(0.5, 2, 0), (2.9, 2, 0)]


def test_thresholds_with_one_whole_part_are_analysed_once(spark, rows, monkeypatch):
    lines, table = make_lines(spark, normal_and_strange()), pattern_df(spark, "close *", "open *", "work *")
    labelled, thresholds = analysis.labelled_by_name(lines), [0.5, 2.9, 0.9, 0.0, 2.0, 1.5, 0.5]
    alone = [rows(analysis.sweep(lines, table, labelled, [t], small=1))[0] for t in thresholds if t]
    tried, find = [], analysis.find_abnormal
    monkeypatch.setattr(analysis, "find_abnormal", lambda v, e, of, *rest, **named: tried.extend(of) or find(v, e, of, *rest, **named))
    assert sorted(rows(analysis.sweep(lines, table, labelled, thresholds, small=1))) == sorted([*alone, (0.0, 0, 0)])
    assert sorted(tried) == [0.0, 0.5, 1.5, 2.9]


def test_several_thresholds_are_one_analysis_each(spark, rows):
    lines, table = make_lines(spark, normal_and_strange()), pattern_df(spark, "close *", "open *", "work *")
    both = analysis.analyze(lines, table, [0.5, 1.5], [0.5, 2.5], small=1)
    keys = {(0.5, 0.5), (0.5, 2.5), (1.5, 0.5), (1.5, 2.5)}
    assert {tuple(r) for r in both["matches"].select("threshold", "diff_threshold").distinct().collect()} == keys
    single = analysis.analyze(lines, table, [1.5], [2.5], small=1)
    for name in ("difflog_clusters", "common_paths", "matches"):
        of_one = both[name].filter("threshold = 1.5 and diff_threshold = 2.5").select(single[name].columns)
        assert single[name].count() > 0 and rows(of_one) == rows(single[name]), name


def test_common_edges_keep_thresholds_apart(spark, rows):
    missing, _ = paths_of(spark, {"a": [1, 5, 2], "b": [1, 5, 2]}, [1, 2])
    missing = missing.unionByName(missing.withColumn("threshold", F.lit(1.0)))
    groups = analysis.cluster_difflogs(missing, [0.5, 1.0], [0.5])
    found = difflog.common_edges(groups, missing)
    assert rows(found, "threshold", "src", "dst", "n_logs") == [(0.5, 1, 5, 2), (0.5, 5, 2, 2), (1.0, 1, 5, 2), (1.0, 5, 2, 2)]


def test_nothing_abnormal(spark):
    lines = make_lines(spark, {f"log_{i}": ["open 1", "close 2"] for i in range(6)})
    result = analysis.analyze(lines)
    for name in ("abnormal", "difflog_edges", "difflog_paths", "difflog_clusters", "common_paths", "matches"):
        assert result[name].count() == 0, name
    assert result["templates"].count() == 2


def test_analysis_with_inferred_templates(spark):
    result = analysis.analyze(make_lines(spark, normal_and_strange()))
    assert result["abnormal"].count() >= 1
    assert result["templates"].count() >= 1


def test_sweep_has_29_steps():
    assert len(analysis.SWEEP) == 29 and analysis.SWEEP[0] == 0.1 and analysis.SWEEP[-1] == 2.9


def test_analysis_does_not_depend_on_partitions(spark, rows):
    lines = make_lines(spark, normal_and_strange())
    table = pattern_df(spark, "close *", "open *", "work *")
    a, b = analysis.analyze(lines, table), analysis.analyze(lines.repartition(11), table)
    for name in ("clusters", "abnormal", "difflog_paths", "common_paths"):
        assert rows(a[name]) == rows(b[name]), name


def test_random_walks_match_definition():
    rng = random.Random(5)
    for _ in range(300):
        ts = [rng.randrange(6) for _ in range(rng.randint(2, 12))]
        base = [rng.randrange(5) for _ in range(rng.randint(1, 8))]
        first = {}
        for e in zip(ts, ts[1:]):
            first.setdefault(e, len(first))
        normal_edges = set(zip(base, base[1:]))
        rows_ = [(a, b, (a, b) not in normal_edges, b in base) for a, b in first]
        paths = difflog.missing_paths(rows_, list(dict.fromkeys(ts)))
        assert {e for p in paths for e in zip(p, p[1:])} == set(first) - normal_edges


def test_infer_then_assign(spark):
    lines = lines_df(spark, "open 1", "open 2", "close now", "close later")
    found = templates.infer_templates(lines)
    assert templates.match_lines(lines, found).select("line_no").distinct().count() == 4
    assert templates.match_lines(lines, found).filter(F.col("template_id").isNull()).count() == 0


def test_paths_of_many_logs_share_a_call(spark, rows):
    """Paths come from one row per log, not from a call per log; the order of first seen transitions holds."""
    steps = [(f"l{i:03d}", 1 + k, s, d, n) for i in range(300) for n, (s, d) in enumerate([(9, 1), (1, 5 + i % 3), (5 + i % 3, 2), (2, 8)]) for k in [n]]
    edges = spark.createDataFrame([(log, s, d, at) for log, at, s, d, _ in steps], "log_id string, src int, dst int, first_pos bigint")
    missing = edges.filter("src not in (2, 9)").selectExpr("double(0.5) threshold", "log_id", "src", "dst")
    normal = spark.createDataFrame([(0.5, f"l{i:03d}", t) for i in range(300) for t in (9, 1, 2, 8)], "threshold double, log_id string, template_id int")
    found = difflog.difflog_paths(missing, edges, normal)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r[1:] for r in rows(found)] == [(f"l{i:03d}", 0, [1, 5 + i % 3, 2]) for i in range(300)]
