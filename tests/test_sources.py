"""Files in, files out: logs, exported logs, chunks and packets."""

import gzip
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logtrends.sources import logs, posts


def test_read_logs(spark, rows, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "log_1").write_text("one\n\n  two \n")
    (tmp_path / "log_2").write_text("three\n")
    (tmp_path / "other").write_text("no\n")
    found = logs.read_logs(spark, str(tmp_path))
    shown = found.select(F.element_at(F.split("log_id", "/"), -1), "line_no", "line")
    assert rows(shown) == [("log_1", 1, "one"), ("log_1", 3, "two"), ("log_2", 1, "three")]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "log_big").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = logs.read_logs(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 3000 and all(r.line == f"line {r.line_no}" for r in found)


def test_exported_logs(spark, rows, tmp_path):
    def put(group, name, text):
        folder = tmp_path / group / "stream"
        folder.mkdir(parents=True, exist_ok=True)
        with gzip.open(folder / name, "wt") as f:
            f.write(text)

    put("minute", "000.gz", "2024-01-09T10:00:00.000Z new\n2024-01-01T10:00:00.000Z old\nno time\n")
    put("hour", "000.gz", "2024-01-09T10:00:00.000Z other group\n")
    (tmp_path / "minute" / "aws-logs-write-test").write_text("2024-01-09T10:00:00.000Z marker\n")
    found = logs.read_exported_logs(spark, str(tmp_path), ["/aws/minute"], 2, datetime(2024, 1, 10))
    assert rows(found, "line", "log_group") == [("2024-01-09T10:00:00.000Z new", "minute")]


@pytest.mark.parametrize("per_log,expected", [(False, [5, 2]), (True, [3, 4])])
def test_chunks(spark, per_log, expected):
    df = spark.createDataFrame(
        [(log, i, "x") for log, n in (("a", 3), ("b", 4)) for i in range(1, n + 1)], "log_id string, line_no bigint, line string"
    )
    chunked = logs.chunk_lines(df, 5, per_log)
    sizes = chunked.groupBy("chunk_id" if not per_log else "log_id").count().orderBy(F.first("chunk_id") if not per_log else "log_id")
    assert [r["count"] for r in sizes.collect()] == expected


def test_filters(spark, rows):
    df = spark.createDataFrame([("a", 1, "An Error"), ("a", 2, "error"), ("b", 1, "fine")], "log_id string, line_no bigint, line string")
    assert rows(logs.drop_lines_with(df, "error"), "line") == [("An Error",), ("fine",)]
    assert rows(logs.logs_with(df, "error")) == [("a",)]


@pytest.mark.parametrize("seed", [1, 2])
def test_packets_cut_anywhere(spark, rows, seed):
    rng = random.Random(seed)
    data = []
    for stream in (1, 2):
        text = "".join(json.dumps({"post_id": 100 * stream + i, "title": "x" * rng.randint(0, 9)}) + "\n" for i in range(12))
        text = text.replace("\n", "\n\n", 1)
        cuts = sorted(rng.sample(range(len(text)), 25))
        data += [(stream, i, text[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))]
    packets = spark.createDataFrame(data, "stream_id bigint, seq bigint, data string")
    found = posts.parse_framed_json(packets, "post_id bigint, title string", block=F.floor(F.col("seq") / 4))
    assert rows(found, "stream_id", "post_id") == [(s, 100 * s + i) for s in (1, 2) for i in range(12)]
    assert found.filter("is_corrupt").count() == 0


def test_bad_records_are_marked(spark, rows):
    df = spark.createDataFrame([('{"type": "reddit", "title": "a", "score": 1}',), ('{"type": "reddit"',), ('{"type": "reddit", "title": "b"}',)], "value string")
    found = posts.parse_json(df)
    assert rows(found.filter("not is_corrupt"), "title", "score") == [("a", 1), ("b", None)]
    assert found.filter("is_corrupt").count() == 1


def test_chunks_and_matches_are_written_without_folders(spark, rows, tmp_path):
    chunked = logs.chunk_lines(spark.createDataFrame([(f"l{i}", j, f"x{j}") for i in range(3) for j in range(1, 8)], "log_id string, line_no long, line string"), 5)
    logs.write_chunks(chunked, str(tmp_path / "chunks"))
    assert rows(spark.read.parquet(str(tmp_path / "chunks")), "chunk_id", "log_id", "line_no") == rows(chunked, "chunk_id", "log_id", "line_no")
    found = spark.createDataFrame([(0, "b/c", 3, 4), (1, "a", 1, 2)], "pattern_id int, log_id string, start_line long, end_line long")
    logs.write_matches(found, str(tmp_path / "matches"))
    assert rows(spark.read.parquet(str(tmp_path / "matches"))) == rows(found)
    assert not [p for p in tmp_path.glob("*/*") if p.is_dir()]
