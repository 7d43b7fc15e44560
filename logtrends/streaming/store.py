"""Additive counters of streams in a store of committed versions.

A commit writes the counters of one micro-batch as a segment (a folder of its own) and then a manifest, a small file that names all segments in force.
The newest whole manifest is the state of the store; whatever a lost attempt has written is named by none. Segments are merged by level: as soon as
``FAN`` segments of one level have come together they become one of the next, so that readers open a number of files that grows with the
logarithm of the number of commits.

Counters are running totals of a run, that is of a query with its checkpoint. Of one run the last batch counts per key; a batch that is delivered again
is passed over. A query that starts with a fresh checkpoint is another run: its counters are added to those that are there, and nothing is lost.
Segments of what a batch adds (``added``) are summed instead; their rows name no run.

Folders that the last two manifests do not name are removed, so that a reader may finish what it has begun.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrends.session import scratch_path, shuffles_dropped

KEYS = ["minute", "keyword"]
#: Rows of several segments that are added up at one time, about. Does not change a result.
ROWS_PER_SLICE = 50_000_000
#: Segments of a level that are merged; manifests that are kept.
FAN, KEPT = 8, 2


class CounterStore:
    """Counters named ``counters`` per minute and keyword below ``path``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, counters: list[str]):
        self.spark, self.path, self.counters = spark, path.rstrip("/"), counters
        self.schema = "minute timestamp, keyword string, " + ", ".join(f"{c} bigint" for c in counters) + ", run string, batch bigint"

    # -- files ----------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def _names(self, folder: str) -> list[str]:
        fs, path = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self) -> tuple[int, dict]:
        """(number, content) of the newest whole manifest."""
        for name in reversed(self._names("manifest")):
            fs, path = self._hadoop(f"{self.path}/manifest/{name}")
            source = fs.open(path)
            try:
                text = bytes(source.readAllBytes()).decode()
            finally:
                source.close()
            try:
                return int(name), json.loads(text)
            except ValueError:  # cut off while it was written: the one before is in force
                continue
        return 0, {"segments": [], "batches": {}}

    def _commit(self, number: int, content: dict) -> None:
        fs, path = self._hadoop(f"{self.path}/manifest/{number:020d}")
        target = fs.create(path, False)  # fails if another writer was faster
        target.write(bytearray(json.dumps(content).encode()))
        target.close()

    def _clean(self) -> None:
        names = self._names("manifest")
        for name in names[:-KEPT]:
            fs, path = self._hadoop(f"{self.path}/manifest/{name}")
            fs.delete(path, False)
        named = set()
        for name in names[-KEPT:]:
            fs, path = self._hadoop(f"{self.path}/manifest/{name}")
            source = fs.open(path)
            named |= {s["folder"] for s in json.loads(bytes(source.readAllBytes()).decode() or '{"segments": []}')["segments"]}
            source.close()
        for folder in set(self._names("segments")) - named:
            fs, path = self._hadoop(f"{self.path}/segments/{folder}")
            fs.delete(path, True)

    # -- commits ----------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        with shuffles_dropped(self.spark):
            rows.sortWithinPartitions("minute").write.option("compression", "zstd").parquet(f"{self.path}/segments/{folder}")
        return folder

    def _segments(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/segments/{s['folder']}" for s in segments])

    def _last_of_run(self, rows: DataFrame) -> DataFrame:
        """The counters of the last batch of each run."""
        last = F.max_by(F.struct(*self.counters, "batch"), "batch").alias("last")
        return rows.groupBy(*KEYS, "run").agg(last).select(*KEYS, *[f"last.{c}" for c in self.counters], "run", "last.batch")

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in self.counters])

    def _in_slices(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` on the rows, of which all of a minute are needed together. Many rows are taken by stretches of time (segments are sorted by minute) and what they
        give is kept in the shared folder: their shuffle files, larger than the segments, are never there all at once."""
        path, at = scratch_path(self.spark, "counted"), F.col("minute")
        with shuffles_dropped(self.spark):
            slices = -(-rows.count() // ROWS_PER_SLICE)
        if slices < 2:
            return work(rows)
        with shuffles_dropped(self.spark):
            parts = F.percentile_approx(F.unix_micros(at), [i / slices for i in range(1, slices)])
            edges = [F.timestamp_micros(F.lit(e)) for e in sorted(set(rows.agg(parts).first()[0] or []))]
            for low, high in zip([None, *edges], [*edges, None], strict=True):
                own = rows if high is None else rows.filter(at < high if low is not None else (at < high) | at.isNull())
                own = own.filter(at >= low) if low is not None else own
                work(own).write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(work(rows).schema).parquet(path)

    def _merged(self, segments: list[dict]) -> DataFrame:
        """One row per key (and run) of segments that are all ``added`` or all not."""
        rows = self._segments(segments)
        if segments[0].get("added"):
            return self._sum(rows).withColumns({"run": F.lit(None).cast("string"), "batch": F.lit(None).cast("bigint")})
        return self._last_of_run(rows)

    def commit(self, rows: DataFrame, batch_id: int, run: str, added: bool = False) -> bool:
        """Store the counters of a micro-batch; False if this batch of the run, or a later one, is in the store already.

        The counters are running totals of the run or, with ``added``, what this batch adds to them. A run keeps to one of the two.
        """
        number, content = self._manifest()
        if content["batches"].get(run, -1) >= batch_id:
            return False
        at = [F.lit(None if added else run).cast("string").alias("run"), F.lit(None if added else batch_id).cast("bigint").alias("batch")]
        new = {"folder": self._write(rows.select(*KEYS, *self.counters, *at)), "level": 0, "runs": [run], "added": added}
        segments, level = [*content["segments"], new], 0
        while len(same := [s for s in segments if s["level"] == level and s.get("added", False) == added]) >= FAN:
            runs = sorted({r for s in same for r in s["runs"]}) if all("runs" in s for s in same) else None
            merged = {"folder": self._write(self._merged(same)), "level": level + 1, "added": added, **({"runs": runs} if runs else {})}
            segments = [s for s in segments if s not in same] + [merged]
            level += 1
        self._commit(number + 1, {"segments": segments, "batches": {**content["batches"], run: batch_id}})
        self._clean()
        return True

    def read(self, start=None, end=None) -> DataFrame:
        """Counters per minute and keyword, all of them or from ``start`` (a column) up to ``end``.

        Within a segment a key stands once (and once per run): totals of a run are compared only if several segments may have some, and
        a single segment of what batches added is the result as it is.
        """
        segments = self._manifest()[1]["segments"]
        totals, added = ([s for s in segments if bool(s.get("added")) == kind] for kind in (False, True))
        runs = [r for s in totals for r in s.get("runs", [None, None])]
        found = self._segments([]) if not segments else None
        if totals:
            found = self._segments(totals)
        if added:
            found = found.unionByName(self._segments(added)) if totals else self._segments(added)
        if start is not None:
            found = found.filter((F.col("minute") >= start) & (F.col("minute") < end))
        several = len(set(runs)) < len(runs)

        def add_up(rows: DataFrame) -> DataFrame:
            if several:
                old = rows.filter("batch is not null")
                rows = self._last_of_run(old).unionByName(rows.filter("batch is null")) if added else self._last_of_run(old)
            return self._sum(rows)

        if len(segments) == 1 and added:
            return found.select(*KEYS, *self.counters)
        return self._in_slices(found, add_up) if segments else add_up(found)
