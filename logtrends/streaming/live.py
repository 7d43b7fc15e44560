"""Live keyword counters, closed minutes, rankings and duplicates with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtrends.operators.posts import COUNTERS, TEXT_FIELD, Sizes, both_minutes, both_sizes, keyword_minute
from logtrends.operators.trends import minute_scores, replace_ranking, scores_of, trend_now, trend_windows
from logtrends.session import shuffles_dropped
from logtrends.streaming.store import CounterStore


def drop_replays(posts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Posts without those that were delivered again within the watermark."""
    return posts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["post_id"])


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- minutes that are open -------------------------------------------------------------------

class OpenPosts:
    """What a stream of posts keeps between micro-batches: how far its time has come and the posts of periods that are not over.

    The rules are those of a watermark: it is the newest time of all batches so far less ``delay``; a post of a minute that ended before the batch is dropped, and
    a period is closed once its end is reached. Posts are kept, not a row per keyword, and only those of open periods: whatever a batch
    closes itself is never stored. Each batch has a folder of its own beside the query's checkpoint, so that one that is delivered again starts from where it started before.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, delay: str):
        self.spark, self.root, self.delay = spark, f"{checkpoint.rstrip('/')}/open", F.expr(f"INTERVAL {delay}")

    def _folder(self, batch_id: int):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{batch_id}")
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _mark(self, batch_id: int) -> Column:
        """The watermark after a batch; null before the first one."""
        fs, path = self._folder(batch_id)
        found = self.spark.read.schema("mark string").parquet(f"{path}/mark").first()[0] if fs.exists(path) else None
        return F.lit(found).cast("timestamp")

    def arrived(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, Column]:
        """The posts of a batch that are not too late, and the watermark after it."""
        before = self._mark(batch_id - 1)
        after = batch.agg(F.greatest(F.max("ts") - self.delay, before).cast("string")).first()[0]
        over = F.date_trunc("minute", "ts") + F.expr("INTERVAL 1 MINUTE") <= before
        return batch.filter(F.col("ts").isNotNull() & ~F.coalesce(over, F.lit(False))), F.lit(after).cast("timestamp")

    def with_open(self, posts: DataFrame, batch_id: int) -> DataFrame:
        """``posts`` and those that the batch before has left."""
        fs, path = self._folder(batch_id - 1)
        return posts.unionByName(self.spark.read.schema(posts.schema).parquet(f"{path}/posts")) if fs.exists(path) else posts

    def store(self, batch_id: int, mark: Column, posts: DataFrame | None = None) -> None:
        """End of a batch: the posts that are still open, the watermark; what no batch can start from any more is removed."""
        if posts is not None:
            posts.write.mode("overwrite").parquet(f"{self.root}/{batch_id}/posts")
        self.spark.range(1).select(mark.cast("string").alias("mark")).write.mode("overwrite").parquet(f"{self.root}/{batch_id}/mark")
        fs, path = self._folder(batch_id - 2)
        fs.delete(path, True)


#: Posts of closed periods whose keywords are on the executors' disks at one time, about. Does not change a result.
POSTS_PER_SLICE = 2_000_000


def _start_closing(posts: DataFrame, work: Callable[[DataFrame, Sizes], DataFrame], width: str, path: str, checkpoint: str, delay: str,
                   available_now: bool) -> StreamingQuery:
    """Write ``work`` on the posts of all periods that a batch closes. Batches have folders of their own, so that one that is repeated replaces its first attempt.

    A batch that closes very many posts (the first one of a stream that has been waiting may hold all of them) does its periods in slices: the shuffle files of a
    slice are removed before the next one begins. Every slice goes through the posts of the batch again, but only its own become keywords.
    """
    texts, fields = TEXT_FIELD.values(), [f for kind in COUNTERS.values() for f in kind]

    def close(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        kept = OpenPosts(batch.sparkSession, checkpoint, delay)
        with shuffles_dropped(batch.sparkSession):
            new, mark = kept.arrived(batch, batch_id)
            known = new.filter(F.col("type").isin(*COUNTERS)).select("ts", "type", *texts, *fields)
            every, end = kept.with_open(known, batch_id), F.window("ts", width)["end"]
            over = F.coalesce(end <= mark, F.lit(False))
            closed = every.filter(over)
            sizes = both_sizes(closed, width if width != "1 minute" else None)
            slices = max(1, -(-sizes.total // POSTS_PER_SLICE))
            for i in range(slices):
                own = closed.filter(F.pmod(F.xxhash64(end), F.lit(slices)) == i) if slices > 1 else closed
                found = work(own, sizes.share(slices)).write.mode("append" if i else "overwrite")
                found.option("compression", "zstd").parquet(f"{path}/run={run}/batch={batch_id}")
            kept.store(batch_id, mark, every.filter(~over))

    return _start(posts.writeStream.foreachBatch(close), checkpoint, available_now)


# -- running counters -------------------------------------------------------------------------

def counter_store(spark: SparkSession, kind: str, path: str) -> CounterStore:
    return CounterStore(spark, path, list(COUNTERS[kind].values()))


def start_counts(posts: DataFrame, kind: str, path: str, checkpoint: str, delay: str = "10 minutes",
                 available_now: bool = True) -> StreamingQuery:
    """Keep the running counters in the store at ``path``: each micro-batch adds its own. The query's id, which lives in the checkpoint, is the run."""
    def store(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        kept = OpenPosts(batch.sparkSession, checkpoint, delay)
        new, mark = kept.arrived(batch, batch_id)
        counter_store(batch.sparkSession, kind, path).commit(keyword_minute(new, kind), batch_id, run, added=True)
        kept.store(batch_id, mark)

    return _start(posts.writeStream.foreachBatch(store), checkpoint, available_now)


def read_counts(spark: SparkSession, kind: str, path: str, hour: datetime | None = None) -> DataFrame:
    """Counters per minute and keyword, of everything or of the hour of ``hour``."""
    if hour is None:
        return counter_store(spark, kind, path).read()
    start = F.date_trunc("hour", F.lit(hour).cast("timestamp"))
    return counter_store(spark, kind, path).read(start, start + F.expr("INTERVAL 1 HOUR"))


def refresh_trend(spark: SparkSession, reddit_path: str, twitter_path: str, as_of: datetime, out: str, merge: str = "overwrite") -> None:
    """Replace the current ranking by that of the hour of ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    scores = minute_scores(
        read_counts(spark, "reddit", reddit_path, as_of), read_counts(spark, "twitter", twitter_path, as_of), now, merge
    )
    replace_ranking(trend_now(scores, now), out)


# -- closed periods ---------------------------------------------------------------------------

def start_minute_scores(posts: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", merge: str = "overwrite",
                        available_now: bool = True) -> StreamingQuery:
    """Write each closed minute once, both sources in one aggregation."""
    return _start_closing(posts, lambda closed, sizes: scores_of(both_minutes(closed, sizes=sizes), merge), "1 minute", path, checkpoint, delay, available_now)


def read_minute_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("minute timestamp, keyword string, score bigint, run string, batch bigint").parquet(path).drop("run", "batch")


def start_hourly_trend(posts: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", merge: str = "overwrite",
                       available_now: bool = True) -> StreamingQuery:
    """Rank each hour when the watermark closes it. An hour comes out whole in one micro-batch, so the batch ranks it."""
    def rank(closed: DataFrame, sizes: Sizes) -> DataFrame:
        return trend_windows(scores_of(both_minutes(closed, "1 hour", sizes), merge), "1 hour")

    return _start_closing(posts, rank, "1 hour", path, checkpoint, delay, available_now)


def read_hourly_trend(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("keyword string, period timestamp, score bigint, rank int, run string, batch bigint").parquet(path).drop("run", "batch")


def start_dedup(posts: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    return (
        drop_replays(posts, delay).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
