"""Logs, templates and posts made from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrends.operators.order import number_rows
from logtrends.operators.templates import compile_templates

#: Events that one task gives their documents. Does not change a result.
EVENTS_PER_TASK = 100_000


def few_splits(df: DataFrame) -> bool:
    """Whether a scan has fewer tasks than there are cores, as with one small file."""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if the scan alone would leave most of them idle.

    Large inputs have splits enough and are not shuffled.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few_splits(df) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; time columns without zone become timestamps of the session zone."""
    df = spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))
    for field, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(field, F.col(field).cast("timestamp"))
    return df


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per user and day; lines in time order."""
    events = table(spark, sf_dir, "events").select(
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("log_id"), "ts", "event_id",
        F.concat("event_type", F.lit(" k "), F.regexp_extract("props", r'"k": ?(-?[0-9]+)', 1)).alias("line"),
    )
    hour = F.floor(F.unix_seconds("ts") / 3600)
    return number_rows(events, ["log_id"], ["ts", "event_id"], hour, "line_no").select("log_id", "line_no", "line", "ts")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per document, every line of the whole text (blank ones included)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("log_id"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "line")
    ).select("log_id", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def _ranked(patterns: DataFrame) -> DataFrame:
    """Ids for a pattern table that is bounded by the number of event types."""
    ids = patterns.agg(F.array_sort(F.collect_set("pattern")).alias("p")).select(F.posexplode("p").alias("template_id", "pattern"))
    return ids.select(F.col("template_id").cast("int"), "pattern")


def event_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template per event type."""
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    return compile_templates(_ranked(types.select(F.concat("event_type", F.lit(" *")).alias("pattern"))))


def rich_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type a general template and one per leading digit, and the universal one."""
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    ends = F.explode(F.concat(F.array(F.lit(" *")), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.lit(" k "), d, F.lit("*")))))
    specific = types.select("event_type", ends.alias("end")).select(F.concat("event_type", "end").alias("pattern"))
    universal = types.select(F.lit("*").alias("pattern")).distinct()
    return compile_templates(_ranked(specific.unionByName(universal)))


def posts_from(events: DataFrame, documents: DataFrame, n_docs: int) -> DataFrame:
    """One post per event with the whole text of a document; works on streams too."""
    k = F.regexp_extract("props", r'"k": ?(-?[0-9]+)', 1).cast("bigint")
    joined = (
        events.withColumn("k", k).withColumn("doc_id", F.pmod("event_id", F.lit(n_docs)))
        .join(documents.select("doc_id", F.col("text").alias("body")), "doc_id", "left")
    )
    kind = F.pmod("event_id", F.lit(4))
    units = F.floor("value")

    def when(type_no: int, value: Column, drop_every: int | None = None) -> Column:
        keep = kind == type_no
        if drop_every:
            keep = keep & (F.pmod("k", F.lit(drop_every)) != 0)
        return F.when(keep, value)

    def place(state_drop: int) -> list[Column]:
        return [
            F.concat(F.lit("City "), F.pmod("user_id", F.lit(10))).alias("city"),
            F.when(F.pmod("k", F.lit(state_drop)) != 0, F.concat(F.lit("State "), F.pmod("k", F.lit(7)))).alias("state"),
            F.concat(F.lit("Country "), F.pmod("user_id", F.lit(3))).alias("country"),
        ]

    newline = F.instr("body", "\n")
    venue = F.struct(
        *place(4), F.concat(F.lit("Hall "), "k").alias("name"), F.concat(F.lit(", Street "), "user_id").alias("address_1"),
        F.when(F.pmod("k", F.lit(3)) == 0, F.lit(", Floor 2")).alias("address_2"), F.lit(None).cast("string").alias("address_3"),
    )
    group = F.struct(*place(5), F.when(
        F.pmod("k", F.lit(3)) != 0, F.struct(F.concat(F.lit("cat"), F.pmod("k", F.lit(6))).alias("shortname"))
    ).alias("category"))
    return joined.select(
        F.col("event_id").alias("post_id"), "ts",
        F.when(kind == 0, F.lit("reddit")).when(kind == 1, F.lit("twitter")).when(kind == 2, F.lit("meetup"))
        .when(F.pmod("event_id", F.lit(8)) == 3, F.lit("unknown")).alias("type"),
        when(0, F.col("body")).alias("title"), when(0, units, 10).alias("score"), when(0, F.col("k")).alias("num_comments"),
        when(1, F.col("body"), 11).alias("text"), when(1, F.col("k")).alias("retweet_count"),
        when(1, units).alias("favorite_count"), when(1, F.pmod("k", F.lit(7)), 9).alias("reply_count"),
        when(2, F.substring_index("body", "\n", 1)).alias("name"),
        when(2, F.when(newline > 0, F.substr(F.col("body"), newline + 1))).alias("description"),
        when(2, venue, 2).alias("venue"), when(2, group).alias("group"),
    )


def posts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that meet their documents in tasks of about ``EVENTS_PER_TASK``: each gets a whole text, so tasks made by the size of the events alone would grow large."""
    documents, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    n_docs, tasks = documents.count(), max(-(-events.count() // EVENTS_PER_TASK), spark.sparkContext.defaultParallelism)
    return posts_from(events.repartition(tasks, F.pmod("event_id", F.lit(n_docs))), documents, n_docs)


def post_records(posts: DataFrame) -> DataFrame:
    """Posts as JSON records; null fields are absent from the record."""
    return posts.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if few_splits(events):
        raw = raw.repartition(spark.sparkContext.defaultParallelism)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
