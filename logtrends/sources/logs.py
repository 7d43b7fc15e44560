"""Reading, filtering and chunking log lines; storing templates and matches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtrends.functions import text as T
from logtrends.operators.order import join_null_safe, number_all

# fixed value
EXPORT_MARKER = "aws-logs-write-test"
_LEADING_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)"


def read_logs(spark: SparkSession, path: str, prefix: str = "log") -> DataFrame:
    """Lines of all files below ``path`` whose name starts with ``prefix``.

    A large file is read in splits. Lines are counted inside each split and shifted by the
    number of lines in the splits before it, so a file is never put into one task.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{prefix}*").text(path)
        .select(
            F.col("_metadata.file_path").alias("log_id"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_seq"),
            F.col("value").alias("line"),
        )
    )
    inside = F.row_number().over(Window.partitionBy("log_id", "_split").orderBy("_seq"))
    earlier = Window.partitionBy("log_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        raw.groupBy("log_id", "_split").agg(F.count(F.lit(1)).alias("_n"))
        .select("log_id", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    numbered = raw.withColumn("_inside", inside).join(offsets, ["log_id", "_split"])
    return clean_lines(numbered.select("log_id", (F.col("_offset") + F.col("_inside")).alias("line_no"), "line"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Strip lines and drop the blank ones; line numbers stay as they are."""
    return lines.withColumn("line", T.strip(F.col("line"))).filter("line != ''")


def recent(lines: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Lines of the ``days`` days up to ``as_of`` (both ends included)."""
    end = F.lit(as_of).cast("timestamp")
    return lines.filter((F.col("ts") >= end - F.make_interval(days=F.lit(days))) & (F.col("ts") <= end))


def read_exported_logs(spark: SparkSession, path: str, groups: list[str], days: int, as_of: datetime) -> DataFrame:
    """Lines of exported (gzip) service logs of the wanted groups, last ``days`` days.

    The group is the folder below ``path``. A line without a leading time belongs to no
    period and is left out. The export's write-test object is skipped.
    """
    wanted = [g.rsplit("/", 1)[-1] for g in groups]
    below = path.rstrip("/").rsplit("/", 1)[-1]
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("line"))
        .withColumn("log_group", F.regexp_extract("log_id", f"/\\Q{below}\\E/([^/]+)/", 1))
        .filter(F.col("log_group").isin(*wanted) & ~F.col("log_id").endswith("/" + EXPORT_MARKER))
        .withColumn("ts", F.try_to_timestamp(F.nullif(F.regexp_extract("line", _LEADING_TIME, 1), F.lit(""))))
    )
    return recent(lines, days, as_of)


def drop_lines_with(lines: DataFrame, word: str) -> DataFrame:
    """Lines that do not contain ``word`` (case-sensitive)."""
    return lines.filter(~F.col("line").contains(word))


def logs_with(lines: DataFrame, word: str) -> DataFrame:
    """Logs with at least one line that contains ``word``."""
    return lines.filter(F.col("line").contains(word)).select("log_id").distinct()


def chunk_lines(lines: DataFrame, n: int = 200, per_log: bool = False) -> DataFrame:
    """Number chunks of ``n`` lines, running on over the logs in ``log_id`` order or per log.

    ``line_no`` has to count every line of the log from 1 without gaps.
    """
    if per_log:
        return lines.withColumn("chunk_id", F.floor((F.col("line_no") - 1) / n))
    sizes = lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n"))
    offsets = number_all(sizes, [F.col("log_id")], "_before", weight="_n").select("log_id", "_before")
    return join_null_safe(lines, offsets, ["log_id"]).withColumn(
        "chunk_id", F.floor((F.col("_before") + F.col("line_no") - 1) / n)
    ).drop("_before")


def write_chunks(chunked: DataFrame, path: str) -> None:
    """Chunks in order, the number as a column: few files with many chunks each, of which a reader skips all but its own."""
    chunked.repartitionByRange("chunk_id", "log_id").sortWithinPartitions("chunk_id", "log_id", "line_no").write.mode("overwrite").parquet(path)


def save_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").parquet(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_template_text(spark: SparkSession, path: str) -> DataFrame:
    """Text-form patterns, one per non-blank line, in file order."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seq"), T.strip(F.col("value")).alias("pattern"),
    ).filter("pattern != ''")
    order = [F.col("_file"), F.col("_split"), F.col("_seq")]
    return number_all(raw, order, "template_id").select(F.col("template_id").cast("int"), "pattern")


def write_matches(matches: DataFrame, path: str, format: str = "parquet") -> None:
    """Spans in the order of their logs, the log as a column: no folder per log."""
    matches.repartitionByRange("log_id", "start_line").sortWithinPartitions("log_id", "start_line").write.mode("overwrite").format(format).save(path)
