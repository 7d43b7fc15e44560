"""Posts: reading, framing, routing and normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("reddit", "twitter", "meetup")
_PLACE = "city string, state string, country string"
POST_SCHEMA = (
    "post_id bigint, ts timestamp, type string, title string, score bigint, num_comments bigint, text string, "
    "retweet_count bigint, favorite_count bigint, reply_count bigint, name string, description string, "
    f"venue struct<{_PLACE}, name string, address_1 string, address_2 string, address_3 string>, "
    f"`group` struct<{_PLACE}, category struct<shortname string>>"
)
MESSAGE_SCHEMA = (
    "text string, limit struct<track bigint>, disconnect struct<reason string>, message string, code bigint"
)


def parse_json(records: DataFrame, schema: str = POST_SCHEMA, column: str = "value") -> DataFrame:
    """Fields of JSON records next to the other columns; a record that is no JSON has
    ``is_corrupt`` true and null fields."""
    bad = "_corrupt_record"
    parsed = F.from_json(F.col(column), f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    others = [c for c in records.columns if c != column]
    return records.select(*others, parsed.alias("_p")).select(
        *others, "_p.*"
    ).withColumn("is_corrupt", F.col(bad).isNotNull()).drop(bad)


def read_posts(spark: SparkSession, path: str, streaming: bool = False, schema: str = POST_SCHEMA) -> DataFrame:
    """Posts from newline-framed JSON files, as a batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return parse_json(reader.schema("value string").format("text").load(path), schema)


def glue_packets(packets: DataFrame, stream: str = "stream_id", seq: str = "seq", data: str = "data",
                 block: Column | None = None) -> DataFrame:
    """Newline-framed records from packets that begin and end anywhere.

    Every packet is cut at its newlines. A piece belongs to the record that began after the
    last newline before it, so the pieces of a record share a running newline count.
    ``block`` spreads a long stream over tasks (default: 10,000 sequence numbers each).
    """
    block = F.floor(F.col(seq) / 10_000) if block is None else block
    pieces = packets.select(
        F.col(stream).alias("stream_id"), F.col(seq).alias("_seq"), block.alias("_block"),
        F.posexplode(F.split(F.col(data), "\n", -1)).alias("_pos", "_piece"),
    )
    # the first piece of a packet goes on with the record of the packet before
    per_packet = packets.select(
        F.col(stream).alias("stream_id"), F.col(seq).alias("_seq"), block.alias("_block"),
        (F.size(F.split(F.col(data), "\n", -1)) - 1).alias("_newlines"),
    )
    in_block = Window.partitionBy("stream_id", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_packet.groupBy("stream_id", "_block").agg(F.sum("_newlines").alias("_n")).select(
        "stream_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    starts = (
        per_packet.withColumn("_inside", F.coalesce(F.sum("_newlines").over(in_block), F.lit(0)))
        .join(offsets, ["stream_id", "_block"])
        .select("stream_id", "_seq", (F.col("_offset") + F.col("_inside")).alias("_start"))
    )
    return (
        pieces.join(starts, ["stream_id", "_seq"])
        .groupBy("stream_id", (F.col("_start") + F.col("_pos")).alias("record_no"))
        .agg(F.array_sort(F.collect_list(F.struct("_seq", "_pos", "_piece"))).alias("_parts"))
        .select("stream_id", "record_no", F.array_join(F.transform("_parts", lambda p: p["_piece"]), "").alias("value"))
        .filter("trim(value) != ''")
    )


def parse_framed_json(packets: DataFrame, schema: str = POST_SCHEMA, **framing) -> DataFrame:
    return parse_json(glue_packets(packets, **framing), schema)


def union_listings(*listings: DataFrame, dedupe: bool = False) -> DataFrame:
    """All listings of a site one after the other; a post in two listings counts twice unless ``dedupe``."""
    result = listings[0]
    for more in listings[1:]:
        result = result.unionByName(more)
    return result.dropDuplicates(["post_id"]) if dedupe else result


def normalise_post(posts: DataFrame, kind: str) -> DataFrame:
    """Tag posts with their type and drop client objects that are not sent."""
    return posts.drop("subreddit", "author", "_reddit").withColumn("type", F.lit(kind))


def route_posts(posts: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per known type and ``invalid`` for everything else."""
    routes = {kind: posts.filter(F.col("type") == kind) for kind in KINDS}
    routes["invalid"] = posts.filter(~F.coalesce(F.col("type").isin(*KINDS), F.lit(False)))
    return routes


def classify_messages(messages: DataFrame) -> DataFrame:
    """Kind of a stream message with the detail that is worth reporting; tested in this order."""
    kinds = [
        ("post", F.col("text"), F.lit(None)),
        ("limit", F.col("limit"), F.col("limit.track")),
        ("disconnect", F.col("disconnect"), F.col("disconnect.reason")),
        ("error", F.col("message"), F.concat_ws(" ", "message", F.col("code").cast("string"))),
    ]
    kind, detail = F.lit("unknown"), F.lit(None).cast("string")
    for name, test, value in reversed(kinds):
        kind = F.when(test.isNotNull(), F.lit(name)).otherwise(kind)
        detail = F.when(test.isNotNull(), value.cast("string")).otherwise(detail)
    return messages.select("*", kind.alias("kind"), detail.alias("detail"))


def meetup_fields(meetups: DataFrame) -> DataFrame:
    """Location, venue text and category of meetups."""
    none = F.lit("None")
    at_venue = F.col("venue").isNotNull()

    def place(field: str) -> Column:
        return F.when(at_venue, F.col(f"venue.{field}")).otherwise(F.col(f"group.{field}"))

    parts = [F.coalesce(F.col(f"venue.{f}"), F.lit("")) for f in ("name", "address_1", "address_2", "address_3")]
    return meetups.select(
        "*", place("city").alias("city"), F.coalesce(place("state"), none).alias("state"), place("country").alias("country"),
        F.when(at_venue, F.concat(*parts)).otherwise(none).alias("venue_text"),
        F.coalesce(F.col("group.category.shortname"), none).alias("category"),
    )
