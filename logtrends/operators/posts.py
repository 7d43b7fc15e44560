"""Keyword counters and keyed tables of posts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrends.functions.keywords import keywords
from logtrends.sources.posts import meetup_fields

# Counters per source: field of the post -> column of the live table.
COUNTERS = {
    "reddit": {"num_comments": "num_comments", "score": "score"},
    "twitter": {"retweet_count": "retweets", "favorite_count": "favorites", "reply_count": "replies"},
}
TEXT_FIELD = {"reddit": "title", "twitter": "text"}


#: Posts whose keywords one task holds, about; posts of a period above which its keywords are dealt out to parts; the most parts. None changes a result.
POSTS_PER_TASK, POSTS_PER_PART, PARTS = 4_000, 2_000, 64
#: Stands between the keywords of a post on the way; no keyword holds it.
_BAR = "|"
#: A part and a place among the keywords of a post, in one number.
_PLACE_BITS = 31
_PLACES = 2**_PLACE_BITS


def _packed(words: Column) -> Column:
    """Keywords as one string, null if there are none."""
    return F.nullif(F.array_join(words, _BAR), F.lit(""))


def _unpacked() -> Column:
    return F.explode(F.split("_words", r"\|")).alias("keyword")


def _whole(posts: DataFrame, own: list[str]) -> DataFrame:
    """``own``, ``part`` and packed keywords of posts whose keywords (``_all``) stay together."""
    row = F.struct(F.lit(0).cast("bigint").alias("part"), _packed(F.col("_all")).alias("_words"))
    return posts.select(*own, F.inline(F.filter(F.array(row), lambda d: d["_words"].isNotNull())))


def _dealt(posts: DataFrame, own: list[str]) -> DataFrame:
    """The same of posts whose keywords are dealt to ``parts`` parts; equal keywords have the same part.

    The keywords are put in the order of their parts once, and each part is cut out of that: the work hardly grows with the number of parts.
    """
    part = lambda w: F.when(F.col("parts") > 1, F.pmod(F.xxhash64(w), F.col("parts"))).otherwise(F.lit(0).cast("bigint"))
    place = F.sort_array(F.transform("_all", lambda w, i: part(w) * _PLACES + i))
    placed = posts.select(*own, "_all", place.alias("_place"))
    ordered = placed.select(
        *own, F.transform("_place", lambda k: F.shiftright(k, _PLACE_BITS)).alias("_parts"),
        F.transform("_place", lambda k: F.get("_all", k.bitwiseAND(F.lit(_PLACES - 1)).cast("int"))).alias("_in_order"))
    cut = ordered.select(*own, "_parts", "_in_order", F.explode(F.array_distinct("_parts")).alias("part"))
    first, behind = F.array_position("_parts", F.col("part")).cast("int"), F.array_position(F.reverse("_parts"), F.col("part")).cast("int")
    return cut.select(*own, "part", F.array_join(F.slice("_in_order", first, F.size("_parts") - behind + 2 - first), _BAR).alias("_words"))


class Sizes(NamedTuple):
    """Number of posts, and the parts of each period that has many of them: (period, parts)."""

    total: int
    large: list

    @classmethod
    def of(cls, posts: DataFrame, period: Column) -> Sizes:
        """The list of periods is short, as each of them stands for ``POSTS_PER_PART`` posts."""
        sizes = posts.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
        many = F.collect_list(F.when(F.col("n") > POSTS_PER_PART, F.struct("period", F.least(F.ceil(F.col("n") / POSTS_PER_PART), F.lit(PARTS)).alias("parts"))))
        total, large = sizes.agg(F.sum("n"), many).first()
        return cls(total or 0, large)

    def share(self, shares: int) -> Sizes:
        """Those of one of some shares of the periods, about."""
        return Sizes(-(-self.total // shares), self.large)


def gathered(posts: DataFrame, period: Column, words: Column, *columns: str | Column, sizes: Sizes | None = None) -> tuple[DataFrame, int]:
    """``period, part, _words`` and ``columns`` of posts with keywords, and the number of partitions: all occurrences of a keyword in a period are in one.

    Posts move once, before they become a row per keyword: what is grouped by period, part and more needs no further shuffle. The keywords of
    a period with many posts are dealt out to parts, so that a task holds about as much at every size and however the posts lie in time. The posts of each period are
    counted first, unless ``sizes`` tells them.
    """
    total, large = sizes or Sizes.of(posts, period)
    spark, one = posts.sparkSession, F.lit(1).cast("bigint")
    tasks = max(-(-total // POSTS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = posts.select(period.alias("period"), *columns, words.alias("_all"))
    own = [c for c in found.columns if c != "_all"]
    if large:
        listed = spark.createDataFrame(large, "period timestamp, parts bigint").withColumnRenamed("period", "_period")
        found = found.join(listed, F.col("period").eqNullSafe(F.col("_period")), "left").drop("_period").withColumn("parts", F.coalesce("parts", one))
    packed = _dealt(found, own) if large else _whole(found, own)
    return packed.repartition(tasks, "period", "part"), tasks


def post_keywords(posts: DataFrame, kind: str) -> DataFrame:
    """One row per keyword occurrence of the posts of one source, with its counters."""
    counters = [F.col(field).alias(name) for field, name in COUNTERS[kind].items()]
    return posts.filter(F.col("type") == kind).select(
        "ts", *counters, F.explode(keywords(F.col(TEXT_FIELD[kind]))).alias("keyword")
    )


def keyword_minute(posts: DataFrame, kind: str) -> DataFrame:
    """Additive counters per minute and keyword."""
    counters = [F.col(field).alias(name) for field, name in COUNTERS[kind].items()]
    sums = [F.sum(name).alias(name) for name in COUNTERS[kind].values()]
    own = posts.filter(F.col("type") == kind)
    packed, _ = gathered(own, F.date_trunc("minute", "ts"), keywords(F.col(TEXT_FIELD[kind])), *counters)
    found = packed.select("period", "part", *COUNTERS[kind].values(), _unpacked())
    return found.groupBy("period", "part", "keyword").agg(*sums).select(F.col("period").alias("minute"), "keyword", *COUNTERS[kind].values())


def _both(posts: DataFrame) -> tuple[Column, list[Column]]:
    """Keywords of a reddit or twitter post, null for others, and the counters of both: those of the other source are null."""
    text, counters = F.lit(None).cast("string"), []
    for kind, fields in COUNTERS.items():
        own = F.col("type") == kind
        text = F.when(own, F.col(TEXT_FIELD[kind])).otherwise(text)
        counters += [F.when(own, F.col(field)).alias(f"{kind}_{name}") for field, name in fields.items()]
    return keywords(text), counters


def both_sums() -> list:
    """Sums of the counters of both sources and the number of occurrences in each."""
    sums = [F.sum(f"{kind}_{name}").alias(name) for kind, fields in COUNTERS.items() for name in fields.values()]
    return sums + [F.count_if(F.col("type") == kind).alias(f"n_{kind}") for kind in COUNTERS]


def both_sizes(posts: DataFrame, width: str | None = None) -> Sizes:
    """The posts that ``both_minutes`` counts."""
    return Sizes.of(posts.filter(F.col("type").isin(*COUNTERS)), _period(width))


def _period(width: str | None) -> Column:
    minute = F.date_trunc("minute", "ts")
    return F.window(minute, width)["start"] if width else minute


def both_minutes(posts: DataFrame, width: str | None = None, sizes: Sizes | None = None) -> DataFrame:
    """Counters of both sources per minute and keyword, from one scan and one shuffle.

    With ``width``, a number of minutes such as ``1 hour``, there are two further columns: ``period``, the start of the window of that width, and ``part``.
    All minutes of a window and a keyword lie in one partition: what is grouped by period, part and more needs no further shuffle.
    """
    words, counters = _both(posts)
    minute = F.date_trunc("minute", "ts")
    names = [f"{kind}_{name}" for kind, fields in COUNTERS.items() for name in fields.values()]
    own = posts.filter(F.col("type").isin(*COUNTERS))
    packed, _ = gathered(own, _period(width), words, *[minute.alias("minute")] * bool(width), "type", *counters, sizes=sizes)
    keys = ["period", "part", *["minute"] * bool(width), "keyword"]
    found = packed.select(*keys[:-1], "type", *names, _unpacked()).groupBy(*keys).agg(*both_sums())
    return found if width else found.withColumnRenamed("period", "minute").drop("part")


def upsert_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def meetup_keywords(posts: DataFrame) -> DataFrame:
    """Meetup attributes per keyword of the name and of the description."""
    words = F.concat(keywords(F.col("name")), keywords(F.col("description")))
    meetups = meetup_fields(posts.filter("type = 'meetup'"))
    return meetups.select(
        F.date_trunc("minute", "ts").alias("minute"), F.explode(F.array_distinct(words)).alias("keyword"),
        "ts", "post_id", "city", "state", "country", "category", "name", F.col("venue_text").alias("venue"),
    )


def meetup_latest(posts: DataFrame) -> DataFrame:
    """Latest meetup per minute and keyword.

    The contest is held among times and ids only. The keywords that a meetup has won come back to it in one row, to meet its attributes, which
    (a name may be a long text) are never repeated on the way.
    """
    own, minute = posts.filter("type = 'meetup'"), F.date_trunc("minute", "ts")
    key = F.struct(minute.alias("minute"), "ts", "post_id").alias("_key")  # a struct: null times and ids meet as well
    shown = ["city", "state", "country", "category", "name", "venue"]
    words = F.array_distinct(F.concat(keywords(F.col("name")), keywords(F.col("description"))))
    packed, tasks = gathered(own, minute, words, "ts", "post_id")
    found = packed.select("period", "part", "ts", "post_id", _unpacked())
    latest = found.groupBy("period", "part", "keyword").agg(F.max(F.struct("ts", "post_id")).alias("_last"))
    won = latest.groupBy("period", "part", "_last").agg(F.array_join(F.collect_list("keyword"), _BAR).alias("_words"))
    won = won.select(F.struct(F.col("period").alias("minute"), "_last.ts", "_last.post_id").alias("_key"), "_words")
    attributes = meetup_fields(own).drop("venue").withColumnRenamed("venue_text", "venue").select(key, *shown)
    one = attributes.repartition(tasks, "_key").dropDuplicates(["_key"])  # a meetup that came twice
    return won.repartition(tasks, "_key").join(one, "_key").select("_key.minute", _unpacked(), "_key.ts", "_key.post_id", *shown)


def merge_counters(batch: DataFrame, target: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Additive upsert: counters of ``batch`` added to those of ``target``, missing ones count as 0."""
    zero = F.lit(0).cast("bigint")
    columns = [*keys, *counters]
    stacked = target.select(*columns).unionByName(batch.select(*columns))
    return stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in counters])
