"""Minute scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.functions.scores import REDDIT_WEIGHTS, TWITTER_WEIGHTS, weighted_score

# fixed value
TOP = 10


def closed_before(minutes: DataFrame, as_of: Column) -> DataFrame:
    """Rows of minutes that were over at ``as_of``."""
    return minutes.filter(F.col("minute") < F.date_trunc("minute", as_of))


def minute_scores(reddit: DataFrame, twitter: DataFrame, as_of: Column, merge: str = "overwrite") -> DataFrame:
    """One score per closed minute and keyword.

    Where both sources have the keyword in the same minute, twitter's score replaces
    reddit's (``overwrite``) or is added to it (``sum``).
    """
    both = (
        closed_before(reddit, as_of)
        .select("minute", "keyword", weighted_score(REDDIT_WEIGHTS).alias("score"), F.lit(1).alias("prio"))
        .unionByName(
            closed_before(twitter, as_of)
            .select("minute", "keyword", weighted_score(TWITTER_WEIGHTS).alias("score"), F.lit(2).alias("prio"))
        )
    )
    merged = {"overwrite": F.max_by("score", "prio"), "sum": F.sum("score")}[merge]
    return both.groupBy("minute", "keyword").agg(merged.alias("score"))


def merged_score(merge: str = "overwrite") -> Column:
    """The score of a row that holds the counters of both sources and, per source, the number of occurrences."""
    reddit, twitter = (
        F.when(F.col(f"n_{kind}") > 0, weighted_score(weights)) for kind, weights in (("reddit", REDDIT_WEIGHTS), ("twitter", TWITTER_WEIGHTS)))
    zero = F.lit(0).cast("bigint")
    return {"overwrite": F.coalesce(twitter, reddit), "sum": F.coalesce(reddit, zero) + F.coalesce(twitter, zero)}[merge].alias("score")


def scores_of(counters: DataFrame, merge: str = "overwrite") -> DataFrame:
    """``minute_scores`` from one table with the counters of both sources; columns ``period`` and ``part`` stay."""
    return counters.select(*[c for c in counters.columns if c in ("period", "part")], "minute", "keyword", merged_score(merge))


def keyword_totals(scores: DataFrame, *period: str) -> DataFrame:
    return scores.groupBy(*period, "keyword").agg(F.sum("score").alias("score"))


def top_per_period(totals: DataFrame, *period: str, k: int = TOP) -> DataFrame:
    """The k best keywords of each period, ties by keyword."""
    best = Window.partitionBy(*period).orderBy(F.col("score").desc(), "keyword")
    return totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def trend_now(scores: DataFrame, as_of: Column, k: int = TOP) -> DataFrame:
    """Current ranking: everything closed since the last hourly purge."""
    current = closed_before(scores, as_of).filter(F.col("minute") >= F.date_trunc("hour", as_of))
    top = keyword_totals(current).orderBy(F.col("score").desc(), "keyword").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "keyword"))  # k rows
    return top.select("keyword", F.date_trunc("minute", as_of).alias("period"), "score", rank.alias("rank"))


def trend_windows(scores: DataFrame, width: str, k: int = TOP) -> DataFrame:
    """Ranking of every tumbling window of the given width, e.g. ``5 minutes`` or ``1 hour``.

    Scores that have the start of that window as ``period``, and a ``part`` that depends on the keyword only, are added up and ranked within their parts where they are.
    """
    if "part" in scores.columns:
        totals = top_per_period(keyword_totals(scores, "period", "part"), "period", "part", k=k).drop("rank")
    else:
        totals = keyword_totals(scores.withColumn("period", F.window("minute", width)["start"]), "period")
    return top_per_period(totals, "period", k=k).select("keyword", "period", "score", "rank")


def replace_ranking(ranking: DataFrame, path: str) -> None:
    """Drop the previous ranking and write the new one."""
    ranking.write.mode("overwrite").parquet(path)
