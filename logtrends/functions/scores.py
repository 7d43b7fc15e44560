"""Scores of minute counters and time keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the counters.
REDDIT_WEIGHTS = {"num_comments": 0.2, "score": 0.8}
TWITTER_WEIGHTS = {"replies": 0.2, "retweets": 0.5, "favorites": 0.3}


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted sum cut towards zero; 0 when any counter is missing."""
    present, total = F.lit(True), None
    for name, weight in weights.items():
        present = present & F.col(name).isNotNull()
        term = F.lit(weight) * F.col(name).cast("double")
        total = term if total is None else total + term
    return F.when(present, total.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH-mm")


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")
