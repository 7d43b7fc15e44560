"""Distances between sets, i.e. between 0/1 vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_distance(a: Column, b: Column) -> Column:
    """City-block distance of two 0/1 vectors given as arrays of the positions that are 1."""
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("bigint")
