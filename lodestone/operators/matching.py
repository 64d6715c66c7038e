"""Substring joins of many needles with many texts, without comparing every pair.

A needle made of token characters occurs in a text iff it occurs in one of the text's maximal
runs of such characters.  So needles meet the distinct runs of all texts, not the texts: both
sides are keyed by a short n-gram, joined by equality and verified with ``contains``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n``; none of a shorter text."""
    many = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, many).otherwise(F.array().cast("array<string>")))


#: needles up to which they are broadcast to the runs (some 10 MB); more are joined by shuffling both sides
FEW_NEEDLES = 200_000


def containing(needles: DataFrame, needle: str, runs: DataFrame, run: str, gram: int = 3) -> DataFrame:
    """(needle, run): the distinct runs that contain each needle.

    Needles shorter than ``gram`` are keyed by all they have; runs give grams of those lengths only
    where such needles exist.  Null and empty needles match nothing.
    """
    left = needles.select(needle).where(F.length(needle) > 0).distinct().withColumn("_k", F.substring(F.col(needle), 1, gram))
    sizes = left.groupBy(F.length("_k").alias("n")).count().collect()  # at most ``gram`` rows
    if sum(row["count"] for row in sizes) <= FEW_NEEDLES:
        left = F.broadcast(left)
    keys = F.flatten(F.array(*(grams(F.col(run), row["n"]) for row in sizes))) if sizes else F.array().cast("array<string>")
    right = runs.select(run).where(F.length(run) > 0).distinct().select(run, F.explode(keys).alias("_k"))
    return left.join(right, "_k").where(F.contains(F.col(run), F.col(needle))).select(needle, run)
