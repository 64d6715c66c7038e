"""Registered queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.streaming.deliveries import delivered, drained, first_deliveries, window_counts


def stream_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits per day and repository, each hit once however often it was delivered."""
    hits = first_deliveries(delivered(spark, folder, "search_hits"), "hit_id")
    counts = drained(window_counts(hits, "searched_at", "1 day", "repo"), "hits-by-day")
    return counts.select(F.date_format("begins", "yyyy-MM-dd").alias("day"), "repo", "records")


QUERIES = {"stream_hits": stream_hits}

ORACLE = {
    "stream_hits": "select strftime(searched_at, '%Y-%m-%d') as day, repo, count(distinct hit_id) as records from search_hits where searched_at is not null group by day, repo",
}
