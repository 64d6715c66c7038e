"""Writers of index tables and of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str) -> None:
    """Records as parquet, a folder per kind, so that a query of few kinds reads only those."""
    records.write.mode("overwrite").partitionBy("kind").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes in order of type and id, edges of type, source and target, as JSON lines."""
    nodes.orderBy("type", "id").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("type", "from_id", "to_id").write.mode("overwrite").json(f"{path}/edges")


def dependency_lines(edges: DataFrame) -> DataFrame:
    """One mermaid line per edge."""
    name = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return edges.select(F.concat(F.lit("  "), name("from_id"), F.lit(" --> "), name("to_id")).alias("value")).distinct()


def drift_lines(findings: DataFrame) -> DataFrame:
    """One markdown bullet per finding (drift_type, summary); no row, so no file content, where there are none."""
    return findings.select(F.concat(F.lit("- **"), F.coalesce("drift_type", F.lit("finding")), F.lit("**: "), F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")).alias("value")).distinct()


def health_lines(status: DataFrame) -> DataFrame:
    """Rows of a markdown table of repositories (repo, records, code_anchors, test_anchors, without_chunks, age_hours, rebuild)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("repo", "records", "code_anchors", "test_anchors", "without_chunks", "age_hours", "rebuild")]
    return status.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_lines(lines: DataFrame, path: str, *head: str) -> None:
    """Lines in their order as text, after the lines of ``head``."""
    spark = lines.sparkSession
    first = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "o int, value string")
    first.unionByName(lines.withColumn("o", F.lit(len(head)))).orderBy("o", "value").select("value").write.mode("overwrite").text(path)


def write_suggestions(services: DataFrame, path: str) -> None:
    """Draft suggestions (repo, source, services) as JSON lines, a list of services each."""
    services.select("repo", F.col("source").alias("controller"), F.split("services", ",").alias("services"), F.lit("draft").alias("status")).write.mode("overwrite").json(path)
