import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm.top_items import top_items

SCHEMA = "g string, h int, item long, score int, path string, _bound string, item_rank_note int"


def reference(rows, n):
    groups = {}
    for g, h, item, score, path in {r[:5] for r in rows}:
        if score is not None and item is not None:
            groups.setdefault((g, h), []).append((-score, path is not None, path or "", item))
    return {(k[0], k[1], v[3]) for k, vs in groups.items() for v in sorted(vs)[:n]}


@pytest.mark.parametrize("n", [1, 5])
def test_equals_sorting(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(4000):
        hot = rng.random() < 0.4
        rows.append((("hot" if hot else rng.choice(["a", "b", None, "é"])), None if rng.random() < 0.1 else rng.randint(0, 3), i, rng.choice([None, 1, 2, 3, 3, 3]), rng.choice([None, "a", "B", "b", "é"])))
    rows += rng.sample(rows, 300)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(7)
    got = top_items(df, ["g", "h"], "score", ["path"], "item", n).collect()
    assert len(got) == len({(r.g, r.h, r.item) for r in got})
    assert {(r.g, r.h, r.item) for r in got} == reference(rows, n)


def test_small_blocks_and_empty(spark, monkeypatch):
    from lodestone.llm import top_items as module

    rows = [("g", 1, i, i % 50, "p") for i in range(2000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).coalesce(1)
    survivors = module.block_survivors(df, ["g", "h"], "score", ["path"], "item", 5, block_rows=100).collect()
    assert {(r.score, r.item) for r in survivors} >= {(49, 49 + 50 * i) for i in range(5)}
    assert top_items(df.limit(0), ["g", "h"], "score", ["path"], "item", 5).count() == 0


def test_large_integers_and_nulls_stay_exact(spark):
    big = 2**53
    rows = [(big + 1, big + 3, 1, "p"), (big, big + 3, 2, "p"), (None, None, 3, "p"), (big + 1, None, 4, None), (big + 1, None, 4, None), (None, big, 5, "p")]
    df = spark.createDataFrame(rows, "g long, h long, item long, path string").withColumn("score", F.lit(big + 1).cast("long")).repartition(2)
    got = {(r.g, r.h, r.item, r.score) for r in top_items(df, ["g", "h"], "score", ["path"], "item", 1).collect()}
    assert got == {(g, h, i, big + 1) for g, h, i, _ in rows}


@pytest.mark.parametrize("kind", ["double", "decimal(20,3)", "string", "timestamp"])
def test_scores_of_other_types(spark, kind):
    df = spark.range(400).select((F.col("id") % 3).alias("g"), F.col("id").alias("item"), F.lit("p").alias("path"), (F.col("id") * 1000).cast("long").alias("s")).repartition(3)
    score = F.format_string("%09d", "s") if kind == "string" else F.timestamp_seconds("s") if kind == "timestamp" else F.col("s").cast(kind)
    got = {(r.g, r.item) for r in top_items(df.withColumn("score", score), ["g"], "score", ["path"], "item", 2).collect()}
    assert got == {(i % 3, i) for i in range(394, 400)}
