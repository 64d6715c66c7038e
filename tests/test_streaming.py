from datetime import datetime, timedelta

from lodestone.streaming import deliveries as D

DAY = datetime(2024, 1, 1)
ROWS = [(1, DAY, DAY), (1, DAY, DAY + timedelta(days=400)), (2, DAY, None), (3, None, DAY), (2, DAY, DAY + timedelta(days=2)), (None, DAY, DAY)]


def test_late_redeliveries_count_once(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "hit_id long, searched_at timestamp, received_at timestamp")
    df.repartition(6).write.parquet(f"{tmp_path}/hits.parquet")
    stream = D.first_deliveries(D.delivered(spark, str(tmp_path), "hits"), "hit_id")
    got = D.drained(D.window_counts(stream, "searched_at", "1 day"), "days").collect()
    assert [r.records for r in got] == [3]
    kept = {r.hit_id: r.received_at for r in D.once(df, "hit_id").collect()}
    assert kept == {1: DAY, 2: DAY + timedelta(days=2), 3: DAY, None: DAY}


def test_bounded_state_forgets(spark, tmp_path):
    spark.createDataFrame(ROWS[:2], "hit_id long, searched_at timestamp, received_at timestamp").write.parquet(f"{tmp_path}/hits.parquet")
    stream = D.first_deliveries(D.delivered(spark, str(tmp_path), "hits"), "hit_id", within="500 days")
    assert [r.records for r in D.drained(D.window_counts(stream, "searched_at", "1 day"), "days").collect()] == [1]
