from pyspark.sql import functions as F

from vellum.streaming import events

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def batch(spark):
    rows = [(i, f"2026-01-01 {i % 5:02d}:{(i * 7) % 60:02d}:00", i % 4, "view" if i % 3 else "click", float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run(df, name):
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    batch(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), SCHEMA)
    assert run(events.tumbling_counts(stream, "ts", "event_type", "value"), "tumbling") == sorted(map(tuple, events.tumbling_counts(batch(spark), "ts", "event_type", "value").collect()))
    stream = events.read_events(spark, str(tmp_path / "in"), SCHEMA)
    got = run(events.session_counts(stream, "ts", "user_id"), "sessions")
    assert got == sorted(map(tuple, events.session_counts(batch(spark), "ts", "user_id").collect())) and sum(r[3] for r in got) == 60
