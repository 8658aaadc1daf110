import datetime as dt

from gridloom.streaming.activity import windows


def test_stream_equals_batch_without_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    events = [(start + dt.timedelta(minutes=m), m % 2, m % 5) for m in range(0, 120)]
    schema = "ts timestamp, cell_id long, user_id long"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    # one event far ahead closes the windows before it
    spark.createDataFrame([(start + dt.timedelta(days=1), 0, 0)], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = windows(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    query = stream.writeStream.outputMode("append").format("memory").queryName("activity").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT window_start, cell_id, devices FROM activity").collect()}
    want = {tuple(r) for r in windows(spark.createDataFrame(events, schema)).collect()}
    assert got == want and len(want) == 16
