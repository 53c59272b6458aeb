"""The retry queue as a stream with timers: what it says last of each key is what the table of all attempts says."""

import random
import time

from pyspark.sql import functions as F

from cursus.streaming import retries


def test_timers_fire_and_the_stream_agrees_with_the_table(spark, tmp_path):
    r = random.Random(3)
    schema = "video_id string, at timestamp, ok boolean, error string"
    rows = []
    for i in range(240):
        error = r.choices(["timeout", "HTML page", "x", None], [6, 1, 4, 1])[0]
        rows.append((f"v{r.randrange(40)}", f"2024-01-01 00:{i // 60:02}:{i % 60:02}", r.random() < 0.35, error))
    made = spark.createDataFrame(rows, "video_id string, at string, ok boolean, error string").withColumn("at", F.col("at").cast("timestamp")).select("video_id", "at", "ok", "error")
    want = {x["video_id"]: (x["attempts"], x["action"]) for x in retries.retry_table(made, "2024-01-01 10:00:00").collect()}
    assert {a for _, a in want.values()} == {"retry", "skipped"}
    before = spark.conf.get(retries.STATE_STORE[0])
    spark.conf.set(*retries.STATE_STORE)
    seen: dict[str, tuple] = {}

    def note(batch, number):
        for x in batch.collect():
            seen[x["video_id"]] = (x["attempts"], x["action"])

    try:
        made.where("at < '2024-01-01 00:02:00'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = retries.retry_stream(source, wait_ms=1500).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            wait_for(lambda: any(a == "wait" for _, a in seen.values()))
            wait_for(lambda: all(a != "wait" for _, a in seen.values()))
            half = {x["video_id"]: (x["attempts"], x["action"]) for x in retries.retry_table(made.where("at < '2024-01-01 00:02:00'"), "2024-01-01 10:00:00").collect()}
            assert seen == half  # no second file yet, so nothing but the timers has come since
            made.where("at >= '2024-01-01 00:02:00'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            open_ = lambda: {k: v for k, v in seen.items() if k in want}
            wait_for(lambda: open_() == want)
        finally:
            query.stop()
    finally:
        spark.conf.set(retries.STATE_STORE[0], before)


def wait_for(done, seconds=240):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.3)
