from pyspark.sql import functions as F

from spectroloom import streaming


def drained(query_of, spark, tmp_path, rows, name):
    source = tmp_path / name
    frame = spark.createDataFrame(rows, "at string, run string, intensity double").withColumn("at", F.col("at").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).parquet(str(source))
    q = query_of(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


ROWS = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:03", "a", 2.0), ("2024-01-01 00:00:30", "a", 5.0), ("2024-01-01 00:01:40", "b", 9.0), ("2024-01-01 03:00:00", "z", 0.0)]


def test_windows(spark, tmp_path):
    got = drained(lambda s: streaming.windowed_intensity(s, "at", ["run"], "intensity", "10 seconds", "1 minute"), spark, tmp_path, ROWS, "windowed")
    assert sorted((r["run"], r["total"], r["n"]) for r in got) == [("a", 3.0, 2), ("a", 5.0, 1), ("b", 9.0, 1)]


def test_sessions(spark, tmp_path):
    got = drained(lambda s: streaming.gap_sessions(s, "at", ["run"], "intensity", "20 seconds", "1 minute"), spark, tmp_path, ROWS, "sessions")
    assert sorted((r["run"], r["total"], r["n"]) for r in got) == [("a", 3.0, 2), ("a", 5.0, 1), ("b", 9.0, 1)]


def test_distinct(spark, tmp_path):
    got = drained(lambda s: streaming.distinct_in_time(s, "at", ["run"], "1 hour"), spark, tmp_path, ROWS, "distinct_rows")
    assert sorted(r["run"] for r in got) == ["a", "b", "z"]


def test_progress_of_running_jobs(spark):
    import threading
    import time

    from spectroloom.streaming import progress

    def slow(batches):
        for b in batches:
            time.sleep(1)
            yield b

    assert progress.job_progress(spark).count() == 0
    job = threading.Thread(target=lambda: spark.range(0, 64, 1, 32).mapInArrow(slow, "id long").count())
    job.start()
    seen = []
    while job.is_alive():
        seen += [(r.tasks, r.done) for r in progress.job_progress(spark).collect() if r.tasks == 32]
        time.sleep(0.3)
    job.join()
    assert seen and all(0 <= d <= n for n, d in seen)
    assert progress.remaining_seconds(0.25, 10) == 30 and progress.remaining_seconds(0, 10) is None
