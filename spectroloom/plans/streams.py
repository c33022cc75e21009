"""Streaming queries: the event table read as a stream until it is drained, its last state written and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom import streaming
from spectroloom.operators.scratch import shared_folder
from spectroloom.plans.registry import query


def drained(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    """The final result of a streaming aggregation ``of`` the events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.withColumn("at", F.col("ts").cast("timestamp"))
    root = shared_folder(spark)
    sink = of(rows).writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    sink.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_windowed_intensity", """SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS start, event_type, round(sum(value), 4) AS total, count(*) AS n, max(value) AS highest FROM events GROUP BY ALL""", paths=True)
def stream_windowed_intensity(spark, sf_dir):
    done = drained(spark, sf_dir, lambda s: streaming.windowed_intensity(s, "at", ["event_type"], "value", "6 hours", "1 hour"))
    return done.select(F.unix_timestamp("start").alias("start"), "event_type", F.round("total", 4).alias("total"), "n", "highest")


@query("stream_gap_sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000 THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, round(sum(value), 4) AS total, count(*) AS n FROM s GROUP BY user_id, session""", paths=True)
def stream_gap_sessions(spark, sf_dir):
    done = drained(spark, sf_dir, lambda s: streaming.gap_sessions(s, "at", ["user_id"], "value", "2 hours", "1 hour"))
    return done.select("user_id", F.unix_micros("start").alias("start"), F.round("total", 4).alias("total"), "n")
