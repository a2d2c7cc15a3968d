"""A quote tape derived from the ``events`` table, with the same integer formulas as the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_MS = 60_000

TAPE_SQL = """
raw AS (
  SELECT event_id AS seq, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, CAST(extract(day FROM ts) AS BIGINT) AS dom, user_id, event_type,
    CAST(round(value * 100) AS BIGINT) AS cents,
    32400000 + ((CAST(extract(hour FROM ts) AS BIGINT) * 3600 + CAST(extract(minute FROM ts) AS BIGINT) * 60 + CAST(floor(extract(second FROM ts)) AS BIGINT)) * 1000) * 27000000 // 86400000 AS tod_ms
  FROM events),
based AS (
  SELECT *, tod_ms // {bucket} AS bucket,
    27000 + ((tod_ms // {bucket}) * 7 + dom * 5) % 23 + CASE WHEN seq % 31 = 0 THEN 4 ELSE 0 END {spikes} AS base FROM raw),
tape AS (
  SELECT 'SYN' AS symbol, day, bucket * {bucket} AS ms, tod_ms, seq, substr('PTQZYJKXN', CAST(user_id % 9 AS INTEGER) + 1, 1) AS ex,
    CASE WHEN event_type = 'error' THEN 'O' ELSE 'R' END AS qc, base - cents % 3 AS bid_t,
    CASE WHEN user_id % 10 = 0 THEN base - cents % 3 - seq % 2 ELSE base + 1 + seq % 3 END AS ask_t,
    (seq * 7) % 11 AS bid_size, (seq * 5) % 13 + 1 AS ask_size FROM based)
"""
SPIKES = "+ CASE WHEN seq % 211 IN (0, 1) THEN 20000 WHEN seq % 499 IN (0, 1, 2) THEN 100000 ELSE 0 END"


def tape_sql(spiky: bool = False, bucket: int = BUCKET_MS) -> str:
    return TAPE_SQL.format(bucket=bucket, spikes=SPIKES if spiky else "")


def quote_tape(spark: SparkSession, sf_dir: str, spiky: bool = False, bucket: int = BUCKET_MS) -> DataFrame:
    return tape_of(spark.read.parquet(f"{sf_dir}/events.parquet"), spiky, bucket)


def tape_of(events: DataFrame, spiky: bool = False, bucket: int = BUCKET_MS) -> DataFrame:
    """symbol, day, ms (start of the bucket), tod_ms, seq, ex, qc, bid, ask, bid_size, ask_size; prices are whole ticks of 0.01."""
    tod = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    x = events.select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyyMMdd").cast("int").alias("day"), F.dayofmonth("ts").cast("long").alias("dom"), "user_id", "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"), F.lit(32_400_000).cast("long").alias("_open"), tod.cast("long").alias("tod"),
    )
    x = x.withColumn("tod_ms", F.expr("_open + (tod * 1000) * 27000000 div 86400000")).withColumn("bucket", F.expr(f"tod_ms div {bucket}"))
    base = F.expr(f"27000 + (bucket * 7 + dom * 5) % 23 + CASE WHEN seq % 31 = 0 THEN 4 ELSE 0 END {SPIKES if spiky else ''}")
    x = x.withColumn("base", base).withColumn("bid_t", F.expr("base - cents % 3"))
    x = x.withColumn("ask_t", F.expr("CASE WHEN user_id % 10 = 0 THEN base - cents % 3 - seq % 2 ELSE base + 1 + seq % 3 END"))
    return x.select(
        F.lit("SYN").alias("symbol"), "day", (F.col("bucket") * bucket).alias("ms"), "tod_ms", "seq", F.expr("substr('PTQZYJKXN', cast(user_id % 9 as int) + 1, 1)").alias("ex"),
        F.when(F.col("event_type") == "error", "O").otherwise("R").alias("qc"), (F.col("bid_t") / F.lit(100.0)).alias("bid"), (F.col("ask_t") / F.lit(100.0)).alias("ask"),
        F.expr("(seq * 7) % 11").alias("bid_size"), F.expr("(seq * 5) % 13 + 1").alias("ask_size"),
    )


def tape_lines(tape: DataFrame) -> DataFrame:
    """The tape as lines of a quote file, some with what the parser has to cope with; ``seq`` beside ``value``."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    t = F.col("tod_ms")
    clock = F.concat_ws(":", two(F.expr("tod_ms div 3600000")), two(F.expr("tod_ms div 60000 % 60")), two(F.expr("tod_ms div 1000 % 60")))
    clock = F.concat(clock, F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"), F.lit("999"))
    text = lambda c: F.col(c).cast("string")
    odd = lambda k, v, c: F.when(F.col("seq") % 97 == k, v).otherwise(c)
    bid = odd(3, "", odd(4, "12.5x", odd(5, "nan", F.format_string("%.2f", "bid"))))
    size = odd(6, "", odd(7, "4.5", odd(8, " 4", text("bid_size"))))
    line = F.concat_ws(",", text("day"), clock, "ex", bid, size, F.format_string("%.2f", "ask"), text("ask_size"), "qc", F.lit("x"), F.lit("y"))
    return tape.select("seq", F.when(F.col("seq") % 97 == 9, F.lit("20240101,09:30:00,P,1")).otherwise(line).alias("value"))
