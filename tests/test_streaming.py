from quotemill.config import EventConfig
from quotemill.operators import events, nbbo
from quotemill.streaming.live import label_stream, nbbo_stream

from .test_engine import QUOTE, random_tape, tape


def _run(df, tmp_path, name):
    path = str(tmp_path / name)
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}.chk").trigger(availableNow=True).start(path)
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(path)


def test_buckets(spark, tmp_path):
    rows = random_tape(2, 200)
    batch = tape(spark, rows).selectExpr("*", "timestamp_millis(unix_millis(to_timestamp(cast(day as string), 'yyyyMMdd')) + ms) as event_time")
    # a last quote far ahead lets the watermark pass all others
    end = tape(spark, [(20240110, 40_000_000, 999_999, 1.0, 1, 1.01, 1)]).selectExpr("*", "timestamp_millis(unix_millis(to_timestamp(cast(day as string), 'yyyyMMdd')) + ms) as event_time")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(QUOTE + ", event_time timestamp").parquet(str(tmp_path / "in"))
    out = _run(nbbo_stream(stream), tmp_path, "out")
    cols = ["day", "ms", "bid", "ask", "bid_size", "ask_size"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, nbbo.consolidate(tape(spark, rows)).select(cols).collect()))


def test_labels(spark, tmp_path):
    x = nbbo.with_log_return(nbbo.consolidate(tape(spark, random_tape(4, 300))))
    days = sorted(r.day for r in x.select("day").distinct().collect())
    for day in days:
        for lo, hi in [(0, 36_000_300), (36_000_300, 99_000_000)]:
            x.where(f"day = {day} and ms >= {lo} and ms < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    q = label_stream(stream, EventConfig(0.02)).writeStream.format("parquet").option("checkpointLocation", f"{path}.chk").trigger(availableNow=True).start(path)
    q.awaitTermination(200)
    out = spark.read.parquet(path)
    cols = ["day", "ms", "mid", "mid_next", "spread", "imbalance", "age_diff_ms", "last_move", "y", "tau_ms"]
    want = events.label_events(x, EventConfig(0.02)).select(cols)
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, want.collect()))
    # the state of a day goes once the watermark has passed the session's close
    assert len(days) > 1 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
