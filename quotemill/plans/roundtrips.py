"""Queries through the sources, sinks and streams: what is written and read again has to be what the SQL says of the tape."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinSpec, NbboConfig, StrategyConfig, parse_range, parse_years
from ..functions import timecols
from ..operators import events, histogram, nbbo, pnl, quotes
from ..sources import files, stored
from ..sources.quotes import read_quotes, write_quotes
from ..streaming.live import label_stream, nbbo_stream
from .pipeline import build_nbbo, stored_grid
from .queries import BASE, CATEGORY, CELL, CUT, EV, EVENT, FILL, GOOD, MAX_GAP, QUANTILES, SPEC, TRADE_ALL, _events, _nbbo, _pack, _trades, _trades_sql, query, r
from .tape import BUCKET_MS, quote_tape, tape_lines, tape_sql
from .timing import Timings

FILE_YEAR = "2023 + day % 3"
#: The tape at the precision of quote files: prices of 32 bits, a bucket a millisecond.
FLOAT_NBBO = f"""
kept AS (SELECT *, CAST(bid_t / 100.0 AS FLOAT) AS b, CAST(ask_t / 100.0 AS FLOAT) AS a FROM tape WHERE {FILE_YEAR} >= 2024 AND {GOOD} AND bid_t > 0 AND bid_size > 0 AND ask_size > 0 AND ask_t > bid_t AND seq % 97 NOT IN (3, 4, 5, 6, 7, 8, 9)),
fbest AS (SELECT day, tod_ms, max(b) AS bid, min(a) AS ask, arg_max(bid_size, bid_t * 1000000000 - seq) AS bid_size, arg_min(ask_size, ask_t * 1000000000 + seq) AS ask_size FROM kept GROUP BY day, tod_ms),
fnbbo0 AS (SELECT *, CAST(0.5 AS FLOAT) * (bid + ask) AS mid, ask - bid AS spread FROM fbest),
fnbbo AS (SELECT *, CAST(ln(CAST(CAST(mid / lag(mid) OVER (PARTITION BY day ORDER BY tod_ms) AS FLOAT) AS DOUBLE)) AS FLOAT) AS log_return FROM fnbbo0)
"""


def _raw(spark: SparkSession, sf_dir: str) -> str:
    """The tape as quote files, the years in their names by day, beside a file of another symbol."""
    folder = files.scratch_dir(spark)
    tape = quote_tape(spark, sf_dir)
    lines = tape_lines(tape).join(tape.select("seq", "day", F.expr(f"cast({FILE_YEAR} as int)").alias("year")), "seq")
    write_quotes(lines, folder, "SYN")
    write_quotes(lines.limit(9), folder, "OTHER")
    return folder


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_quotes(spark, _raw(spark, sf_dir), "SYN", parse_range("2024:0"))


_LINES = f"""
WITH {tape_sql()}, p AS (SELECT *, seq % 97 AS k FROM tape WHERE seq % 97 <> 9 AND {FILE_YEAR} >= 2024)
SELECT 'SYN' AS symbol, CAST({FILE_YEAR} AS INTEGER) AS file_year, {_pack('tod_ms')} AS ts, ex, qc, round(CASE WHEN k = 3 THEN 0.0 WHEN k IN (4, 5) THEN NULL ELSE bid_t / 100.0 END, 2) AS bid, round(ask_t / 100.0, 2) AS ask,
  CASE WHEN k IN (6, 7, 8) THEN NULL ELSE bid_size END AS bid_size, ask_size FROM p"""


@query(_LINES)
def raw_files(spark, sf_dir):
    """Discovery by symbol and year of the file's name, gzip lines, headers, fields."""
    two = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    x = _quotes(spark, sf_dir)
    return x.select("symbol", "file_year", "ts", "ex", "qc", two("bid"), two("ask"), F.col("bid_size").cast("long").alias("bid_size"), F.col("ask_size").cast("long").alias("ask_size"))


def _float_nbbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quotes(spark, sf_dir).withColumnRenamed("date", "day").withColumn("ms", F.col("tod_ms"))
    return nbbo.with_log_return(nbbo.consolidate(quotes.good_quotes(q)))


@query(f"WITH {tape_sql()}, {FLOAT_NBBO} SELECT day, tod_ms AS ms, bid::DOUBLE AS bid, ask::DOUBLE AS ask, bid_size::DOUBLE AS bid_size, ask_size::DOUBLE AS ask_size, mid::DOUBLE AS mid, spread::DOUBLE AS spread, round(log_return::DOUBLE, 9) AS log_return FROM fnbbo")
def raw_files_nbbo(spark, sf_dir):
    """Prices of 32 bits from the files to the log return; quotes of one millisecond in the order of their lines."""
    x = _float_nbbo(spark, sf_dir)
    assert dict(x.dtypes)["log_return"] == "float"
    wide = lambda c: F.col(c).cast("double").alias(c)
    return x.select("day", F.col("ms").cast("long").alias("ms"), *[wide(c) for c in ("bid", "ask", "bid_size", "ask_size", "mid", "spread")], F.round(F.col("log_return").cast("double"), 9).alias("log_return"))


CLIPPED = "CASE WHEN log_return < lo THEN lo WHEN log_return > hi THEN hi ELSE log_return END"


@query(f"WITH {BASE}{CUT} SELECT 'SYN' AS symbol, CAST(day // 10000 AS INTEGER) AS year, {_pack('ms')} AS ts, mid, round({CLIPPED}, 10) AS log_return, 'event_winsor' AS folder FROM nbbo, cut")
def stored_nbbo(spark, sf_dir):
    """Years as folders, the name of the mode, a projected scan; the day is in the time alone."""
    cfg, folder = NbboConfig(winsor="clip", quantiles=QUANTILES), files.scratch_dir(spark)
    path = stored.write_nbbo(build_nbbo(quote_tape(spark, sf_dir), cfg), folder, cfg)
    x = stored.read_nbbo(spark, path, (2000, 2100))
    x = x.withColumns({c: F.col(c).cast("double") for c in ("mid", "log_return")})
    return x.select("symbol", "year", "ts", "mid", r("log_return"), F.lit(path.removeprefix(f"{folder}/")).alias("folder"))


@query(f"WITH {EV} SELECT {_pack('ms')} AS ts, CAST(day AS BIGINT) AS date, day, ms, mid, mid_next, round(spread, 10) AS spread, round(imbalance, 10) AS imbalance, age_diff_ms, last_move, y, tau_ms FROM ev")
def stored_events(spark, sf_dir):
    folder = files.scratch_dir(spark)
    stored.write_events(_events(spark, sf_dir), folder)
    x = stored.read_events(spark, folder, (2000, 0))
    return x.select("ts", "date", "day", F.col("ms").cast("long").alias("ms"), "mid", "mid_next", r("spread"), r("imbalance"), "age_diff_ms", "last_move", "y", "tau_ms")


@query(f"WITH {CELL} SELECT CAST(cell AS INTEGER) AS cell, n, n_up, n_down, round(p_up, 10) AS p_up, 'SYN' AS symbol, 2020 AS year_lo, 2030 AS year_hi, 1.0::DOUBLE AS alpha FROM cells")
def stored_model(spark, sf_dir):
    """The model as JSON, its bins with it."""
    path = f"{files.scratch_dir(spark)}/model.json"
    stored.write_model(histogram.Model.build(_events(spark, sf_dir), 1.0, SPEC, "SYN", (2020, 2030)), path)
    m = stored.read_model(spark, path)
    assert m.spec == SPEC
    return m.cells.select("cell", "n", "n_up", "n_down", r("p_up"), F.lit(m.symbol).alias("symbol"), F.lit(m.years[0]).alias("year_lo"), F.lit(m.years[1]).alias("year_hi"), F.lit(m.alpha).alias("alpha"))


@query(f"WITH {_trades_sql(True, 'true')} SELECT CAST(day AS INTEGER) AS day, round(net_ret, 10) + 0.0 AS net_ret FROM trades")
def stored_trades(spark, sf_dir):
    """Trades as CSV, read by the places of their fields."""
    folder = files.scratch_dir(spark)
    stored.write_trades(_trades(spark, sf_dir, TRADE_ALL), folder)
    return stored.read_trades(spark, folder).select("day", r("net_ret"))


@query(f"""WITH {_trades_sql(True, 'true')}, d AS (SELECT day, count(*) AS num_trades, sum(net_ret) AS s FROM trades GROUP BY day)
SELECT CAST(day // 10000 AS INTEGER) AS year, CAST(day AS INTEGER) AS day, num_trades, round(s, 8) + 0.0 AS net_ret_sum, round(sum(s) OVER (PARTITION BY day // 10000 ORDER BY day ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS cumulative_net_ret FROM d""")
def stored_daily(spark, sf_dir):
    folder = files.scratch_dir(spark)
    stored.write_daily(pnl.daily_pnl(_trades(spark, sf_dir, TRADE_ALL)), folder)
    x = stored.read_daily(spark, folder)
    return x.select("year", "day", "num_trades", r("net_ret_sum", 8), r("cumulative_net_ret", 8))


@query(f"""WITH {tape_sql()}, g AS (SELECT {CATEGORY} AS category, CAST(tod_ms // 3600000 AS INTEGER) AS hour, count(*) AS n FROM tape WHERE {GOOD} AND {CATEGORY} IS NOT NULL GROUP BY 1, 2),
c AS (SELECT category, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1)
SELECT c.category, h.hour, coalesce(g.n, 0) AS n, total FROM c CROSS JOIN (SELECT CAST(unnest(range(9, 16)) AS INTEGER) AS hour) h LEFT JOIN g ON g.category = c.category AND g.hour = h.hour""")
def glitch_report(spark, sf_dir):
    """The text report, written and taken apart again."""
    path = f"{files.scratch_dir(spark)}/report.txt"
    files.write_text(spark, path, stored.glitch_report(quotes.glitches_by_hour(quote_tape(spark, sf_dir))))
    totals, rows, own = {}, [], ""
    for line in files.read_text(spark, path).splitlines():
        if " : " in line:
            name, _, n = line.partition(" : ")
            totals[name.strip()] = int(n)
        elif line.startswith("["):
            own = line[1:-1]
        elif ":00 - " in line:
            hour, _, n = line.partition(":00 - ")
            rows.append((own, int(hour), int(n), totals[own]))
    return spark.createDataFrame(rows, "category string, hour int, n long, total long")


@query(f"""WITH {_trades_sql(True, 'true')}, y AS (SELECT day // 10000 AS year, sum(net_ret) AS t, count(*) AS k, count(*) FILTER (net_ret > 0) AS w FROM trades GROUP BY 1)
SELECT CAST(years.year AS INTEGER) AS year, round(coalesce(t, 0), 8) + 0.0 AS total_net_ret, coalesce(k, 0) AS num_trades, round(coalesce(100 * w / k::DOUBLE, 0), 2) AS win_pct FROM (SELECT unnest(range(2023, 2026)) AS year) years LEFT JOIN y USING (year)""")
def yearly_report(spark, sf_dir):
    path = f"{files.scratch_dir(spark)}/years.txt"
    files.write_text(spark, path, stored.yearly_report(pnl.yearly_summary(_trades(spark, sf_dir, TRADE_ALL), parse_years(["2023", "2024-2025"])), "trades"))
    rows = [line.split() for line in files.read_text(spark, path).splitlines() if line.strip()[:2] == "20"]
    return spark.createDataFrame([(int(x[0]), float(x[1]) + 0.0, int(x[3]), float(x[4])) for x in rows], "year int, total_net_ret double, num_trades long, win_pct double")


@query(f"WITH {BASE} SELECT day, ms, mid, round(log_return, 10) AS log_return, 1 AS reads FROM nbbo")
def kept_stage(spark, sf_dir):
    """The event grid of a stage that is asked for three times: its quotes are read once, and an unfinished folder not at all."""
    cache, reads = files.scratch_dir(spark), []

    def source() -> DataFrame:
        reads.append(1)
        return quote_tape(spark, sf_dir)

    for _ in range(3):
        x = stored_grid(spark, cache, sf_dir, source)
    return x.select("day", "ms", "mid", r("log_return"), F.lit(len(reads)).alias("reads"))


@query(f"WITH {BASE}{FILL} SELECT day, ms, mid, round(log_return, 10) AS log_return, 1 AS reads FROM filled")
def clock_from_kept_events(spark, sf_dir):
    """The clock grid filled from a kept event grid, without the quotes."""
    cache, reads = files.scratch_dir(spark), []

    def source() -> DataFrame:
        reads.append(1)
        return quote_tape(spark, sf_dir)

    stored_grid(spark, cache, sf_dir, source)
    x = stored_grid(spark, cache, sf_dir, source, NbboConfig(fill=True, max_fill_gap=MAX_GAP), step=BUCKET_MS)
    return x.select("day", "ms", "mid", r("log_return"), F.lit(len(reads)).alias("reads"))


@query("SELECT CAST(unnest([2018, 2020, 2021, 2022]) AS INTEGER) AS year")
def year_lists(spark, sf_dir):
    return spark.createDataFrame([(y,) for y in parse_years(["2020-2022", "2018", "2021"])], "year int")


@query("SELECT 0.25::DOUBLE AS fee_price, 0.02::DOUBLE AS slip_price, 3.0::DOUBLE AS min_expected_edge_bps, 0 AS edge_mode, 270 AS cells, -0.6::DOUBLE AS first_hi, 'clock_winsor' AS mode")
def settings_from_json(spark, sf_dir):
    """Settings as data: aliases, the mode that wins, bins that are given and those that are not."""
    folder = files.scratch_dir(spark)
    files.write_text(spark, f"{folder}/strategy.json", json.dumps({"fee_per_leg": 0.25, "min_expected_edge": 3, "legacy_mode": 1, "edge_mode": 2}))
    bins = [{"idx": i, "lo": lo, "hi": hi, "interval": "[)"} for i, (lo, hi) in enumerate([(-1, -0.6), (-0.6, -0.3), (-0.3, -0.1), (-0.1, 0.1), (0.1, 0.3), (0.3, 1)])]
    files.write_text(spark, f"{folder}/bins.json", json.dumps({"imbalance_bins": bins}))
    s = StrategyConfig.from_dict(json.loads(files.read_text(spark, f"{folder}/strategy.json")))
    b = BinSpec.from_dict(json.loads(files.read_text(spark, f"{folder}/bins.json")))
    row = (s.fee_price, s.slip_price, s.min_expected_edge_bps, int(s.edge_mode), b.cells, b.imbalance[0].hi, NbboConfig(fill=True, winsor="drop").mode)
    return spark.createDataFrame([row], "fee_price double, slip_price double, min_expected_edge_bps double, edge_mode int, cells int, first_hi double, mode string")


@query("SELECT unnest(['events', 'nbbo']) AS scope, CAST(unnest([1, 2]) AS BIGINT) AS times, true AS timed")
def scope_timings(spark, sf_dir):
    """Scope timers and their log: how often each scope ran."""
    t = Timings()
    for name in ("nbbo", "events", "nbbo"):
        with t.scope(name):
            time.sleep(0.001)
    rows = [line.split() for line in t.report().splitlines()]
    return spark.createDataFrame([(x[0], int(x[1]), float(x[3]) > 0) for x in rows], "scope string, times long, timed boolean")


# --- rows with nulls
def _with_nulls(x: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    gone = F.expr("ms div 60000 % 11 = 3")
    return x.withColumns({c: F.when(~gone, F.col(c)) for c in columns})


@query(f"WITH {EV.replace('FROM nbbo)', 'FROM nbbo WHERE ms // 60000 % 11 <> 3)', 1)} SELECT day, ms, mid, mid_next, round(imbalance, 10) AS imbalance, age_diff_ms, last_move, y, tau_ms FROM ev")
def labeled_events_nulls(spark, sf_dir):
    """Rows without a price or a size never touch any state."""
    x = events.label_events(_with_nulls(_nbbo(spark, sf_dir), ("bid", "ask_size")), EVENT)
    return x.select("day", "ms", "mid", "mid_next", r("imbalance"), "age_diff_ms", "last_move", "y", "tau_ms")


@query(f"WITH {CELL.replace('FROM celled GROUP BY cell', 'FROM celled WHERE ms // 60000 % 11 <> 3 GROUP BY cell')} SELECT CAST(cell AS INTEGER) AS cell, n, n_up, n_down, sum_tau_ms FROM cells")
def histogram_nulls(spark, sf_dir):
    """Events with a null in a used column do not count."""
    x = _with_nulls(_events(spark, sf_dir), ("tau_ms", "spread"))
    return histogram.dense_cells(histogram.observed_cells(x, SPEC), SPEC)


# --- streams
def _streamed(spark: SparkSession, x: DataFrame, run, end: DataFrame) -> DataFrame:
    """``x`` through a stream, the days in two batches, then ``end``, a row far ahead that lets the watermark pass all others."""
    folder = files.scratch_dir(spark)
    days = sorted(d["day"] for d in x.select("day").distinct().collect())  # a row a day
    at = lambda d: F.timestamp_millis(F.unix_date(F.to_date(d.cast("string"), "yyyyMMdd")).cast("long") * 86_400_000 + F.col("ms"))
    middle = F.lit(days[len(days) // 2] if days else 0)
    for part in (x.where(F.col("day") < middle), x.where(F.col("day") >= middle), end.limit(1).withColumn("day", F.lit(20991231))):
        part.withColumn("event_time", at(F.col("day"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = run(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("day <> 20991231")


@query(f"WITH {BASE} SELECT symbol, day, ms, bid, ask, bid_size, ask_size, mid, spread FROM nbbo")
def stream_nbbo(spark, sf_dir):
    """Buckets closed by the watermark."""
    tape = quote_tape(spark, sf_dir)
    x = _streamed(spark, tape, nbbo_stream, quotes.good_quotes(tape))
    wide = lambda c: F.col(c).cast("double").alias(c)
    return x.select("symbol", "day", "ms", "bid", "ask", wide("bid_size"), wide("ask_size"), "mid", "spread")


@query(f"WITH {EV} SELECT symbol, day, ms, mid, mid_next, round(spread, 10) AS spread, round(imbalance, 10) AS imbalance, age_diff_ms, last_move, y, tau_ms FROM ev")
def stream_events(spark, sf_dir):
    """Labels from keyed state, which goes with the day."""
    x = _nbbo(spark, sf_dir)
    return _streamed(spark, x, lambda s: label_stream(s, EVENT), x).select("symbol", "day", "ms", "mid", "mid_next", r("spread"), r("imbalance"), "age_diff_ms", "last_move", "y", "tau_ms")
