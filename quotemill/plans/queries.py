"""One query per operator over the tape, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AgeBin, BinSpec, EdgeMode, EventConfig, NbboConfig, StrategyConfig
from ..functions import bins, timecols
from ..operators import denoise, events, histogram, nbbo, pnl, quotes, strategy, winsor
from ..sources.files import written
from ..sources.quotes import parse_lines
from .pipeline import build_nbbo
from .tape import BUCKET_MS, quote_tape, tape_lines, tape_sql

EVENT = EventConfig(max_next_move=0.12)
SPEC = replace(BinSpec(), age=(AgeBin(None, -200_000.0), AgeBin(-200_000.0, -50_000.0), AgeBin(-50_000.0, 50_000.0), AgeBin(50_000.0, 200_000.0), AgeBin(200_000.0, None)))
QUANTILES = (0.02, 0.97)
MAX_GAP = 10
LEGACY = StrategyConfig(1e-5, 1e-5, edge_mode=EdgeMode.LEGACY)
TRADE_ALL = StrategyConfig(1e-5, 1e-5, edge_mode=EdgeMode.COST_TRADE_ALL)
GATED = StrategyConfig(1e-5, 1e-5, min_expected_edge_bps=0.05, min_abs_direction_score=0.01, edge_mode=EdgeMode.COST_WITH_GATE)
WAITING = StrategyConfig(1e-5, 1e-5, max_mean_wait_ms=400_000.0, edge_mode=EdgeMode.COST_TRADE_ALL)

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def r(c: str, digits: int = 10):
    """Rounded, with one zero only."""
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


# --- shared CTEs
GOOD = "qc = 'R' AND contains('PTQZYJK', ex) AND tod_ms >= 34200000 AND tod_ms < 57600000"
CATEGORY = "CASE WHEN bid_t <= 0 OR ask_t <= 0 OR bid_size <= 0 OR ask_size <= 0 THEN 'nonpos_field' WHEN ask_t <= bid_t THEN 'locked_crossed' END"
NBBO = f"""
good AS (SELECT * FROM tape WHERE {GOOD} AND {CATEGORY} IS NULL),
best AS (
  SELECT symbol, day, ms, max(bid_t) / 100.0::DOUBLE AS bid, min(ask_t) / 100.0::DOUBLE AS ask,
    arg_max(bid_size, bid_t * 1000000000 - seq)::DOUBLE AS bid_size, arg_min(ask_size, ask_t * 1000000000 + seq)::DOUBLE AS ask_size
  FROM good GROUP BY symbol, day, ms),
nbbo0 AS (SELECT *, 0.5::DOUBLE * (bid + ask) AS mid, ask - bid AS spread FROM best),
nbbo AS (SELECT *, ln(mid / lag(mid) OVER (PARTITION BY symbol, day ORDER BY ms)) AS log_return FROM nbbo0)
"""
BASE = tape_sql() + "," + NBBO
SPIKY = tape_sql(spiky=True) + "," + NBBO


def _events_sql(source: str) -> str:
    w = "(PARTITION BY symbol, day ORDER BY ms)"
    return f"""
chg AS (SELECT *, CASE WHEN lag(bid) OVER {w} IS NULL OR bid <> lag(bid) OVER {w} THEN ms END AS bc,
  CASE WHEN lag(ask) OVER {w} IS NULL OR ask <> lag(ask) OVER {w} THEN ms END AS ac FROM {source}),
aged AS (SELECT *, max(bc) OVER (PARTITION BY symbol, day ORDER BY ms ROWS UNBOUNDED PRECEDING) AS bo, max(ac) OVER (PARTITION BY symbol, day ORDER BY ms ROWS UNBOUNDED PRECEDING) AS ao FROM chg),
det AS (SELECT symbol, day, ms, mid, spread, CASE WHEN bid_size + ask_size = 0 THEN 0.0 ELSE (bid_size - ask_size) / (bid_size + ask_size) END AS imbalance,
  CAST(ao - bo AS DOUBLE) AS age_diff_ms, coalesce(CAST(sign(lag(log_return) OVER {w}) AS DOUBLE), 0.0) AS last_move,
  lead(mid) OVER {w} AS mid_next, lead(ms) OVER {w} AS ms_next FROM aged WHERE log_return IS NOT NULL AND log_return <> 0),
ev AS (SELECT symbol, day, ms, mid, mid_next, spread, imbalance, age_diff_ms, last_move, CAST(sign(mid_next - mid) AS DOUBLE) AS y, CAST(ms_next - ms AS DOUBLE) AS tau_ms
  FROM det WHERE mid_next IS NOT NULL AND abs(mid_next - mid) <= 0.12)
"""


EV = BASE + "," + _events_sql("nbbo")
IMB = "CASE WHEN imbalance >= -1 AND imbalance < -0.7 THEN 0 WHEN imbalance >= -0.7 AND imbalance < -0.3 THEN 1 WHEN imbalance >= -0.3 AND imbalance < -0.1 THEN 2 WHEN imbalance >= -0.1 AND imbalance <= 0.1 THEN 3 WHEN imbalance > 0.1 AND imbalance <= 0.3 THEN 4 ELSE 5 END"
SPR = "CASE WHEN spread <= 0 THEN 0 WHEN round(spread / 0.01::DOUBLE) <= 1 THEN 0 WHEN round(spread / 0.01::DOUBLE) = 2 THEN 1 ELSE 2 END"
AGE = "CASE WHEN age_diff_ms < -200000 THEN 0 WHEN age_diff_ms < -50000 THEN 1 WHEN age_diff_ms <= 50000 THEN 2 WHEN age_diff_ms <= 200000 THEN 3 ELSE 4 END"
MOVE = "CASE WHEN last_move < -0.5 THEN 0 WHEN last_move > 0.5 THEN 2 ELSE 1 END"
CELL = EV + f""",
binned AS (SELECT *, {IMB} AS b_imb, {SPR} AS b_spr, {AGE} AS b_age, {MOVE} AS b_last FROM ev),
celled AS (SELECT *, ((b_imb * 3 + b_spr) * 5 + b_age) * 3 + b_last AS cell FROM binned),
obs AS (SELECT cell, count(*) AS n, count(*) FILTER (y > 0) AS n_up, count(*) FILTER (y < 0) AS n_down, sum(tau_ms) AS sum_tau_ms FROM celled GROUP BY cell),
cells AS (SELECT g.cell, coalesce(n, 0) AS n, coalesce(n_up, 0) AS n_up, coalesce(n_down, 0) AS n_down, coalesce(sum_tau_ms, 0.0) AS sum_tau_ms,
  CASE WHEN coalesce(n_up, 0) + coalesce(n_down, 0) > 0 THEN (n_up + 1.0::DOUBLE) / (n_up + n_down + 2.0::DOUBLE) ELSE 0.5::DOUBLE END AS p_up,
  CASE WHEN n > 0 THEN sum_tau_ms / n END AS mean_tau FROM (SELECT unnest(range(0, 270)) AS cell) g LEFT JOIN obs o ON o.cell = g.cell)
"""


def _trades_sql(cost: bool, where: str) -> str:
    price = "1e-5::DOUBLE"
    return CELL + f""",
paired AS (SELECT *, lead(ms) OVER (PARTITION BY symbol, day ORDER BY ms) AS ms_out, lead(mid) OVER (PARTITION BY symbol, day ORDER BY ms) AS mid_out FROM celled),
sc AS (SELECT p.*, 2 * c.p_up - 1 AS d, (2 * c.p_up - 1) * (0.5::DOUBLE * spread) / mid AS ee, mean_tau,
  {f'spread / mid + 2 * {price} / mid + {price} / mid' if cost else '0.0::DOUBLE'} AS cost FROM paired p JOIN cells c ON c.cell = p.cell WHERE ms_out IS NOT NULL AND mid > 0 AND spread > 0),
tr0 AS (SELECT *, CASE WHEN d > 0 THEN 1 ELSE -1 END AS side FROM sc WHERE {where}),
trades AS (SELECT {_pack('ms')} AS ts_in, {_pack('ms_out')} AS ts_out, day, mid AS mid_in, mid_out, spread AS spread_in, d AS direction_score, ee AS expected_edge_ret, cost AS cost_ret,
  side * (mid_out - mid) / mid AS gross_ret, side * (mid_out - mid) / mid - cost AS net_ret, side FROM tr0)
"""


def _pack(ms: str) -> str:
    return f"CAST(day AS BIGINT) * 1000000000 + ({ms} // 3600000) * 10000000 + ({ms} // 60000 % 60) * 100000 + {ms} % 60000"


# --- quotes
@query(f"WITH {tape_sql()} SELECT seq, day, ms, ex, bid_t / 100.0::DOUBLE AS bid, ask_t / 100.0::DOUBLE AS ask, bid_size, ask_size FROM tape WHERE {GOOD} AND {CATEGORY} IS NULL")
def quote_filter(spark, sf_dir):
    return quotes.good_quotes(quote_tape(spark, sf_dir)).select("seq", "day", "ms", "ex", "bid", "ask", "bid_size", "ask_size")


@query(f"WITH {tape_sql()} SELECT {CATEGORY} AS category, CAST(tod_ms // 3600000 AS INTEGER) AS hour, count(*) AS n FROM tape WHERE {GOOD} AND {CATEGORY} IS NOT NULL GROUP BY 1, 2")
def glitch_by_hour(spark, sf_dir):
    return quotes.glitches_by_hour(quote_tape(spark, sf_dir))


@query(f"WITH {tape_sql()} SELECT {CATEGORY} AS category, count(*) AS n FROM tape WHERE {GOOD} AND {CATEGORY} IS NOT NULL GROUP BY 1")
def glitch_totals(spark, sf_dir):
    return quotes.glitch_totals(quote_tape(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


_PARSED = f"""
WITH {tape_sql()},
p AS (SELECT *, seq % 97 AS k FROM tape WHERE seq % 97 <> 9),
v AS (SELECT seq, {_pack('tod_ms')} AS ts, ex, qc, tod_ms, CAST(CASE WHEN k = 3 THEN 0.0 WHEN k IN (4, 5) THEN NULL ELSE bid_t / 100.0 END AS FLOAT) AS bid, CAST(ask_t / 100.0 AS FLOAT) AS ask,
  CASE WHEN k IN (6, 7, 8) THEN NULL ELSE bid_size END AS bid_size, ask_size FROM p)
"""


@query(_PARSED + "SELECT seq, ts, round(bid::DOUBLE, 2) AS bid, round(ask::DOUBLE, 2) AS ask, bid_size, ask_size FROM v")
def quote_parse(spark, sf_dir):
    """Field split and typed parse of quote lines, with empty, malformed and short ones among them."""
    x = parse_lines(tape_lines(quote_tape(spark, sf_dir)))
    whole = lambda c: F.col(c).cast("long").alias(c)
    two = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return x.select("seq", "ts", two("bid"), two("ask"), whole("bid_size"), whole("ask_size"))


@query(
    _PARSED + f"""SELECT CASE WHEN bid IS NULL OR bid_size IS NULL THEN 'parse_fail' WHEN bid <= 0 OR ask <= 0 OR bid_size <= 0 OR ask_size <= 0 THEN 'nonpos_field' WHEN ask <= bid THEN 'locked_crossed' ELSE 'good' END AS category, count(*) AS n
FROM v WHERE {GOOD} GROUP BY 1"""
)
def parse_categories(spark, sf_dir):
    x = quotes.classify(parse_lines(tape_lines(quote_tape(spark, sf_dir))))
    return x.groupBy(F.coalesce("category", F.lit("good")).alias("category")).agg(F.count("*").alias("n"))


# --- NBBO
def _nbbo(spark, sf_dir, spiky=False) -> DataFrame:
    return nbbo.with_log_return(nbbo.consolidate(quotes.good_quotes(quote_tape(spark, sf_dir, spiky))))


def _sizes(x: DataFrame) -> DataFrame:
    return x.withColumns({"bid_size": F.col("bid_size").cast("double"), "ask_size": F.col("ask_size").cast("double")})


@query(f"WITH {BASE} SELECT symbol, day, ms, bid, ask, bid_size, ask_size, mid, spread FROM nbbo")
def nbbo_bucket(spark, sf_dir):
    x = nbbo.consolidate(quotes.good_quotes(quote_tape(spark, sf_dir)))
    return _sizes(x).select("symbol", "day", "ms", "bid", "ask", "bid_size", "ask_size", "mid", "spread")


@query(f"WITH {BASE} SELECT day, ms, mid, round(log_return, 10) AS log_return FROM nbbo")
def nbbo_log_return(spark, sf_dir):
    return _nbbo(spark, sf_dir).select("day", "ms", "mid", r("log_return"))


FILL = f""", gap AS (SELECT *, (lead(ms) OVER (PARTITION BY symbol, day ORDER BY ms) - ms) // {BUCKET_MS} - 1 AS g FROM nbbo),
filled AS (SELECT symbol, day, ms + k * {BUCKET_MS} AS ms, bid, ask, bid_size, ask_size, mid, spread, CASE WHEN k > 0 THEN 0.0 ELSE log_return END AS log_return
  FROM (SELECT *, unnest(range(0, CASE WHEN g BETWEEN 1 AND {MAX_GAP} THEN g ELSE 0 END + 1)) AS k FROM gap))"""


def _clock(spark, sf_dir) -> DataFrame:
    return nbbo.fill_clock(_nbbo(spark, sf_dir), BUCKET_MS, MAX_GAP)


@query(f"WITH {BASE}{FILL} SELECT day, ms, bid, ask, mid, round(log_return, 10) AS log_return FROM filled")
def clock_grid_ffill(spark, sf_dir):
    return _clock(spark, sf_dir).select("day", "ms", "bid", "ask", "mid", r("log_return"))


CUT = f""", fin AS (SELECT log_return, row_number() OVER (ORDER BY log_return) - 1 AS k, count(*) OVER () AS n FROM nbbo WHERE log_return IS NOT NULL),
cut AS (SELECT max(log_return) FILTER (k = floor({QUANTILES[0]}::DOUBLE * n)) AS lo, max(log_return) FILTER (k = floor({QUANTILES[1]}::DOUBLE * n)) AS hi, max(n) AS n FROM fin)"""


@query(f"WITH {BASE}{CUT} SELECT round(lo, 10) AS lo, round(hi, 10) AS hi, n FROM cut")
def winsor_cutoffs(spark, sf_dir):
    c = winsor.cutoffs(written(_nbbo(spark, sf_dir)), *QUANTILES)
    return spark.createDataFrame([(c.lo, c.hi, c.n)], "lo double, hi double, n long").select(r("lo"), r("hi"), "n")


@query(f"WITH {BASE}{CUT} SELECT round(lo, 10) AS lo, round(hi, 10) AS hi FROM cut")
def winsor_cutoffs_refined(spark, sf_dir):
    """The same cutoffs by their ranks, one after the other."""
    x = written(_nbbo(spark, sf_dir))
    n = x.where(winsor.finite()).count()
    c = [winsor.kth_smallest(x, "log_return", int(q * n)) for q in QUANTILES]
    return spark.createDataFrame([tuple(c)], "lo double, hi double").select(r("lo"), r("hi"))


@query(f"WITH {BASE}{CUT} SELECT day, ms, mid, round(CASE WHEN log_return < lo THEN lo WHEN log_return > hi THEN hi ELSE log_return END, 10) AS log_return FROM nbbo, cut")
def winsor_clip(spark, sf_dir):
    return build_nbbo(quote_tape(spark, sf_dir), NbboConfig(winsor="clip", quantiles=QUANTILES)).select("day", "ms", "mid", r("log_return"))


@query(f"WITH {BASE}{CUT} SELECT day, ms, mid, round(log_return, 10) AS log_return FROM nbbo, cut WHERE log_return IS NULL OR (log_return >= lo AND log_return <= hi)")
def winsor_drop(spark, sf_dir):
    return build_nbbo(quote_tape(spark, sf_dir), NbboConfig(winsor="drop", quantiles=QUANTILES)).select("day", "ms", "mid", r("log_return"))


# --- denoise
KEPT = """, num AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ms) AS i FROM nbbo),
walk AS (
  SELECT symbol, day, i, ms, CASE WHEN mid > 1000 THEN NULL ELSE mid END AS base, CASE WHEN mid > 1000 THEN 'level' END AS reason FROM num WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.day, n.i, n.ms,
    CASE WHEN abs(n.mid - w.base) >= 100 OR n.mid > 1000 THEN w.base ELSE n.mid END,
    CASE WHEN abs(n.mid - w.base) >= 100 THEN 'delta' WHEN n.mid > 1000 THEN 'level' END
  FROM walk w JOIN num n ON n.symbol = w.symbol AND n.day = w.day AND n.i = w.i + 1)"""
RSPIKY = "WITH RECURSIVE " + SPIKY + KEPT


@query(f"{RSPIKY} SELECT n.day, n.ms, n.mid FROM num n JOIN walk w USING (symbol, day, i) WHERE reason IS NULL")
def denoise_kept(spark, sf_dir):
    return denoise.remove_spikes(_nbbo(spark, sf_dir, True)).select("day", "ms", "mid")


@query(f"{RSPIKY} SELECT symbol, day, count(*) FILTER (reason = 'delta') AS removed_delta, count(*) FILTER (reason = 'level') AS removed_level, count(*) FILTER (reason IS NULL) AS kept FROM walk GROUP BY 1, 2 HAVING count(reason) > 0")
def denoise_per_day(spark, sf_dir):
    return denoise.spike_days(_nbbo(spark, sf_dir, True))


@query(f"{RSPIKY} SELECT count(*) AS n, count(*) FILTER (reason = 'delta') AS removed_delta, count(*) FILTER (reason = 'level') AS removed_level, count(*) FILTER (reason IS NULL) AS kept, round(count(*) FILTER (reason IS NULL) / count(*)::DOUBLE, 10) AS kept_ratio FROM walk")
def denoise_totals(spark, sf_dir):
    return denoise.spike_totals(_nbbo(spark, sf_dir, True)).withColumn("kept_ratio", F.round("kept_ratio", 10))


@query(f"{RSPIKY} SELECT day, ms, reason FROM walk WHERE reason IS NOT NULL ORDER BY symbol, day, ms LIMIT 10")
def denoise_examples(spark, sf_dir):
    return denoise.spike_examples(_nbbo(spark, sf_dir, True)).select("day", "ms", "reason")


# --- events
@query(f"WITH {EV} SELECT day, ms, ms - bo AS age_bid_ms, ms - ao AS age_ask_ms, CAST(ao - bo AS DOUBLE) AS age_diff_ms FROM aged")
def quote_ages(spark, sf_dir):
    return events.with_ages(events.usable(_nbbo(spark, sf_dir))).select("day", "ms", "age_bid_ms", "age_ask_ms", "age_diff_ms")


EV_COLS = "day, ms, mid, mid_next, round(spread, 10) AS spread, round(imbalance, 10) AS imbalance, age_diff_ms, last_move, y, tau_ms"


def _ev(x: DataFrame) -> DataFrame:
    return x.select("day", "ms", "mid", "mid_next", r("spread"), r("imbalance"), "age_diff_ms", "last_move", "y", "tau_ms")


def _events(spark, sf_dir) -> DataFrame:
    return events.label_events(_nbbo(spark, sf_dir), EVENT)


@query(f"WITH {EV} SELECT {EV_COLS} FROM ev")
def labeled_events(spark, sf_dir):
    return _ev(_events(spark, sf_dir))


@query(f"WITH RECURSIVE {SPIKY}{KEPT}, kept AS (SELECT n.* FROM num n JOIN walk w USING (symbol, day, i) WHERE reason IS NULL), {_events_sql('kept')} SELECT {EV_COLS} FROM ev")
def labeled_events_denoised(spark, sf_dir):
    """Spikes go first; the row after one keeps its old return."""
    return _ev(events.label_events(denoise.remove_spikes(_nbbo(spark, sf_dir, True)), EVENT))


@query(f"WITH {EV} SELECT (SELECT count(*) FROM nbbo) AS ticks, count(*) AS detected, count(*) FILTER (mid_next IS NOT NULL AND abs(mid_next - mid) <= 0.12) AS written, count(*) FILTER (abs(mid_next - mid) > 0.12) AS dropped_bigmove, count(*) FILTER (mid_next IS NULL) AS dropped_boundary FROM det")
def event_counters(spark, sf_dir):
    return events.event_counters(_nbbo(spark, sf_dir), EVENT)


@query(f"WITH {BASE}{FILL}, {_events_sql('filled')} SELECT {EV_COLS} FROM ev")
def labeled_events_clock(spark, sf_dir):
    return _ev(events.label_events(_clock(spark, sf_dir), EVENT))


@query(f"WITH {EV} SELECT day // 10000 AS year, count(*) AS n FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE day % 2 = 0) GROUP BY 1")
def events_year_union(spark, sf_dir):
    """Several stored parts read as one table."""
    x = _events(spark, sf_dir)
    return x.unionByName(x.where("day % 2 = 0")).groupBy(F.expr("cast(day div 10000 as int)").alias("year")).agg(F.count("*").alias("n"))


# --- bins and model
@query(f"WITH {CELL} SELECT day, ms, b_imb, b_spr, b_age, b_last, cell FROM celled")
def cell_index(spark, sf_dir):
    c = F.col
    x = _events(spark, sf_dir).withColumns({"b_imb": bins.imbalance_bin(c("imbalance"), SPEC), "b_spr": bins.spread_bin(c("spread"), SPEC), "b_age": bins.age_bin(c("age_diff_ms"), SPEC), "b_last": bins.move_bin(c("last_move"), SPEC)})
    return x.select("day", "ms", "b_imb", "b_spr", "b_age", "b_last", bins.cell_of(SPEC).alias("cell"))


@query("SELECT CAST(c AS INTEGER) AS cell, CAST(c // 45 AS INTEGER) AS b_imb, CAST(c // 15 % 3 AS INTEGER) AS b_spr, CAST(c // 3 % 5 AS INTEGER) AS b_age, CAST(c % 3 AS INTEGER) AS b_last FROM range(270) t(c)")
def cell_decode(spark, sf_dir):
    x = spark.range(SPEC.cells).select(F.col("id").cast("int").alias("cell"))
    return x.withColumns(bins.cell_parts(F.col("cell"), SPEC))


@query(f"WITH {CELL} SELECT CAST(cell AS INTEGER) AS cell, n, n_up, n_down, sum_tau_ms FROM cells")
def histogram_cells(spark, sf_dir):
    return histogram.dense_cells(histogram.observed_cells(_events(spark, sf_dir), SPEC), SPEC)


@query(f"WITH {CELL} SELECT CAST(cell AS INTEGER) AS cell, round(p_up, 10) AS p_up, round(1 - p_up, 10) AS p_down, round(2 * p_up - 1, 10) AS D, round(coalesce(mean_tau, 2 * (SELECT sum(sum_tau_ms) / sum(n) FROM cells)), 6) AS mean_tau_ms FROM cells")
def histogram_probs(spark, sf_dir):
    x = histogram.with_tau_fallback(histogram.build_histogram(_events(spark, sf_dir), 1.0, SPEC))
    return x.select("cell", r("p_up"), r("p_down"), r("D"), r("mean_tau_ms", 6))


# --- trades
def _trades(spark, sf_dir, cfg: StrategyConfig) -> DataFrame:
    ev = _events(spark, sf_dir)
    return strategy.backtest(ev, strategy.HistogramStrategy(histogram.Model.build(ev, 1.0, SPEC), cfg))


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("ts_in", "ts_out", "day", "mid_in", "mid_out", *[r(c) for c in ("spread_in", "direction_score", "expected_edge_ret", "cost_ret", "gross_ret", "net_ret")], "side")


_ROUNDED = "SELECT ts_in, ts_out, day, mid_in, mid_out, " + ", ".join(f"round({c}, 10) + 0.0 AS {c}" for c in ("spread_in", "direction_score", "expected_edge_ret", "cost_ret", "gross_ret", "net_ret")) + ", side FROM trades"
W_GATED = "abs(d) >= 0.01 AND abs(ee) > 2 * 1e-5::DOUBLE / mid + 1e-5::DOUBLE / mid + 0.05::DOUBLE * 1e-4::DOUBLE"


@query(f"WITH {_trades_sql(False, 'ee > 0')} {_ROUNDED}")
def trades_legacy(spark, sf_dir):
    return _rounded(_trades(spark, sf_dir, LEGACY))


@query(f"WITH {_trades_sql(True, 'true')} {_ROUNDED}")
def trades_cost_all(spark, sf_dir):
    return _rounded(_trades(spark, sf_dir, TRADE_ALL))


@query(f"WITH {_trades_sql(True, W_GATED)} {_ROUNDED}")
def trades_cost_gate(spark, sf_dir):
    return _rounded(_trades(spark, sf_dir, GATED))


@query(f"WITH {_trades_sql(True, 'mean_tau IS NULL OR mean_tau <= 400000')} {_ROUNDED}")
def trades_wait_filter(spark, sf_dir):
    return _rounded(_trades(spark, sf_dir, WAITING))


@query(f"""WITH {_trades_sql(True, 'true')}, d AS (SELECT day, count(*) AS num_trades, sum(gross_ret) AS g, sum(net_ret) AS s FROM trades GROUP BY day)
SELECT CAST(day // 10000 AS INTEGER) AS year, day, num_trades, round(g, 9) AS gross_ret_sum, round(s, 9) AS net_ret_sum, round(g / num_trades, 9) AS gross_ret_mean, round(s / num_trades, 9) AS net_ret_mean,
round(sum(s) OVER (PARTITION BY day // 10000 ORDER BY day ROWS UNBOUNDED PRECEDING), 9) AS cumulative_net_ret FROM d""")
def daily_pnl(spark, sf_dir):
    x = pnl.daily_pnl(_trades(spark, sf_dir, TRADE_ALL))
    return x.select("year", "day", "num_trades", *[r(c, 9) for c in ("gross_ret_sum", "net_ret_sum", "gross_ret_mean", "net_ret_mean", "cumulative_net_ret")])


@query(f"""WITH {_trades_sql(True, 'true')}, y AS (SELECT day // 10000 AS year, sum(net_ret) AS t, count(*) AS k, count(*) FILTER (net_ret > 0) AS w, count(*) FILTER (net_ret < 0) AS l, count(*) FILTER (net_ret = 0) AS f,
sum(net_ret) FILTER (net_ret > 0) AS sw, sum(net_ret) FILTER (net_ret < 0) AS sl, max(net_ret) FILTER (net_ret > 0) AS mg, min(net_ret) FILTER (net_ret < 0) AS ml FROM trades GROUP BY 1),
years AS (SELECT unnest(range(2023, 2026)) AS year)
SELECT CAST(years.year AS INTEGER) AS year, round(coalesce(t, 0), 9) AS total_net_ret, round(coalesce(t, 0) * 1e4, 5) AS total_net_bps, coalesce(k, 0) AS num_trades, coalesce(w, 0) AS num_wins, coalesce(l, 0) AS num_losses, coalesce(f, 0) AS num_flat,
round(coalesce(100 * w / k::DOUBLE, 0), 9) AS win_pct, round(coalesce(100 * l / k::DOUBLE, 0), 9) AS loss_pct, round(coalesce(sw / w, 0), 10) AS avg_win, round(coalesce(sl / l, 0), 10) AS avg_loss, round(coalesce(mg, 0), 10) AS max_gain, round(coalesce(ml, 0), 10) AS max_loss
FROM years LEFT JOIN y USING (year)""")
def yearly_summary(spark, sf_dir):
    x = pnl.yearly_summary(_trades(spark, sf_dir, TRADE_ALL), [2023, 2024, 2025])
    return x.select("year", r("total_net_ret", 9), r("total_net_bps", 5), "num_trades", "num_wins", "num_losses", "num_flat", r("win_pct", 9), r("loss_pct", 9), r("avg_win"), r("avg_loss"), r("max_gain"), r("max_loss"))


def _follow_last_move(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf[(pdf["last_move"] != 0) & (pdf["spread"] > 0)].copy()
    x["direction_score"], x["cost_ret"] = x["last_move"], 0.0
    x["expected_edge_ret"] = x["last_move"] * 0.5 * x["spread"] / x["mid"]
    return x


@query(f"""WITH {EV}, p AS (SELECT *, lead(ms) OVER (PARTITION BY symbol, day ORDER BY ms) AS ms_out, lead(mid) OVER (PARTITION BY symbol, day ORDER BY ms) AS mid_out FROM ev)
SELECT {_pack('ms')} AS ts_in, day, CASE WHEN last_move > 0 THEN 1 ELSE -1 END AS side, round(CASE WHEN last_move > 0 THEN 1 ELSE -1 END * (mid_out - mid) / mid, 10) + 0.0 AS net_ret
FROM p WHERE ms_out IS NOT NULL AND last_move <> 0 AND spread > 0""")
def custom_strategy(spark, sf_dir):
    """A strategy of the user's own over one day's paired events."""
    x = strategy.backtest(_events(spark, sf_dir), strategy.PandasStrategy(_follow_last_move))
    return x.select("ts_in", "day", "side", r("net_ret"))


@query(f"""WITH {tape_sql()}, t AS (SELECT seq, {_pack('tod_ms')} AS ts FROM tape), u AS (SELECT *, CAST(strftime(strptime(ts::VARCHAR, '%Y%m%d%H%M%S%g') + INTERVAL 40000000 MILLISECOND, '%Y%m%d%H%M%S%g') AS BIGINT) AS soon FROM t)
SELECT seq, ts, ts // 1000000000 AS ymd, CAST(ts // 10000000000000 AS INTEGER) AS year, CAST(ts // 10000000 % 100 AS INTEGER) AS hh, CAST(ts // 100000 % 100 AS INTEGER) AS mm, CAST(ts // 1000 % 100 AS INTEGER) AS ss, CAST(ts % 1000 AS INTEGER) AS ms,
CAST((ts // 10000000 % 100) * 3600000 + (ts // 100000 % 100) * 60000 + ts % 100000 AS INTEGER) AS ms_of_day, strftime(strptime((ts // 1000000000)::VARCHAR, '%Y%m%d'), '%Y-%m-%d') AS day_text,
CAST(strftime(strptime(ts::VARCHAR, '%Y%m%d%H%M%S%g') + INTERVAL 86399999 MILLISECOND, '%Y%m%d%H%M%S%g') AS BIGINT) AS later, ts // 1000000000 = soon // 1000000000 AS same_day FROM u""")
def ts_parts(spark, sf_dir):
    ts = F.col("ts")
    x = quote_tape(spark, sf_dir).select("seq", timecols.pack(F.col("day"), F.col("tod_ms")).alias("ts"))
    return x.select(
        "seq", "ts", timecols.ymd(ts).alias("ymd"), timecols.year(ts).alias("year"), timecols.hour(ts).alias("hh"), timecols.minute(ts).alias("mm"), timecols.second(ts).alias("ss"),
        timecols.milli(ts).alias("ms"), timecols.ms_of_day(ts).alias("ms_of_day"), timecols.day_text(timecols.ymd(ts)).alias("day_text"), timecols.add_ms(ts, 86_399_999).alias("later"), timecols.same_day(ts, timecols.add_ms(ts, 40_000_000)).alias("same_day"),
    )
