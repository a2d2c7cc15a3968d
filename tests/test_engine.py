import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.config import BinSpec, DenoiseConfig, EdgeMode, EventConfig, NbboConfig, QuoteConfig, StrategyConfig, parse_range, parse_years
from quotemill.functions import bins, timecols
from quotemill.operators import denoise, events, histogram, nbbo, pnl, quotes, strategy, winsor
from quotemill.plans.pipeline import build_nbbo
from quotemill.sources import stored
from quotemill.sources.quotes import parse_lines, read_quotes

from . import simulator

QUOTE = "symbol string, day int, ms int, tod_ms int, seq long, ex string, qc string, bid double, ask double, bid_size int, ask_size int"


def tape(spark, rows):
    """(day, ms, seq, bid, bid_size, ask, ask_size)"""
    return spark.createDataFrame([("S", d, m, m, s, "P", "R", b, a, bz, az) for d, m, s, b, bz, a, az in rows], QUOTE)


def random_tape(seed, n=400, spikes=False):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        base = 10_000 + rng.randrange(6) + (rng.choice([0, 0, 0, 20_000, 120_000]) if spikes else 0)
        rows.append((20240102 + rng.randrange(3), 36_000_000 + rng.randrange(600), seq, base / 100, rng.randrange(1, 9), (base + 1 + rng.randrange(3)) / 100, rng.randrange(1, 9)))
    return sorted(rows, key=lambda r: (r[0], r[1], r[2]))


def got(df, *cols):
    return [tuple(r) for r in df.orderBy("day", "ms").select(*cols).collect()]


def near(a, b):
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (p is not None and q is not None and math.isclose(p, q, rel_tol=1e-12, abs_tol=1e-12)) for p, q in zip(x, y, strict=True)), (x, y)


def test_worked_example(spark):
    rows = [(20240102, 36_000_000, 0, 100.00, 5, 100.02, 4), (20240102, 36_000_000, 1, 100.01, 2, 100.02, 9), (20240102, 36_000_000, 2, 100.01, 7, 100.03, 1), (20240102, 36_000_003, 3, 100.00, 1, 100.02, 1)]
    x = nbbo.with_log_return(nbbo.consolidate(tape(spark, rows)))
    a, b = x.orderBy("ms").collect()
    assert (a.bid, a.bid_size, a.ask, a.ask_size, a.log_return) == (100.01, 2, 100.02, 4, None)
    assert math.isclose(b.log_return, math.log(100.01 / 100.015), rel_tol=1e-9)
    filled = nbbo.fill_clock(x).orderBy("ms").collect()
    assert [r.ms - 36_000_000 for r in filled] == [0, 1, 2, 3] and filled[1].log_return == 0.0
    e = events.detected(x).collect()[0]
    assert (e.age_diff_ms, e.imbalance, e.last_move, e.mid_next) == (-3.0, 0.0, 0.0, None)
    assert events.detected(x).select(bins.cell_of(BinSpec()).alias("c")).first().c == 157


@pytest.mark.parametrize("seed", range(3))
def test_chain_equals_row_loops(spark, seed):
    rows = random_tape(seed, spikes=seed > 0)
    x = nbbo.with_log_return(nbbo.consolidate(tape(spark, rows)))
    want = simulator.nbbo(rows)
    cols = ("day", "ms", "bid", "ask", "bid_size", "ask_size", "mid", "log_return")
    near(got(x, *cols), [tuple(r[c] for c in cols) for r in want])
    near(got(nbbo.fill_clock(x, 1, 5), *cols), [tuple(r[c] for c in cols) for r in simulator.fill(want, 1, 5)])
    kept, why = simulator.despike(want, 100, 1000)
    y = denoise.remove_spikes(x)
    near(got(y, *cols), [tuple(r[c] for c in cols) for r in kept])
    total = denoise.spike_totals(x).first()
    assert (total.removed_delta, total.removed_level) == (why.count("delta"), why.count("level"))
    ecols = ("day", "ms", "mid", "mid_next", "imbalance", "age_diff_ms", "last_move", "y", "tau_ms")
    for source, loop in ((x, want), (y, kept)):
        near(got(events.label_events(source, EventConfig(0.02)), *ecols), [tuple(r[c] for c in ecols) for r in simulator.events(loop, 0.02)])
    c = events.event_counters(x, EventConfig(0.02)).first()
    assert c.detected == c.written + c.dropped_bigmove + c.dropped_boundary and c.ticks == len(want)


def test_scan_equals_the_rule():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        mid = rng.choice([1.0, 2.0, 90.0, 150.0, 260.0, 1001.0], rng.integers(1, 9))
        kept, _ = simulator.despike([{"day": 1, "mid": m, "i": i} for i, m in enumerate(mid)], 100, 1000)
        assert np.flatnonzero(denoise.scan(mid, 100, 1000)).tolist() == [r["i"] for r in kept]


def test_spike_edges(spark):
    def kept(mids):
        rows = [(20240102, i, i, m, 1, m, 1) for i, m in enumerate(mids)]
        x = nbbo.with_log_return(nbbo.consolidate(tape(spark, rows)))
        return [r.ms for r in denoise.remove_spikes(x).orderBy("ms").collect()]

    assert kept([10.0, 200.0, 200.0, 11.0]) == [0, 3]  # a neighbour comparison would keep the second spike
    assert kept([10.0, 110.0, 109.99]) == [0, 2]  # the threshold itself removes
    assert kept([950.0, 1000.0, 1000.5]) == [0, 1]  # the cap itself stays
    assert kept([1500.0, 20.0, 30.0]) == [1, 2]  # a day may open above the cap


def test_hours_and_categories(spark):
    ms = lambda h, m, s: ((h * 60 + m) * 60 + s) * 1000
    rows = [(20240102, t, i, 1.0, 1, 1.01, 1) for i, t in enumerate([ms(9, 29, 59), ms(9, 30, 0), ms(15, 59, 59), ms(16, 0, 0)])]
    assert [r.seq for r in quotes.good_quotes(tape(spark, rows)).orderBy("seq").collect()] == [1, 2]
    lo, hi = QuoteConfig.hours("09:30-15:45")
    cfg = QuoteConfig(open_ms=lo, close_ms=hi)
    assert [r.seq for r in quotes.good_quotes(tape(spark, rows), cfg).collect()] == [1]
    bad = [(20240102, 36_000_000, 0, 1.0, 0, 1.01, 1), (20240102, 36_000_000, 1, 1.01, 1, 1.01, 1), (20240102, 36_000_000, 2, None, 1, 1.01, 1)]
    assert {r.category: r.n for r in quotes.glitch_totals(tape(spark, bad)).collect()} == {"nonpos_field": 1, "locked_crossed": 1, "parse_fail": 1}
    assert "locked_crossed" in stored.glitch_report(quotes.glitches_by_hour(tape(spark, bad)))


def test_merged_book_may_cross(spark):
    rows = [(20240102, 1, 0, 1.00, 1, 1.02, 1), (20240102, 1, 1, 1.05, 2, 1.06, 2)]
    r = nbbo.consolidate(tape(spark, rows)).first()
    assert r.bid == 1.05 and r.ask == 1.02 and r.spread < 0


def test_lines(spark):
    lines = [
        "20240102,09:30:00.1239,PX,1.5,2,1.6,3,R,a,b,c,d,e,f,g", "20240102,09:30:00,P,,2,1.6,3,R,x", "20240102,09:30:00,P,1.5,,1.6,3,R,x", "20240102,09:30:00,P,1.5 ,2,1.6,3,R,x",
        "20240102,09:30:00,P,inf,2,1.6,3,R,x", "20240102,09:30:00,P,1e2,+2,1.6,3,R,x", "20240102,9:30,P,1,2,3,4,R,x", "short,line",
    ]
    x = parse_lines(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")).orderBy("i").collect()
    assert [r.i for r in x] == [0, 1, 2, 3, 4, 5]
    assert (x[0].ts, x[0].bid, x[0].bid_size, x[0].ex) == (20240102093000123, 1.5, 2, "PX")
    assert x[1].bid == 0 and x[2].bid_size is None and x[3].bid is None and x[4].bid is None and x[5].bid == 100 and x[5].bid_size is None
    cat = [r.category for r in quotes.classify(spark.createDataFrame(x)).orderBy("i").collect()]
    assert cat == [None, "nonpos_field", "parse_fail", "parse_fail", "parse_fail", "parse_fail"]


def test_gzip_files_to_stored_years(spark, tmp_path):
    for year in (2019, 2020, 2021):
        with gzip.open(tmp_path / f"SYM{year}.csv.gz", "wt") as f:
            f.write("date,time,ex,bid,bs,ask,as,qc,z\n")
            for i in range(5):
                f.write(f"{year}0102,10:00:0{i}.000,P,{10 + i / 100:.2f},1,{10.02 + i / 100:.2f},2,R,z\n")
    q = read_quotes(spark, str(tmp_path), "SYM", (2020, 0)).withColumnRenamed("date", "day").withColumn("ms", F.col("tod_ms"))
    assert q.count() == 10
    x = build_nbbo(q, NbboConfig())
    path = stored.write_nbbo(x, str(tmp_path / "out"), NbboConfig())
    assert path.endswith("/event")
    back = stored.read_nbbo(spark, path, (2021, 2021))
    assert back.count() == 5 and dict(back.dtypes)["mid"] == "float"
    again = nbbo.unstamped(back)
    ev = events.label_events(again)
    stored.write_events(ev, str(tmp_path / "ev"))
    assert stored.read_events(spark, str(tmp_path / "ev"), (2021, 2021)).count() == ev.count() == 3
    cached = stored.materialised(ev, str(tmp_path / "cache"), EventConfig())
    assert stored.materialised(ev.limit(0), str(tmp_path / "cache"), EventConfig()).count() == cached.count() == 3


@pytest.mark.parametrize("q", [(0.0, 0.999), (0.1, 0.9), (0.25, 0.75), (0.5, 0.5)])
def test_quantile_ranks(spark, q, monkeypatch):
    monkeypatch.setattr(winsor, "FEW", 1 if q[0] else 1 << 10)
    values = [float(v) for v in random.Random(1).sample(range(1000), 40)]
    x = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "log_return double")
    s = sorted(values)
    want = (s[math.floor(q[0] * 40)], s[math.floor(q[1] * 40)])
    c = winsor.cutoffs(x, *q)
    assert (c.lo, c.hi, c.n) == (*want, 40)
    assert [winsor.kth_smallest(x, "log_return", k) for k in (0, 17, 39, 40)] == [s[0], s[17], s[39], None]
    assert winsor.drop(x, c).where("log_return is null").count() == 1
    assert winsor.cutoffs(x.limit(0), *q).n == 0


def test_bins_and_scores(spark):
    spec = BinSpec()
    x = spark.createDataFrame([(v,) for v in (-0.7, -0.1, 0.1, 0.3, 1.2, float("nan"))], "v double")
    assert [r.b for r in x.select(bins.imbalance_bin(F.col("v"), spec).alias("b")).collect()] == [1, 3, 3, 4, 5, 5]
    x = spark.createDataFrame([(v,) for v in (-200.0, -50.0, 50.0, 200.0, 200.1, float("nan"))], "v double")
    assert [r.b for r in x.select(bins.age_bin(F.col("v"), spec).alias("b")).collect()] == [1, 2, 2, 3, 4, 4]
    x = spark.createDataFrame([(v,) for v in (0.0, -0.01, 0.01, 0.02, 0.025, float("inf"))], "v double")
    assert [r.b for r in x.select(bins.spread_bin(F.col("v"), spec).alias("b")).collect()] == [0, 0, 0, 1, 2, 0]
    empty = histogram.build_histogram(spark.createDataFrame([], "spread double, imbalance double, age_diff_ms double, last_move double, y double, tau_ms double"))
    r = empty.first()
    assert empty.count() == 270 and (r.p_up, r.D, r.mean_tau_ms) == (0.5, 0.0, None)
    one = spark.createDataFrame([(0.01, 0.0, 0.0, 0.0, 0.0, 7.0)], "spread double, imbalance double, age_diff_ms double, last_move double, y double, tau_ms double")
    r = histogram.build_histogram(one).where("n > 0").first()
    assert (r.p_up, r.mean_tau_ms) == (0.5, 7.0)
    assert {x.mean_tau_ms for x in histogram.with_tau_fallback(histogram.build_histogram(one)).collect()} == {7.0, 14.0}


def test_model_file(spark, tmp_path):
    rows = simulator.events(simulator.nbbo(random_tape(5)), 1.0)
    ev = spark.createDataFrame([(r["spread"], r["imbalance"], float(r["age_diff_ms"]), r["last_move"], float(r["y"]), float(r["tau_ms"])) for r in rows], "spread double, imbalance double, age_diff_ms double, last_move double, y double, tau_ms double")
    m = histogram.Model.build(ev, alpha=2.0, symbol="S", years=(2018, 2022))
    stored.write_model(m, str(tmp_path / "m.json"))
    back = stored.read_model(spark, str(tmp_path / "m.json"))
    assert back.alpha == 2.0 and back.spec == m.spec and back.symbol == "S"
    assert sorted(map(tuple, back.cells.select("cell", "n", "p_up").collect())) == sorted(map(tuple, m.cells.select("cell", "n", "p_up").collect()))
    (tmp_path / "bad.json").write_text('{"alpha": 1, "cells": []}')
    with pytest.raises(ValueError):
        stored.read_model(spark, str(tmp_path / "bad.json"))


def test_settings():
    assert parse_years(["2018", "2020-2022"]) == [2018, 2020, 2021, 2022] and parse_range("2018:") == (2018, 0)
    assert StrategyConfig.from_dict({}).edge_mode == EdgeMode.COST_WITH_GATE and StrategyConfig().edge_mode == EdgeMode.LEGACY
    assert StrategyConfig.from_dict({"edge_mode": 1, "legacy_mode": 1}).edge_mode == EdgeMode.LEGACY
    assert StrategyConfig.from_dict({"fee_per_leg": 1, "min_expected_edge": 3}).fee_price == 1
    assert StrategyConfig.from_dict({"fee_per_leg": 1, "fee_price": 2}).fee_price == 2
    assert BinSpec.from_dict(BinSpec().to_dict()) == BinSpec()
    loose = BinSpec.from_dict({"imbalance_bins": [{"idx": i, "lo": i, "hi": i + 1} for i in range(6)]})
    assert all(b.lo_closed and b.hi_closed for b in loose.imbalance)
    with pytest.raises(ValueError):
        BinSpec.from_dict({"spread_bins": []})
    assert NbboConfig(fill=True).mode == "clock" and NbboConfig(winsor="clip").mode == "event_winsor"


def _paired(spark, rows):
    """(ms, mid, spread, D, mean_tau)"""
    ev = spark.createDataFrame([("S", 20240102, m, mid, s, 0.0, 0.0, 0.0) for m, mid, s, _, _ in rows], "symbol string, day int, ms int, mid double, spread double, imbalance double, age_diff_ms double, last_move double")
    cells = spark.createDataFrame([(i, rows[0][3], rows[0][4]) for i in range(270)], "cell int, D double, mean_tau_ms double")
    return ev, histogram.Model(cells)


@pytest.mark.parametrize("mode,d,n,side", [(0, 0.0, 0, None), (1, 0.0, 1, -1), (2, 0.0, 1, -1), (0, 0.5, 1, 1), (0, -0.5, 0, None), (1, -0.5, 1, -1)])
def test_modes(spark, mode, d, n, side):
    ev, model = _paired(spark, [(1, 100.0, 0.02, d, None), (5, 101.0, 0.02, d, None)])
    t = strategy.backtest(ev, strategy.HistogramStrategy(model, StrategyConfig(edge_mode=EdgeMode(mode), max_mean_wait_ms=1.0))).collect()
    assert len(t) == n
    if n:
        assert t[0].side == side and math.isclose(t[0].gross_ret, side * 0.01)
        assert math.isclose(t[0].cost_ret, 0.0 if mode == 0 else 0.02 / 100 + 0.06 / 100 + 0.02 / 100)


def test_gates(spark):
    ev, model = _paired(spark, [(1, 100.0, 0.02, 0.5, 50.0), (5, 101.0, 0.02, 0.5, 50.0)])
    n = lambda **k: strategy.backtest(ev, strategy.HistogramStrategy(model, StrategyConfig(edge_mode=EdgeMode.COST_WITH_GATE, fee_price=0, slip_price=0, **k))).count()
    assert n() == 1 and n(min_expected_edge_bps=0.4) == 1 and n(min_expected_edge_bps=0.6) == 0
    assert n(max_mean_wait_ms=40) == 0 and n(max_mean_wait_ms=50) == 1 and n(min_abs_direction_score=0.6) == 0


def test_days_and_years(spark, tmp_path):
    cols = "symbol string, ts_in long, ts_out long, day int, mid_in double, mid_out double, spread_in double, direction_score double, expected_edge_ret double, cost_ret double, gross_ret double, net_ret double, side int"
    rows = [("S", 1, 2, d, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, g, g - 0.1, 1) for d, g in ((20231229, 0.5), (20231229, 0.25), (20240102, 0.1), (20240103, 0.3), (0, 9.0))]
    t = spark.createDataFrame(rows, cols)
    d = pnl.daily_pnl(t).orderBy("day").collect()
    assert [(r.day, r.num_trades) for r in d] == [(20231229, 2), (20240102, 1), (20240103, 1)]
    assert [round(r.cumulative_net_ret, 9) for r in d] == [0.55, 0.0, 0.2]
    stored.write_trades(t.where("day > 0"), str(tmp_path / "t"))
    back = stored.read_trades(spark, str(tmp_path / "t"))
    assert back.count() == 4
    y = {r.year: r for r in pnl.yearly_summary(back, [2022, 2023, 2024]).collect()}
    assert y[2022].num_trades == 0 and y[2022].win_pct == 0 and y[2022].max_loss == 0
    assert y[2023].num_wins == 2 and y[2024].num_flat == 1 and y[2024].avg_loss == 0
    assert "2023" in stored.yearly_report(pnl.yearly_summary(back, [2023]), "t")
    stored.write_daily(pnl.daily_pnl(t), str(tmp_path / "d"))


def test_times(spark):
    ts = F.col("ts")
    x = spark.createDataFrame([(20180102095959999,), (20180131235959999,), (20200228235959999,)], "ts long")
    assert [r[0] for r in x.select(timecols.add_ms(ts, 1)).collect()] == [20180102100000000, 20180201000000000, 20200229000000000]
    assert [r[0] for r in x.select(timecols.pack(timecols.ymd(ts), timecols.ms_of_day(ts))).collect()] == [r.ts for r in x.collect()]


def test_plans(spark):
    x = nbbo.with_log_return(nbbo.consolidate(tape(spark, random_tape(1, 50))))
    plan = events.label_events(x)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2, plan  # one for the buckets, one for all windows
    ev = events.label_events(x)
    plan = strategy.backtest(ev, strategy.HistogramStrategy(histogram.Model.build(ev), StrategyConfig()))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
