"""Command line: ``python -m quotemill nbbo | denoise | events | histogram | backtest | summary``."""

from __future__ import annotations

import argparse
import functools
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BinSpec, DenoiseConfig, EventConfig, NbboConfig, QuoteConfig, StrategyConfig, parse_range, parse_years
from .operators import denoise, events, histogram, nbbo, pnl, quotes, strategy
from .plans.pipeline import stored_grid, winsorised
from .plans.timing import Timings
from .sources import files, stored
from .sources.quotes import read_quotes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quotemill", description=__doc__)
    p.add_argument("--timing-log", help="append the time of each scope to this file")
    sub = p.add_subparsers(dest="tool", required=True)
    a = sub.add_parser("nbbo", help="quote files to best bid and offer by year")
    a.add_argument("--in", dest="source", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--report")
    a.add_argument("--cache", help="folder that keeps the event and clock grids; given again, the quote files are not read")
    a.add_argument("--sym-root", default="SPY")
    a.add_argument("--years", default="0:0", help="lo:hi, 0 for open")
    a.add_argument("--clock", action="store_true")
    a.add_argument("--event", action="store_true", help="event grid without filling")
    a.add_argument("--ffill", action="store_true", help="fill short gaps; implies --clock")
    a.add_argument("--max-ffill-gap-ms", type=int, default=250)
    a.add_argument("--winsor", nargs="?", const="drop", choices=["clip", "drop"])
    a.add_argument("--winsor-quantiles", default="1e-5,0.99999")
    a.add_argument("--rth", default="09:30-16:00")
    a.add_argument("--ex", default="PTQZYJK")
    a = sub.add_parser("denoise", help="remove price spikes")
    a.add_argument("--in", dest="source", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--thr", type=float, default=100.0)
    a = sub.add_parser("events", help="labelled mid-change events")
    a.add_argument("--in", dest="source", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--threshold-next", type=float, default=1.0)
    a = sub.add_parser("histogram", help="fit the histogram model")
    a.add_argument("--events-root", required=True)
    a.add_argument("--symbol", default="SPY")
    a.add_argument("--years", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--alpha", type=float, default=1.0)
    a.add_argument("--bins-config")
    a = sub.add_parser("backtest", help="trade the model over stored events")
    for name in ("events_dir", "model", "strategy"):
        a.add_argument(name)
    a.add_argument("start", type=int)
    a.add_argument("end", type=int)
    a.add_argument("--out", default="pnl")
    a = sub.add_parser("summary", help="yearly table of trades")
    a.add_argument("trades_dir")
    a.add_argument("out_file")
    a.add_argument("years", nargs="+")
    return p


def run(args: argparse.Namespace, spark: SparkSession, timings: Timings) -> None:
    with timings.scope(args.tool):
        if args.tool == "nbbo":
            lo, hi = QuoteConfig.hours(args.rth)
            rules = QuoteConfig(venues=args.ex, open_ms=lo, close_ms=hi)
            fill = args.ffill and not args.event
            cfg = NbboConfig(args.clock and not args.event, fill, args.max_ffill_gap_ms, args.winsor, tuple(float(x) for x in args.winsor_quantiles.split(",")))
            years = parse_range(args.years)
            cache = args.cache or files.scratch_dir(spark)

            def raw() -> DataFrame:
                return read_quotes(spark, args.source, args.sym_root, years).withColumn("day", F.col("date")).withColumn("ms", F.col("tod_ms"))

            # All quotes that count or that the report counts, read and parsed once.
            once = functools.cache(lambda: files.written(quotes.classify(raw(), rules)) if args.report else quotes.classify(raw(), rules))
            source = f"{args.source}|{args.sym_root}|{years}"
            x = stored_grid(spark, cache, source, lambda: once().where("category is null").drop("category"), cfg, rules)
            stored.write_nbbo(winsorised(x, cfg), args.out, cfg)
            if args.report:
                files.write_text(spark, args.report, stored.glitch_report(quotes.counted_by_hour(once())))
        elif args.tool == "denoise":
            x, cfg = nbbo.unstamped(stored.read_nbbo(spark, args.source)), DenoiseConfig(args.thr)
            stored.write_nbbo(denoise.remove_spikes(x.drop("ts", "year"), cfg), args.out, NbboConfig())
            print(denoise.spike_totals(x, cfg).first())
        elif args.tool == "events":
            x = nbbo.unstamped(stored.read_nbbo(spark, args.source)).drop("ts", "year")
            stored.write_events(events.label_events(x, EventConfig(args.threshold_next)), args.out)
            print(events.event_counters(x, EventConfig(args.threshold_next)).first())
        elif args.tool == "histogram":
            spec = BinSpec.load(args.bins_config) if args.bins_config else BinSpec()
            years = parse_range(args.years)
            ev = stored.read_events(spark, args.events_root, years, args.symbol)
            stored.write_model(histogram.Model.build(ev, args.alpha, spec, args.symbol, years), args.out)
        elif args.tool == "backtest":
            model = stored.read_model(spark, args.model)
            ev = stored.read_events(spark, args.events_dir, (args.start, args.end), model.symbol)
            trades = strategy.backtest(ev, strategy.HistogramStrategy(model, StrategyConfig.load(args.strategy)))
            stored.write_trades(trades, f"{args.out}/trades")
            stored.write_daily(pnl.daily_pnl(trades), f"{args.out}/daily")
        else:
            s = pnl.yearly_summary(stored.read_trades(spark, args.trades_dir), parse_years(args.years))
            files.write_text(spark, args.out_file, stored.yearly_report(s, args.trades_dir))


def main(argv: list[str] | None = None) -> None:
    args, timings = parser().parse_args(argv), Timings()
    spark = SparkSession.builder.appName(f"quotemill {args.tool}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(args, spark, timings)
    print(json.dumps({name: round(s, 3) for name, s in timings.entries}), file=sys.stderr)
    if args.timing_log:
        timings.append_to(args.timing_log)


if __name__ == "__main__":
    main()
