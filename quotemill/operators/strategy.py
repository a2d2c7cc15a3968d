"""Scoring events by the model, gates, costs, and trades closed at the next surviving event."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EdgeMode, StrategyConfig
from ..functions import bins, timecols
from .histogram import Model
from .nbbo import KEYS, by_day

TRADE = ["ts_in", "ts_out", "day", "mid_in", "mid_out", "spread_in", "direction_score", "expected_edge_ret", "cost_ret", "gross_ret", "net_ret", "side"]


class Strategy(Protocol):
    """Turns paired events into trades."""

    def trades(self, paired: DataFrame) -> DataFrame: ...


def pair(events: DataFrame) -> DataFrame:
    """Each event with the next one of its day as stored: ms_out and mid_out; the day's last has none and goes."""
    x = events.withColumns({"ms_out": F.lead("ms").over(by_day()), "mid_out": F.lead("mid").over(by_day())})
    return x.where("ms_out is not null")


def costs(cfg: StrategyConfig, spread: Column, mid: Column) -> Column:
    if cfg.edge_mode == EdgeMode.LEGACY:
        return F.lit(0.0)
    return spread / mid + 2 * cfg.fee_price / mid + cfg.slip_price / mid


def gate(cfg: StrategyConfig, score: Column, edge: Column, mid: Column, mean_tau: Column) -> Column:
    """Whether an event is traded.  An unknown waiting time passes the waiting filter."""
    ok = F.lit(True)
    if cfg.min_abs_direction_score > 0:
        ok = ok & (F.abs(score) >= cfg.min_abs_direction_score)
    if cfg.edge_mode == EdgeMode.LEGACY:
        ok = ok & (edge > 0)
    elif cfg.edge_mode == EdgeMode.COST_WITH_GATE and cfg.min_expected_edge_bps > 0:
        ok = ok & (F.abs(edge) > 2 * cfg.fee_price / mid + cfg.slip_price / mid + cfg.min_expected_edge_bps * 1e-4)
    if cfg.max_mean_wait_ms > 0:
        ok = ok & (mean_tau.isNull() | (mean_tau <= cfg.max_mean_wait_ms))
    return ok


def close_trades(x: DataFrame) -> DataFrame:
    """From direction_score, expected_edge_ret and cost_ret: side, gross and net return, in trade columns."""
    side = F.when(F.col("direction_score") > 0, 1).otherwise(-1)
    x = x.withColumn("side", side).withColumn("gross_ret", F.col("side") * (F.col("mid_out") - F.col("mid")) / F.col("mid"))
    x = x.withColumn("net_ret", F.col("gross_ret") - F.col("cost_ret"))
    names = {"ts_in": timecols.pack(F.col("day"), F.col("ms")), "ts_out": timecols.pack(F.col("day"), F.col("ms_out")), "mid_in": F.col("mid"), "spread_in": F.col("spread")}
    return x.withColumns(names).select("symbol", *TRADE)


class HistogramStrategy:
    """Trades the sign of a cell's direction score."""

    def __init__(self, model: Model, cfg: StrategyConfig):
        self.model, self.cfg = model, cfg

    def scored(self, paired: DataFrame) -> DataFrame:
        """Paired events with a positive mid and spread, with their cell's D and mean waiting time, and the expected edge."""
        x = paired.where((F.col("mid") > 0) & (F.col("spread") > 0)).withColumn("cell", bins.cell_of(self.model.spec))
        cells = self.model.cells.select("cell", F.col("D").alias("direction_score"), "mean_tau_ms")
        x = x.join(F.broadcast(cells), "cell", "left")  # as many rows as the grid has cells
        return x.withColumn("expected_edge_ret", bins.expected_edge(F.col("direction_score"), F.col("spread"), F.col("mid")))

    def trades(self, paired: DataFrame) -> DataFrame:
        x = self.scored(paired)
        c = F.col
        x = x.where(gate(self.cfg, c("direction_score"), c("expected_edge_ret"), c("mid"), c("mean_tau_ms")))
        return close_trades(x.withColumn("cost_ret", costs(self.cfg, c("spread"), c("mid"))))


class PandasStrategy:
    """Adapter for a strategy written over one day of paired events as a pandas frame.

    The function adds direction_score, expected_edge_ret and cost_ret, and returns the rows to trade.
    """

    def __init__(self, function: Callable[[pd.DataFrame], pd.DataFrame]):
        self.function = function

    def trades(self, paired: DataFrame) -> DataFrame:
        f, add = self.function, {k: F.lit(0.0) for k in ("direction_score", "expected_edge_ret", "cost_ret")}
        schema = paired.withColumns(add).schema
        names = [x.name for x in schema]
        x = paired.groupBy(*KEYS).applyInPandas(lambda pdf: f(pdf.sort_values("ms"))[names], schema)
        return close_trades(x)


def backtest(events: DataFrame, strategy: Strategy) -> DataFrame:
    return strategy.trades(pair(events))
