"""The stages put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..config import BinSpec, DenoiseConfig, EventConfig, NbboConfig, QuoteConfig, StrategyConfig
from ..operators import winsor
from ..operators.denoise import remove_spikes
from ..operators.events import label_events
from ..operators.histogram import Model
from ..operators.nbbo import consolidate, fill_clock, with_log_return
from ..operators.quotes import good_quotes
from ..operators.strategy import HistogramStrategy, backtest
from ..sources import stored
from ..sources.files import written


@dataclass(frozen=True)
class _Grid:
    """What a stored grid depends on: its source, which quotes count, and how it is filled."""

    source: str
    rules: QuoteConfig
    clock: bool = False
    max_fill_gap: int = 0
    step: int = 1


def stored_grid(spark: SparkSession, cache: str, source: str, quotes: Callable[[], DataFrame], cfg: NbboConfig = NbboConfig(), rules: QuoteConfig = QuoteConfig(), step: int = 1) -> DataFrame:
    """The event grid, or the filled clock grid, kept below ``cache``.

    ``quotes`` is called only if the event grid of this ``source`` and these rules is not stored, so a clock grid is filled from stored
    events without the raw files.
    """
    event = _Grid(source, rules)
    if not (cfg.clock and cfg.fill):
        return stored.materialised(lambda: with_log_return(consolidate(good_quotes(quotes(), rules))), f"{cache}/event", event, spark)
    clock = replace(event, clock=True, max_fill_gap=cfg.max_fill_gap, step=step)
    return stored.materialised(lambda: fill_clock(stored_grid(spark, cache, source, quotes, NbboConfig(), rules), step, cfg.max_fill_gap), f"{cache}/clock", clock, spark)


def winsorised(x: DataFrame, cfg: NbboConfig) -> DataFrame:
    if not cfg.winsor:
        return x
    cut = winsor.cutoffs(x, *cfg.quantiles)
    return winsor.clip(x, cut) if cfg.winsor == "clip" else winsor.drop(x, cut)


def build_nbbo(quotes: DataFrame, cfg: NbboConfig = NbboConfig(), rules: QuoteConfig = QuoteConfig(), step: int = 1) -> DataFrame:
    """Quotes -> best bid and offer with log returns, on the event or the filled clock grid, winsorised if asked for."""
    x = with_log_return(consolidate(good_quotes(quotes, rules)))
    if cfg.clock and cfg.fill:
        x = fill_clock(x, step, cfg.max_fill_gap)
    return winsorised(written(x), cfg) if cfg.winsor else x  # cutoffs take several passes


def build_events(nbbo: DataFrame, denoise: DenoiseConfig | None = DenoiseConfig(), cfg: EventConfig = EventConfig()) -> DataFrame:
    return label_events(remove_spikes(nbbo, denoise) if denoise else nbbo, cfg)


def run_backtest(train: DataFrame, test: DataFrame, strategy: StrategyConfig, alpha: float = 1.0, spec: BinSpec = BinSpec()) -> DataFrame:
    """Trades on ``test`` by a model of ``train``; the two may be separate ranges."""
    return backtest(test, HistogramStrategy(Model.build(train, alpha, spec), strategy))
