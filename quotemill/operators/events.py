"""Labelled mid-change events: state before the change, and what the next event of the day brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EventConfig
from ..functions import bins
from .nbbo import KEYS, by_day
from .winsor import finite

STATE = ["mid", "bid", "ask", "bid_size", "ask_size", "spread"]


def usable(nbbo: DataFrame) -> DataFrame:
    """Rows without a null other than the log return; the others never touch any state."""
    return nbbo.dropna(subset=["ms", *STATE])


def _age(side: str) -> Column:
    """Milliseconds since this side's price last changed, counted from the day's first row."""
    prev = F.lag(side).over(by_day())
    changed = F.when(prev.isNull() | (F.col(side) != prev), F.col("ms"))
    return changed


def with_ages(nbbo: DataFrame) -> DataFrame:
    """age_bid_ms, age_ask_ms and their difference, advanced on every row of the day."""
    upto = by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = nbbo.withColumns({"_b": _age("bid"), "_a": _age("ask")})
    since = lambda c: F.last(c, ignorenulls=True).over(upto)
    x = x.withColumns({"_b": since("_b"), "_a": since("_a")})
    ages = {"age_bid_ms": F.col("ms") - F.col("_b"), "age_ask_ms": F.col("ms") - F.col("_a"), "age_diff_ms": (F.col("_a") - F.col("_b")).cast("double")}
    return x.withColumns(ages).drop("_b", "_a")


def is_event(c: str = "log_return") -> Column:
    return finite(c) & (F.col(c) != 0)


def detected(nbbo: DataFrame) -> DataFrame:
    """Event rows with imbalance, ages, last move, and the next event's mid, label and waiting time (null for the day's last)."""
    x = with_ages(usable(nbbo)).where(is_event())
    w = by_day()
    mid = F.col("mid").cast("double")
    x = x.withColumns({"last_move": F.coalesce(F.lag(F.signum("log_return")).over(w), F.lit(0.0)), "mid_next": F.lead(mid).over(w), "_next": F.lead("ms").over(w)})
    x = x.withColumns({"mid": mid, "spread": F.col("spread").cast("double"), "imbalance": bins.imbalance(F.col("bid_size"), F.col("ask_size"))})
    return x.withColumns({"y": F.signum(F.col("mid_next") - F.col("mid")), "tau_ms": (F.col("_next") - F.col("ms")).cast("double")}).drop("_next")


def outcome(cfg: EventConfig = EventConfig()) -> Column:
    """written, boundary (the day's last event) or bigmove (a next move over the threshold)."""
    far = F.abs(F.col("mid_next") - F.col("mid")) > cfg.max_next_move
    return F.when(F.col("mid_next").isNull(), "boundary").when(far, "bigmove").otherwise("written")


def label_events(nbbo: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """Labelled events.  Dropped events stay in the chain: their neighbours still see them as next and last."""
    x = detected(nbbo).where(outcome(cfg) == "written")
    return x.select(*KEYS, "ms", "mid", "mid_next", "spread", "imbalance", "age_diff_ms", "last_move", "y", "tau_ms")


def event_counters(nbbo: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """One row: ticks, detected, written, dropped_bigmove, dropped_boundary."""
    x = with_ages(usable(nbbo)).agg(F.count("*").alias("ticks"))
    o = detected(nbbo).select(outcome(cfg).alias("o"))
    n = lambda k: F.count_if(F.col("o") == k)
    found = o.agg(F.count("*").alias("detected"), n("written").alias("written"), n("bigmove").alias("dropped_bigmove"), n("boundary").alias("dropped_boundary"))
    return x.crossJoin(found)  # one row each
