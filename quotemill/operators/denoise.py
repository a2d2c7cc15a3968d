"""Removal of price spikes against the last accepted mid of the day.

The rule is recursive: the baseline is the last row that was *kept*.  Days without any step of the threshold keep every row, which
a window shows; only the other days are scanned row by row, one (symbol, day) at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DenoiseConfig
from .nbbo import KEYS, by_day

REASONS = ("delta", "level")


def scan(mid: np.ndarray, threshold: float, cap: float, base: float | None = None) -> np.ndarray:
    """Of one day's mids in order: which are kept.  Jumps straight to the next step that reaches the threshold."""
    keep = np.ones(len(mid), bool)
    keep[mid > cap] = False
    at = np.flatnonzero(keep)
    x = mid[at]
    i = 0
    while i < len(x):
        if base is None:
            base = x[i]
            i += 1
            continue
        if abs(x[i] - base) >= threshold:
            keep[at[i]] = False
            i += 1
            continue
        steps = np.abs(np.diff(x[i:]))
        far = np.flatnonzero(steps >= threshold)
        if not len(far):
            break
        i += int(far[0]) + 1
        base = x[i - 1]
    return keep


class _Scan:
    def __init__(self, cfg: DenoiseConfig):
        self.cfg = cfg

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ms", kind="stable")
        return pdf[scan(pdf["mid"].to_numpy(float), self.cfg.threshold, self.cfg.level_cap)]


def _levelled(nbbo: DataFrame, cfg: DenoiseConfig) -> DataFrame:
    return nbbo.where(F.col("mid").isNotNull() & F.col("ms").isNotNull() & ~F.isnan("mid") & (F.col("mid") <= cfg.level_cap))


def remove_spikes(nbbo: DataFrame, cfg: DenoiseConfig = DenoiseConfig()) -> DataFrame:
    """The rows that stay, with all their columns.  Rows without ts or mid go.

    A mid above the cap never stays and never is a baseline; a row that is ``threshold`` or more away from the last kept mid goes.
    """
    x = _levelled(nbbo, cfg)
    step = F.abs(F.col("mid") - F.lag("mid").over(by_day())) >= cfg.threshold
    whole = Window.partitionBy(*KEYS)
    both = x.withColumn("_step", F.coalesce(step, F.lit(False))).withColumn("_hit", F.max("_step").over(whole)).drop("_step")
    calm = both.where("not _hit").drop("_hit")
    wild = both.where("_hit").drop("_hit").select(nbbo.columns)
    run = _Scan(cfg)
    scanned = wild.groupBy(*KEYS).applyInPandas(lambda pdf: run(pdf), nbbo.select(nbbo.columns).schema)
    return calm.select(nbbo.columns).unionByName(scanned)


def classify_spikes(nbbo: DataFrame, cfg: DenoiseConfig = DenoiseConfig()) -> DataFrame:
    """All rows with ts and mid, with ``reason``: null if kept, "delta" or else "level" if removed.

    The baseline of a row is the last kept mid before it; delta takes precedence, and before any baseline only the level counts.
    """
    usable = nbbo.where(F.col("mid").isNotNull() & F.col("ms").isNotNull() & ~F.isnan("mid"))
    kept = remove_spikes(nbbo, cfg).select(*KEYS, "ms", F.lit(True).alias("_kept"))
    x = usable.join(kept, [*KEYS, "ms"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    base = F.last(F.when(F.col("_kept"), F.col("mid")), ignorenulls=True).over(by_day().rowsBetween(-(1 << 63), -1))
    far = F.coalesce(F.abs(F.col("mid") - base) >= cfg.threshold, F.lit(False))
    return x.withColumn("reason", F.when(~F.col("_kept"), F.when(far, "delta").otherwise("level"))).drop("_kept")


def spike_days(nbbo: DataFrame, cfg: DenoiseConfig = DenoiseConfig()) -> DataFrame:
    """Per day with removals: rows removed by each reason and kept."""
    x = classify_spikes(nbbo, cfg)
    gone = lambda r: F.count_if(F.col("reason") == r)
    out = x.groupBy(*KEYS).agg(gone("delta").alias("removed_delta"), gone("level").alias("removed_level"), F.count_if(F.col("reason").isNull()).alias("kept"))
    return out.where("removed_delta + removed_level > 0")


def spike_totals(nbbo: DataFrame, cfg: DenoiseConfig = DenoiseConfig()) -> DataFrame:
    """One row: rows seen, removed by each reason, kept, and the kept ratio (1 without rows)."""
    x = classify_spikes(nbbo, cfg)
    n, kept = F.count("*"), F.count_if(F.col("reason").isNull())
    gone = lambda r: F.count_if(F.col("reason") == r)
    return x.agg(n.alias("n"), gone("delta").alias("removed_delta"), gone("level").alias("removed_level"), kept.alias("kept"), F.when(n > 0, kept / F.when(n > 0, n)).otherwise(1.0).alias("kept_ratio"))


def spike_examples(nbbo: DataFrame, cfg: DenoiseConfig = DenoiseConfig(), n: int = 10) -> DataFrame:
    """The first ``n`` removed rows."""
    return classify_spikes(nbbo, cfg).where("reason is not null").orderBy("symbol", "day", "ms").limit(n)


__all__ = ["scan", "remove_spikes", "classify_spikes", "spike_days", "spike_totals", "spike_examples"]
