"""Exact tail quantiles of log returns, and clipping or dropping beyond them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1 << 13
#: An interval that holds so many values or fewer is read, a larger one cut up.
FEW = 1 << 10


@dataclass(frozen=True)
class Cutoffs:
    lo: float | None
    hi: float | None
    n: int


def finite(c: str = "log_return") -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def ranked(df: DataFrame, column: str, quantiles: tuple[float, ...]) -> tuple[int, list[float | None]]:
    """The number N of finite values, and the exact values of 0-based ascending rank floor(q N).  Ranks beyond an end are the end's.

    Each pass cuts the interval of every rank into at most 8192 and counts, so memory and shuffle stay bounded whatever the ranks.
    """
    x = df.where(finite(column)).select(F.col(column).cast("double").alias("x"))
    least, most, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return 0, [None] * len(quantiles)
    # of each rank: its interval, the rank within, and how many values the interval holds
    at = [[least, most, min(max(math.floor(q * n), 0), n - 1), n] for q in quantiles]
    while wide := [i for i, (lo, hi, _, _) in enumerate(at) if lo < hi]:
        few = [i for i in wide if at[i][3] <= FEW]
        inside = lambda i: F.col("x").between(at[i][0], at[i][1])  # noqa: B023, E731
        if few:
            rows = x.select(F.explode(F.array_compact(F.array(*[F.when(inside(i), F.struct(F.lit(i).alias("i"), "x")) for i in few]))).alias("r")).select("r.*").collect()
            for i in few:
                value = sorted(r["x"] for r in rows if r["i"] == i)[at[i][2]]
                at[i] = [value, value, 0, 1]
            continue
        cells = []
        for i in wide:
            lo, hi, _, _ = at[i]
            width = (hi / PARTS) - (lo / PARTS)
            if not width > 0 or lo + width == lo:
                width = max(math.ulp(lo), math.ulp(hi))
            cell = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(PARTS - 1))
            cells.append(F.when(inside(i), F.struct(F.lit(i).alias("i"), cell.alias("c"), "x")))
        groups = x.select(F.explode(F.array_compact(F.array(*cells))).alias("r")).groupBy("r.i", "r.c").agg(F.count("*").alias("n"), F.min("r.x").alias("lo"), F.max("r.x").alias("hi"))
        for r in sorted(groups.collect(), key=lambda r: (r["i"], r["c"])):
            _, _, rank, left = at[r["i"]]
            if left < 0:
                continue  # the rank's cell is found
            if rank < r["n"]:
                at[r["i"]] = [r["lo"], r["hi"], rank, -r["n"]]
            else:
                at[r["i"]][2] = rank - r["n"]
        for i in wide:
            at[i][3] = abs(at[i][3])
    return n, [lo for lo, *_ in at]


def kth_smallest(df: DataFrame, column: str, k: int) -> float | None:
    """Exact value of 0-based ascending rank ``k`` among the finite values."""
    n = df.where(finite(column)).count()
    return ranked(df, column, ((k + 0.5) / n,))[1][0] if k < n else None


def cutoffs(df: DataFrame, q_lo: float, q_hi: float, column: str = "log_return") -> Cutoffs:
    """Values of 0-based ascending rank floor(q N) among the N finite values; ranks beyond the end are the end's."""
    n, (lo, hi) = ranked(df, column, (q_lo, q_hi))
    return Cutoffs(lo, hi, n)


def clip(df: DataFrame, cut: Cutoffs, column: str = "log_return") -> DataFrame:
    """Finite values beyond a cutoff become that cutoff; nothing else changes."""
    if cut.n == 0:
        return df
    kind = dict(df.dtypes)[column]
    x = F.col(column)
    return df.withColumn(column, F.when(finite(column), F.greatest(F.least(x, F.lit(cut.hi)), F.lit(cut.lo))).otherwise(x).cast(kind))


def drop(df: DataFrame, cut: Cutoffs, column: str = "log_return") -> DataFrame:
    """Rows with a finite value beyond a cutoff go; rows without one stay."""
    if cut.n == 0:
        return df
    return df.where(~finite(column) | F.col(column).between(cut.lo, cut.hi))


__all__ = ["Cutoffs", "cutoffs", "ranked", "kth_smallest", "clip", "drop", "finite"]
