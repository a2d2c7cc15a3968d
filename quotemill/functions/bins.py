"""Bins and cells of the histogram model as generated CASE expressions, and the scores of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BinSpec


def number(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _cases(pairs: list[tuple[Column, int]], other: int) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for test, value in pairs[1:]:
        out = out.when(test, value)
    return out.otherwise(other)


def imbalance(b: Column, a: Column) -> Column:
    total = b.cast("double") + a.cast("double")
    return F.when(total == 0, 0.0).otherwise((b.cast("double") - a.cast("double")) / F.when(total != 0, total))


def imbalance_bin(x: Column, spec: BinSpec) -> Column:
    """First match of the value clamped to [-1, 1]; none (as for NaN): the last bin."""
    v = F.when(~F.isnan(x), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    tests = [((v >= b.lo if b.lo_closed else v > b.lo) & (v <= b.hi if b.hi_closed else v < b.hi), i) for i, b in enumerate(spec.imbalance)]
    return _cases(tests, len(spec.imbalance) - 1)


def ticks(spread: Column, spec: BinSpec) -> Column:
    return F.round(spread / spec.tick).cast("long")


def spread_bin(spread: Column, spec: BinSpec) -> Column:
    """By whole ticks, rounded half away from zero; a spread that is not a positive number is in bin 0."""
    v = number(spread)
    k = ticks(v, spec)
    tests = [(v.isNull() | (v <= 0), 0)]
    tests += [((k >= b.lo) & (k <= b.hi if b.hi is not None else F.lit(True)), i) for i, b in enumerate(spec.spread)]
    return _cases(tests, len(spec.spread) - 1)


def age_bin(x: Column, spec: BinSpec) -> Column:
    """Open at the outer edges, the middle bin closed on both sides; NaN is in the last bin."""
    v = F.when(~F.isnan(x), x.cast("double"))
    middle, tests = len(spec.age) // 2, []
    for i, b in enumerate(spec.age):
        low = F.lit(True) if b.lo is None else (v >= b.lo if i <= middle else v > b.lo)
        high = F.lit(True) if b.hi is None else (v < b.hi if i < middle else v <= b.hi)
        tests.append((v.isNotNull() & low & high, i))
    return _cases(tests, len(spec.age) - 1)


def move_bin(x: Column, spec: BinSpec) -> Column:
    v = F.when(~F.isnan(x), x)
    return _cases([(v < -spec.move_cut, 0), (v > spec.move_cut, 2)], 1)


def cell_index(imb: Column, spr: Column, age: Column, last: Column, spec: BinSpec) -> Column:
    return (((imb * len(spec.spread) + spr) * len(spec.age) + age) * 3 + last).cast("int")


def cell_of(spec: BinSpec, imb="imbalance", spr="spread", age="age_diff_ms", last="last_move") -> Column:
    c = F.col
    return cell_index(imbalance_bin(c(imb), spec), spread_bin(c(spr), spec), age_bin(c(age), spec), move_bin(c(last), spec), spec)


def cell_parts(cell: Column, spec: BinSpec) -> dict[str, Column]:
    """The bins of a cell number."""
    last = F.pmod(cell, F.lit(3))
    rest = F.floor(cell / 3)
    age = F.pmod(rest, F.lit(len(spec.age)))
    rest = F.floor(rest / len(spec.age))
    parts = {"b_imb": F.floor(rest / len(spec.spread)), "b_spr": F.pmod(rest, F.lit(len(spec.spread))), "b_age": age, "b_last": last}
    return {k: v.cast("int") for k, v in parts.items()}


def p_up(up: Column, down: Column, alpha: float) -> Column:
    n = up + down
    return F.when(n > 0, (up + alpha) / F.when(n > 0, n + 2 * alpha)).otherwise(0.5)


def mean_tau(total: Column, n: Column) -> Column:
    """Null for an empty cell."""
    return F.when(n > 0, total / F.when(n > 0, n))


def expected_edge(score: Column, spread: Column, mid: Column) -> Column:
    return score * (spread * 0.5) / mid
