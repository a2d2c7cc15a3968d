"""The operators as plain loops over rows, to compare with."""

from __future__ import annotations

import math
from itertools import groupby


def nbbo(quotes):
    """(day, ms, seq, bid, bid_size, ask, ask_size) -> rows of the best bid and offer with log returns, in order."""
    out, prev = [], {}
    for (day, ms), group in groupby(sorted(quotes), key=lambda q: q[:2]):
        best = None
        for _, _, _, b, bz, a, az in group:
            if best is None:
                best = [b, bz, a, az]
                continue
            if b > best[0]:
                best[:2] = [b, bz]
            if a < best[2]:
                best[2:] = [a, az]
        b, bz, a, az = best
        mid = 0.5 * (b + a)
        last = prev.get(day)
        out.append({"day": day, "ms": ms, "bid": b, "ask": a, "bid_size": bz, "ask_size": az, "mid": mid, "spread": a - b, "log_return": None if last is None else math.log(mid / last)})
        prev[day] = mid
    return out


def fill(rows, step, max_gap):
    out = []
    for r, n in zip(rows, [*rows[1:], None], strict=True):
        out.append(r)
        if n is not None and n["day"] == r["day"]:
            gap = (n["ms"] - r["ms"]) // step - 1
            if 1 <= gap <= max_gap:
                out += [{**r, "ms": r["ms"] + k * step, "log_return": 0.0} for k in range(1, gap + 1)]
    return out


def despike(rows, threshold, cap):
    """(kept rows, reasons of removed rows)"""
    kept, why, base, day = [], [], None, None
    for r in rows:
        if r["day"] != day:
            day, base = r["day"], None
        if base is not None and abs(r["mid"] - base) >= threshold:
            why.append("delta")
        elif r["mid"] > cap:
            why.append("level")
        else:
            kept.append(r)
            base = r["mid"]
    return kept, why


def events(rows, max_move):
    out, state = [], None
    for r in rows:
        if state is None or state["day"] != r["day"]:
            state = {"day": r["day"], "bid": r["bid"], "ask": r["ask"], "b": r["ms"], "a": r["ms"], "sign": 0.0, "pending": None}
        if r["bid"] != state["bid"]:
            state["bid"], state["b"] = r["bid"], r["ms"]
        if r["ask"] != state["ask"]:
            state["ask"], state["a"] = r["ask"], r["ms"]
        lr = r["log_return"]
        if lr is None or lr == 0:
            continue
        p = state["pending"]
        if p is not None:
            move = r["mid"] - p["mid"]
            if abs(move) <= max_move:
                out.append({**p, "mid_next": r["mid"], "y": (move > 0) - (move < 0), "tau_ms": r["ms"] - p["ms"]})
        total = r["bid_size"] + r["ask_size"]
        imbalance = (r["bid_size"] - r["ask_size"]) / total if total else 0.0
        state["pending"] = {"day": r["day"], "ms": r["ms"], "mid": r["mid"], "spread": r["spread"], "imbalance": imbalance, "age_diff_ms": state["a"] - state["b"], "last_move": state["sign"]}
        state["sign"] = float((lr > 0) - (lr < 0))
    return out
