"""The same analytics on streams: buckets closed by a watermark, and labelled events from keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EventConfig, QuoteConfig
from ..operators.quotes import good_quotes

STATE = "day_ms long, bid double, ask double, bid_from long, ask_from long, sign double, p_ms long, p_mid double, p_spread double, p_imbalance double, p_age double, p_last double"
EVENT = "symbol string, day int, ms long, mid double, mid_next double, spread double, imbalance double, age_diff_ms double, last_move double, y double, tau_ms double"
EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def nbbo_stream(quotes: DataFrame, event_time: str = "event_time", bucket: str = "1 millisecond", late: str = "10 seconds", rules: QuoteConfig = QuoteConfig()) -> DataFrame:
    """Best bid and offer per bucket; a bucket is final once the watermark has passed it (append mode)."""
    x = good_quotes(quotes, rules).withWatermark(event_time, late)
    bid = F.max(F.struct("bid", (-F.col("seq")).alias("s"), F.col("bid_size").alias("z"))).alias("b")
    ask = F.min(F.struct("ask", F.col("seq").alias("s"), F.col("ask_size").alias("z"))).alias("a")
    x = x.groupBy("symbol", "day", F.window(event_time, bucket)).agg(bid, ask, F.min("ms").alias("ms"))
    x = x.select("symbol", "day", "ms", F.col("b.bid").alias("bid"), F.col("a.ask").alias("ask"), F.col("b.z").cast("float").alias("bid_size"), F.col("a.z").cast("float").alias("ask_size"))
    return x.withColumns({"mid": F.lit(0.5) * (F.col("bid") + F.col("ask")), "spread": F.col("ask") - F.col("bid")})


def _last_change(x: np.ndarray, ms: np.ndarray, before: float | None, since: int | None) -> np.ndarray:
    """For each row, when the value last changed, counted from the first row there is."""
    changed = np.empty(len(x), bool)
    changed[:1] = before is None or x[:1] != before
    changed[1:] = x[1:] != x[:-1]
    at = np.maximum.accumulate(np.where(changed, np.arange(len(x)), -1))
    return np.where(at >= 0, ms[np.maximum(at, 0)], 0 if since is None else since)


class _Labeller:
    """One (symbol, day): ages advance on every row, an event is labelled when the next one comes, the last one never is.

    A batch is worked off as arrays.  The day's state goes when the watermark passes the session's close: by event time, so a stream
    that stands still keeps it and one that catches up gives it back.
    """

    def __init__(self, cfg: EventConfig, close_ms: int):
        self.cfg, self.close_ms = cfg, close_ms

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # the day is over: its pending event has no successor
            return
        s = list(state.get) if state.exists else [None] * 5 + [0.0] + [None] * 6
        pdf = pd.concat(list(frames)).sort_values("ms", kind="stable")  # a day's rows of one batch
        out = self._rows(key, pdf, s)
        state.update(tuple(int(v) if i in (0, 3, 4, 6) and v is not None else None if v is None else float(v) for i, v in enumerate(s)))
        day = pd.Timestamp(str(key[1]), tz="UTC")
        end = int(day.timestamp() * 1000) + max(self.close_ms, int(s[0] or 0) + 1)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out

    def _rows(self, key: tuple, pdf: pd.DataFrame, s: list) -> pd.DataFrame:
        """The events labelled by a batch; ``s`` is moved on."""
        ms, bid, ask, mid, spread, p, q, lr = (pdf[c].to_numpy(np.int64 if c == "ms" else float) for c in ("ms", "bid", "ask", "mid", "spread", "bid_size", "ask_size", "log_return"))
        bid_from, ask_from = _last_change(bid, ms, s[1], s[3]), _last_change(ask, ms, s[2], s[4])
        at = np.flatnonzero(np.isfinite(lr) & (lr != 0))
        total = (p + q)[at]
        imbalance = np.divide((p - q)[at], total, out=np.zeros(len(at)), where=total != 0)
        sign = np.sign(lr[at])
        event = [ms[at].astype(float), mid[at], spread[at], imbalance, (ask_from - bid_from)[at].astype(float), np.append(s[5], sign)[:-1] if len(at) else sign]
        s[0], s[1], s[2], s[3], s[4] = int(ms[-1]), bid[-1], ask[-1], int(bid_from[-1]), int(ask_from[-1])
        if not len(at):
            return pd.DataFrame(columns=EVENT_COLUMNS)
        if s[6] is not None:
            event = [np.append(x, y) for x, y in zip(s[6:], event, strict=True)]
        s[5], s[6:] = float(sign[-1]), [float(x[-1]) for x in event]
        step = np.diff(event[1])
        keep = np.abs(step) <= self.cfg.max_next_move
        found = {"symbol": key[0], "day": key[1], "ms": event[0][:-1].astype(np.int64), "mid": event[1][:-1], "mid_next": event[1][1:], "spread": event[2][:-1], "imbalance": event[3][:-1], "age_diff_ms": event[4][:-1], "last_move": event[5][:-1]}
        return pd.DataFrame(found | {"y": np.sign(step), "tau_ms": np.diff(event[0])})[keep]


def label_stream(nbbo: DataFrame, cfg: EventConfig = EventConfig(), late: str = "10 seconds", rules: QuoteConfig = QuoteConfig()) -> DataFrame:
    """Labelled events of a stream of NBBO rows with log returns; rows of a day must come in order from batch to batch.

    Rows later than ``late`` behind the newest are left out.
    """
    run = _Labeller(cfg, rules.close_ms)
    rows = nbbo.select("symbol", "day", "ms", "bid", "ask", "bid_size", "ask_size", "mid", "spread", "log_return").dropna(subset=["ms", "mid", "bid", "ask", "bid_size", "ask_size", "spread"])
    time = F.timestamp_millis(F.unix_date(F.to_date(F.col("day").cast("string"), "yyyyMMdd")).cast("long") * 86_400_000 + F.col("ms"))  # days are of UTC
    rows = rows.withColumn("event_time", time).withWatermark("event_time", late)
    return rows.groupBy("symbol", "day").applyInPandasWithState(lambda k, f, s: run(k, f, s), EVENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
