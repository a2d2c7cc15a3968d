"""Schemas of stored tables, and a check of required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_F, _D, _L = T.FloatType(), T.DoubleType(), T.LongType()
NBBO = _of(("ts", _L), ("mid", _F), ("log_return", _F), ("bid_size", _F), ("ask_size", _F), ("spread", _F), ("bid", _F), ("ask", _F))
EVENTS = _of(("ts", _L), ("date", _L), *[(c, _D) for c in ("mid", "mid_next", "spread", "imbalance", "age_diff_ms", "last_move", "y", "tau_ms")])
TRADES = _of(
    ("ts_in", _L), ("ts_out", _L), ("day", _L),
    *[(c, _D) for c in ("mid_in", "mid_out", "spread_in", "direction_score", "expected_edge_ret", "cost_ret", "gross_ret", "net_ret")],
    ("side", T.IntegerType()),
)
DAILY = _of(("day", T.IntegerType()), ("num_trades", _L), *[(c, _D) for c in ("gross_ret_sum", "net_ret_sum", "gross_ret_mean", "net_ret_mean", "cumulative_net_ret")])
#: Folders of tables that are stored by symbol and year.
FOLDERS = _of(("symbol", T.StringType()), ("year", T.IntegerType()))


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df
