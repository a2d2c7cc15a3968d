"""Best bid and offer per bucket of time, its log return, and the filled clock grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecols

KEYS = ["symbol", "day"]


def by_day(order: str = "ms") -> Window:
    """The one window of the engine: all ordered operators share its exchange and sort."""
    return Window.partitionBy(*KEYS).orderBy(order)


def consolidate(quotes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Best bid and ask of each (symbol, day, ms), each with the size of the first quote (by ``seq``) at that price.

    Venues are merged without looking at the result again, so a merged book may be locked or crossed.  Prices keep
    their type; mid and spread have it too.
    """
    bid = F.max(F.struct("bid", (-F.col("seq")).alias("s"), F.col("bid_size").alias("z"))).alias("b")
    ask = F.min(F.struct("ask", F.col("seq").alias("s"), F.col("ask_size").alias("z"))).alias("a")
    kind = dict(quotes.dtypes)["bid"]
    x = quotes.groupBy(*KEYS, "ms").agg(bid, ask)
    x = x.select(*KEYS, "ms", F.col("b.bid").alias("bid"), F.col("a.ask").alias("ask"), F.col("b.z").cast("float").alias("bid_size"), F.col("a.z").cast("float").alias("ask_size"))
    half = F.lit(0.5).cast(kind)
    return x.withColumns({"mid": (half * (F.col("bid") + F.col("ask"))).cast(kind), "spread": (F.col("ask") - F.col("bid")).cast(kind)})


def with_log_return(nbbo: DataFrame) -> DataFrame:
    """``ln(mid / previous mid)`` within the day, the quotient of the mids' own type; null on its first row and where a mid is not positive."""
    prev = F.lag("mid").over(by_day())
    kind = dict(nbbo.dtypes)["mid"]
    ok = (F.col("mid") > 0) & (prev > 0)
    return nbbo.withColumn("log_return", F.when(ok, F.log((F.col("mid") / F.when(prev > 0, prev)).cast(kind))).cast(kind))


def fill_clock(nbbo: DataFrame, step: int = 1, max_gap: int = 250) -> DataFrame:
    """Rows between two rows of a day whose gap is at most ``max_gap`` steps, as copies of the first with log return 0.

    A longer gap stays open as a whole.  Returns of true rows are those of the event grid, across any gap.
    """
    gap = F.floor((F.lead("ms").over(by_day()) - F.col("ms")) / step).cast("int") - 1
    n = F.when(gap.between(1, max_gap), gap).otherwise(0)
    x = nbbo.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    kind = dict(nbbo.dtypes)["log_return"]
    return x.withColumns({"log_return": F.when(F.col("_k") > 0, F.lit(0.0).cast(kind)).otherwise(F.col("log_return")), "ms": F.col("ms") + F.col("_k") * step}).drop("_n", "_k")


def stamped(nbbo: DataFrame) -> DataFrame:
    """The stored form: ``ts`` packed from day and ms, in the order of the stored columns."""
    names = ["mid", "log_return", "bid_size", "ask_size", "spread", "bid", "ask"]
    return nbbo.select("symbol", (F.col("day") / 10_000).cast("int").alias("year"), timecols.pack(F.col("day"), F.col("ms")).alias("ts"), *names)


def unstamped(stored: DataFrame, symbol: str | Column | None = None) -> DataFrame:
    """Stored rows with ``day`` and ``ms`` again; unsigned 64-bit ``ts`` (read as decimal) becomes a long."""
    ts = F.col("ts").cast("long")
    x = stored.withColumns({"ts": ts, "day": timecols.ymd(ts), "ms": timecols.ms_of_day(ts)})
    if symbol is not None:
        x = x.withColumn("symbol", F.lit(symbol) if isinstance(symbol, str) else symbol)
    return x
