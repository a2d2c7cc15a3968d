"""Which quotes count, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QuoteConfig

PARSE_FAIL, NONPOS, LOCKED = "parse_fail", "nonpos_field", "locked_crossed"


def eligible(cfg: QuoteConfig, qc: str = "qc", ex: str = "ex", tod: str = "tod_ms") -> Column:
    """Condition, venue and trading hours; what fails here is skipped without being counted."""
    hours = (F.col(tod) >= cfg.open_ms) & (F.col(tod) < cfg.close_ms)
    return (F.col(qc) == cfg.condition) & F.substring(ex, 1, 1).isin(*cfg.venues) & hours


def category(bid="bid", ask="ask", bid_size="bid_size", ask_size="ask_size") -> Column:
    """Null for a good quote, else the glitch it is counted as."""
    b, a, p, q = (F.col(x) for x in (bid, ask, bid_size, ask_size))
    missing = b.isNull() | a.isNull() | p.isNull() | q.isNull()
    return F.when(missing, PARSE_FAIL).when((b <= 0) | (a <= 0) | (p <= 0) | (q <= 0), NONPOS).when(a <= b, LOCKED)


def classify(quotes: DataFrame, cfg: QuoteConfig = QuoteConfig()) -> DataFrame:
    return quotes.where(eligible(cfg)).withColumn("category", category())


def good_quotes(quotes: DataFrame, cfg: QuoteConfig = QuoteConfig()) -> DataFrame:
    return classify(quotes, cfg).where("category is null").drop("category")


def counted_by_hour(classified: DataFrame) -> DataFrame:
    """Bad quotes of a classified table by category and hour."""
    bad = classified.where("category is not null")
    return bad.groupBy("category", F.floor(F.col("tod_ms") / 3_600_000).cast("int").alias("hour")).agg(F.count("*").alias("n"))


def glitches_by_hour(quotes: DataFrame, cfg: QuoteConfig = QuoteConfig()) -> DataFrame:
    return counted_by_hour(classify(quotes, cfg))


def glitch_totals(quotes: DataFrame, cfg: QuoteConfig = QuoteConfig()) -> DataFrame:
    return glitches_by_hour(quotes, cfg).groupBy("category").agg(F.sum("n").alias("n"))
