"""Trades to daily and yearly results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _year():
    return F.floor(F.col("day") / 10_000).cast("int")


def daily_pnl(trades: DataFrame) -> DataFrame:
    """Per day with trades: count, sums, means, and the net return so far in that year.  Day 0 does not count."""
    x = trades.where("day <> 0").groupBy("symbol", _year().alias("year"), "day")
    x = x.agg(F.count("*").alias("num_trades"), F.sum("gross_ret").alias("gross_ret_sum"), F.sum("net_ret").alias("net_ret_sum"), F.avg("gross_ret").alias("gross_ret_mean"), F.avg("net_ret").alias("net_ret_mean"))
    upto = Window.partitionBy("symbol", "year").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("cumulative_net_ret", F.sum("net_ret_sum").over(upto))


def yearly_summary(trades: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Per year: net return, its basis points, trades, wins, losses, flats, and statistics of wins and losses, 0 where there are none.

    ``years`` lists the years to report, with zeros for those without trades.  Best is among wins, worst among losses.
    """
    x = trades.where("net_ret is not null").withColumn("year", _year())
    win, loss = F.col("net_ret") > 0, F.col("net_ret") < 0
    x = x.groupBy("year").agg(
        F.sum("net_ret").alias("total_net_ret"), F.count("*").alias("num_trades"), F.count_if(win).alias("num_wins"), F.count_if(loss).alias("num_losses"),
        F.count_if(F.col("net_ret") == 0).alias("num_flat"), F.sum(F.when(win, F.col("net_ret"))).alias("sum_win"), F.sum(F.when(loss, F.col("net_ret"))).alias("sum_loss"),
        F.max(F.when(win, F.col("net_ret"))).alias("max_gain"), F.min(F.when(loss, F.col("net_ret"))).alias("max_loss"),
    )
    if years is not None:
        wanted = trades.sparkSession.createDataFrame([(y,) for y in years], "year int")
        x = wanted.join(x, "year", "left")
    names = ["total_net_ret", "num_trades", "num_wins", "num_losses", "num_flat", "sum_win", "sum_loss", "max_gain", "max_loss"]
    x = x.fillna(0, names)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    return x.withColumns({
        "total_net_bps": F.col("total_net_ret") * 1e4, "win_pct": 100 * ratio("num_wins", "num_trades"), "loss_pct": 100 * ratio("num_losses", "num_trades"),
        "avg_win": ratio("sum_win", "num_wins"), "avg_loss": ratio("sum_loss", "num_losses"),
    })
