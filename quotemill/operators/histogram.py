"""The histogram model: counts per cell of four binned features, smoothed to direction scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinSpec
from ..functions import bins

USED = ["spread", "imbalance", "age_diff_ms", "last_move", "y", "tau_ms"]
COUNTS = ["n", "n_up", "n_down", "sum_tau_ms"]


def observed_cells(events: DataFrame, spec: BinSpec = BinSpec()) -> DataFrame:
    """Counts of each cell that occurs; rows with a null in a used column do not count."""
    x = events.dropna(subset=USED).select(bins.cell_of(spec).alias("cell"), "y", "tau_ms")
    return x.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("n_up"), F.count_if(F.col("y") < 0).alias("n_down"), F.sum("tau_ms").alias("sum_tau_ms"))


def dense_cells(observed: DataFrame, spec: BinSpec = BinSpec()) -> DataFrame:
    """Every cell of the grid, with zeros where nothing was observed."""
    grid = observed.sparkSession.range(spec.cells).select(F.col("id").cast("int").alias("cell"))
    return grid.join(F.broadcast(observed.select("cell", *COUNTS)), "cell", "left").fillna(0, COUNTS)  # at most spec.cells rows


def scored(cells: DataFrame, alpha: float = 1.0, spec: BinSpec = BinSpec()) -> DataFrame:
    """Cells with their bins, p_up, p_down, D and mean_tau_ms (null for an empty cell)."""
    up = bins.p_up(F.col("n_up"), F.col("n_down"), alpha)
    x = cells.withColumns(bins.cell_parts(F.col("cell"), spec)).withColumn("p_up", up)
    return x.withColumns({"p_down": 1 - F.col("p_up"), "D": 2 * F.col("p_up") - 1, "mean_tau_ms": bins.mean_tau(F.col("sum_tau_ms"), F.col("n"))})


def with_tau_fallback(cells: DataFrame) -> DataFrame:
    """The exported form: an empty cell's mean_tau_ms is twice the global mean (0 without data)."""
    total = cells.agg(F.sum("sum_tau_ms").alias("s"), F.sum("n").alias("k"))
    fallback = total.select(F.coalesce(2 * F.col("s") / F.when(F.col("k") > 0, F.col("k")), F.lit(0.0)).alias("_fallback"))
    return cells.crossJoin(F.broadcast(fallback)).withColumn("mean_tau_ms", F.coalesce("mean_tau_ms", "_fallback")).drop("_fallback")  # one row


def build_histogram(events: DataFrame, alpha: float = 1.0, spec: BinSpec = BinSpec()) -> DataFrame:
    return scored(dense_cells(observed_cells(events, spec), spec), alpha, spec)


@dataclass
class Model:
    """Cells to score with, and what they were built by."""

    cells: DataFrame
    alpha: float = 1.0
    spec: BinSpec = BinSpec()
    symbol: str = "SPY"
    years: tuple[int, int] = (0, 0)

    @staticmethod
    def build(events: DataFrame, alpha: float = 1.0, spec: BinSpec = BinSpec(), symbol: str = "SPY", years: tuple[int, int] = (0, 0)) -> "Model":
        return Model(build_histogram(events, alpha, spec), alpha, spec, symbol, years)

    @staticmethod
    def of_rows(spark: SparkSession, rows: list[tuple], alpha: float, spec: BinSpec, symbol: str, years: tuple[int, int]) -> "Model":
        cells = spark.createDataFrame(rows, "cell int, n long, n_up long, n_down long, sum_tau_ms double")
        return Model(scored(cells, alpha, spec), alpha, spec, symbol, years)
