"""Sinks and sources of the stages' results: Parquet by year, JSON models, CSV, text reports."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BinSpec, NbboConfig
from ..functions import timecols
from ..operators.histogram import Model, with_tau_fallback
from ..operators.nbbo import stamped
from ..schema import DAILY, EVENTS, FOLDERS, NBBO, TRADES, require_columns
from . import files


def _by_year(x: DataFrame, order: str, day: str = "day"):
    """A writer by symbol and year.  Tasks take whole days, so a year is written by as many as it has days at most, each in order."""
    x = x.repartition("symbol", day).sortWithinPartitions("symbol", "year", order)
    return (x.drop(day) if day == "_day" else x).write.mode("overwrite").partitionBy("symbol", "year")


def _by_folder(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + FOLDERS.fields)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet by its own schema.  A table without rows has no file to tell one, and takes ``schema``; a missing path is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], _by_folder(schema))


def write_nbbo(nbbo: DataFrame, out: str, cfg: NbboConfig) -> str:
    """``out/<mode>/symbol=/year=``, the year being each row's own; a log return that is not finite is null."""
    path = f"{out}/{cfg.mode}"
    x = stamped(nbbo).withColumn("_day", timecols.ymd(F.col("ts")))
    lr = F.col("log_return")
    x = x.withColumn("log_return", F.when(~F.isnan(lr) & (F.abs(lr) != float("inf")), lr))
    _by_year(x, "ts", "_day").parquet(path)
    return path


def read_nbbo(spark: SparkSession, path: str, years: tuple[int, int] = (0, 0)) -> DataFrame:
    x = require_columns(_read(spark, path, NBBO), ["ts", "mid"], path)
    return _within(x, years)


def _within(x: DataFrame, years: tuple[int, int]) -> DataFrame:
    lo, hi = years
    if lo:
        x = x.where(F.col("year") >= lo)
    return x.where(F.col("year") <= hi) if hi else x


def write_events(events: DataFrame, out: str) -> None:
    x = events.withColumns({"ts": timecols.pack(F.col("day"), F.col("ms")), "date": F.col("day").cast("long"), "year": F.floor(F.col("day") / 10_000).cast("int")})
    _by_year(x.select("symbol", "year", *EVENTS.names), "ts", "date").parquet(out)


def read_events(spark: SparkSession, path: str, years: tuple[int, int] = (0, 0), symbol: str | None = None) -> DataFrame:
    """Stored events with day and ms; foreign files without partition folders take ``symbol``."""
    x = require_columns(_read(spark, path, EVENTS), EVENTS.names, path)
    ts = F.col("ts").cast("long")
    x = x.withColumns({"ts": ts, "day": F.col("date").cast("int"), "ms": timecols.ms_of_day(ts)})
    if "year" not in x.columns:
        x = x.withColumn("year", timecols.year(F.col("ts")))
    if symbol is not None and "symbol" not in x.columns:
        x = x.withColumn("symbol", F.lit(symbol))
    return _within(x, years)


def _kept(folder: str, settings: object) -> str:
    key = hashlib.sha256(json.dumps(asdict(settings), sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{folder}/{key}"


def materialised(df: DataFrame | Callable[[], DataFrame], folder: str, settings: object, spark: SparkSession | None = None) -> DataFrame:
    """A stage's result, stored under a hash of all its settings; an unfinished folder is never read.

    ``df`` may be a function, which is called only if nothing is stored: then the stage's sources need not be there.
    """
    path, spark = _kept(folder, settings), spark or df.sparkSession
    if not files.exists(spark, f"{path}/_SUCCESS"):
        (df() if callable(df) else df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def is_stored(spark: SparkSession, folder: str, settings: object) -> bool:
    return files.exists(spark, f"{_kept(folder, settings)}/_SUCCESS")


def model_to_dict(model: Model) -> dict:
    rows = with_tau_fallback(model.cells).orderBy("cell").collect()  # the grid's cells
    names = ["b_imb", "b_spr", "b_age", "b_last", "n", "n_up", "n_down", "sum_tau_ms", "p_up", "p_down", "D", "mean_tau_ms"]
    head = {"symbol": model.symbol, "year_lo": model.years[0], "year_hi": model.years[1], "alpha": model.alpha}
    return head | model.spec.to_dict() | {"cells": [{"idx": r["cell"]} | {k: r[k] for k in names} for r in rows]}


def write_model(model: Model, path: str) -> None:
    files.write_text(model.cells.sparkSession, path, json.dumps(model_to_dict(model), indent=1))


def read_model(spark: SparkSession, path: str) -> Model:
    """Alpha, bins and counts of a stored model; scores are worked out again.  It must have every cell."""
    data = json.loads(files.read_text(spark, path))
    spec = BinSpec.from_dict(data)
    cells = data["cells"]
    if len(cells) != spec.cells:
        raise ValueError(f"a model has {spec.cells} cells, this one {len(cells)}")
    rows = [(int(c["idx"]), int(c["n"]), int(c["n_up"]), int(c["n_down"]), float(c["sum_tau_ms"])) for c in cells]
    return Model.of_rows(spark, rows, float(data["alpha"]), spec, data.get("symbol", "SPY"), (int(data.get("year_lo", 0)), int(data.get("year_hi", 0))))


def _digits(df: DataFrame) -> DataFrame:
    """Doubles as text of ten significant digits."""
    return df.select(*[F.format_string("%.9e", c).cast("double").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_trades(trades: DataFrame, out: str) -> None:
    x = _digits(trades.select("symbol", *TRADES.names)).withColumn("year", F.floor(F.col("day") / 10_000).cast("int"))
    _by_year(x, "ts_in").option("header", True).csv(out)


def write_daily(daily: DataFrame, out: str) -> None:
    """Sums are stored whole: rounded to ten digits, they would round otherwise once more at the eighth decimal."""
    _by_year(daily.select("symbol", "year", *DAILY.names), "day", "year").option("header", True).csv(out)  # a row a day


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily results with symbol and year, none where no day had trades; a missing path or another header is an error."""
    return spark.read.schema(_by_folder(DAILY)).option("header", True).option("enforceSchema", False).csv(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades with day and net_ret, the eleventh field; lines that do not parse are left out, a missing path is an error."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    f = F.split("value", ",")
    x = raw.select(F.get(f, 2).try_cast("int").alias("day"), F.get(f, 10).try_cast("double").alias("net_ret"))
    return x.where("net_ret is not null and day is not null")


def glitch_report(by_hour: DataFrame) -> str:
    """Totals over all hours, then hours 9 to 15 of each category."""
    rows = by_hour.collect()  # categories x hours
    totals: dict[str, int] = {}
    for r in rows:
        totals[r["category"]] = totals.get(r["category"], 0) + r["n"]
    lines = ["Quote glitch report", "", "Totals:", *[f"{k:<22} : {totals[k]}" for k in sorted(totals)], "", "By hour (RTH):"]
    at = {(r["category"], r["hour"]): r["n"] for r in rows}
    for k in sorted(totals):
        lines += ["", f"[{k}]", *[f"  {h}:00 - {at.get((k, h), 0)}" for h in range(9, 16)]]
    return "\n".join(lines) + "\n"


def yearly_report(summary: DataFrame, source: str) -> str:
    rows = summary.orderBy("year").collect()  # a row a year
    head = f"{'Year':>6}  {'Total Net Ret':>15}  {'Net Ret (bps)':>20}  {'# Trades':>10}  {'Win%':>6}  {'Loss%':>6}  {'Avg Win':>8}  {'Avg Loss':>10}  {'Max Gain':>10}  {'Max Loss':>10}"
    lines = [f"Using trades directory: {source}", "Years: " + ", ".join(str(r["year"]) for r in rows), "", head, "-" * len(head)]
    for r in rows:
        lines.append(
            f"{r['year']:>6}  {r['total_net_ret']:>15.8f}  {r['total_net_bps']:>20.8f}  {r['num_trades']:>10}  {r['win_pct']:>6.2f}  {r['loss_pct']:>6.2f}"
            f"  {r['avg_win']:>8.6f}  {r['avg_loss']:>10.6f}  {r['max_gain']:>10.6f}  {r['max_loss']:>10.6f}"
        )
    return "\n".join(lines) + "\n"
