"""Raw quote files: ``SYM*.csv.gz``, positional fields, one header line, no quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

NUMBER = r"^(?=.{1,63}$)\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _size(c: Column) -> Column:
    return F.regexp_extract(c, r"^-?\d+$", 0).try_cast("int")


def _price(c: Column) -> Column:
    """An empty price counts as 0; trailing blanks, NaN, infinities and texts of 64 or more characters do not parse."""
    v = F.nullif(F.regexp_extract(c, NUMBER, 0).try_cast("float"), F.lit(float("inf")).cast("float"))
    return F.when(c == "", F.lit(0.0).cast("float")).otherwise(v)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with the fields of each line; lines of fewer than nine fields, or without a time or a date, are left out.

    Columns: date (int), tod_ms (ms of day), ex, bid, ask (float), bid_size, ask_size (int), qc, ts (packed).  What does not
    parse is null.
    """
    f = F.split(F.col(value), ",", 14)
    x = lines.withColumn("_f", f).where(F.size("_f") >= 9)
    at = lambda i: F.get("_f", i)
    clock = F.regexp_extract(F.substring(at(1), 1, 8), r"^(\d{2}):(\d{2}):(\d{2})$", 0)
    part = lambda k: F.substring(clock, k, 2).try_cast("int")
    ms = F.when(F.length(at(1)) >= 12, F.coalesce(F.when(F.substring(at(1), 10, 3).rlike(r"^\d+$"), F.substring(at(1), 10, 3).try_cast("int")), F.lit(0))).otherwise(0)
    x = x.withColumns({"_day": F.when(at(0).rlike(r"^\d{8}$"), at(0).try_cast("int")), "_h": part(1), "_m": part(4), "_s": part(7), "_ms": ms})
    x = x.where(F.col("_day").isNotNull() & F.col("_h").isNotNull() & F.col("_m").isNotNull() & F.col("_s").isNotNull())
    tod = F.col("_h") * 3_600_000 + F.col("_m") * 60_000 + F.col("_s") * 1000 + F.col("_ms")
    ts = F.col("_day").cast("long") * F.lit(10**9) + F.col("_h").cast("long") * 10_000_000 + F.col("_m") * 100_000 + F.col("_s") * 1000 + F.col("_ms")
    parsed = {"date": F.col("_day"), "tod_ms": tod, "ex": at(2), "bid": _price(at(3)), "bid_size": _size(at(4)), "ask": _price(at(5)), "ask_size": _size(at(6)), "qc": at(7), "ts": ts}
    # Through a generator, so that later filters use the parsed values instead of parsing again inside each predicate.
    return x.select(*lines.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in parsed.items()]))))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as ``value``, each file's first line left out, in one read."""
    return spark.read.schema("value string").options(header=True, sep="\u0001", quote="", enforceSchema=True, maxCharsPerColumn=-1).csv(path)


def read_quotes(spark: SparkSession, folder: str, symbol: str, years: tuple[int, int] = (0, 0)) -> DataFrame:
    """Quotes of all ``symbol*.csv.gz`` files whose name carries a year within ``years`` (0: open).

    A gzip file is one task, and ``seq`` numbers its lines as read, so ``(file, seq)`` is arrival order.  The header line of each
    file is dropped.  Files are read once.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^{symbol}\D?(\d{{4}})", 1).try_cast("int")
    raw = _lines(spark, f"{folder}/{symbol}*.csv.gz").select("value", F.col("_metadata.file_name").alias("file"), name.alias("file_year"))
    raw = raw.withColumn("seq", F.monotonically_increasing_id())
    lo, hi = years
    if lo:
        raw = raw.where(F.col("file_year") >= lo)
    if hi:
        raw = raw.where(F.col("file_year") <= hi)
    return parse_lines(raw).withColumn("symbol", F.lit(symbol)).drop("value")


def write_quotes(lines: DataFrame, folder: str, symbol: str, header: str = "date,time,ex,bid,bid_size,ask,ask_size,condition,more") -> None:
    """Lines (``year``, ``day``, ``seq``, ``value``) as gzip files ``<symbol>_<year>_<n>.csv.gz``; a day's lines are in one file, in order."""
    spark = lines.sparkSession
    x = lines.withColumnRenamed("value", header).repartition("year", "day").sortWithinPartitions("year", "day", "seq")
    x.select("year", header).write.partitionBy("year").options(header=True, sep="\u0001", quote="", compression="gzip", emptyValue="").csv(f"{folder}/parts-{symbol}")
    for r in x.select("year").distinct().collect():  # a row a year
        files.rename(spark, f"{folder}/parts-{symbol}/year={r['year']}", lambda k: f"{folder}/{symbol}_{r['year']}_{k}.csv.gz")  # noqa: B023


__all__ = ["parse_lines", "read_quotes", "write_quotes"]
