"""Stages that are kept: what they read again and what they do not."""

import gzip

import pytest

from quotemill.__main__ import parser, run
from quotemill.config import NbboConfig, QuoteConfig
from quotemill.plans.pipeline import stored_grid
from quotemill.plans.timing import Timings
from quotemill.sources import files, stored
from quotemill.sources.quotes import read_quotes

from .test_engine import random_tape, tape


def test_raw_files_are_read_once(spark, tmp_path):
    """A kept grid needs no quote files, and a plan has a single scan of them."""
    raw = tmp_path / "raw"
    raw.mkdir()
    with gzip.open(raw / "SPY_2020.csv.gz", "wt") as f:
        f.write("header,with,commas\n")
        for i in range(50):
            f.write(f'20200102,10:00:{i:02d}.000,P,{10 + i % 3 / 100:.2f},1,{10.05 + i % 3 / 100:.2f},2,R,"z\n')
    q = read_quotes(spark, str(raw), "SPY")
    assert q.count() == 50 and q._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    go = lambda *a: run(parser().parse_args([str(x) for x in ("nbbo", "--in", raw, "--cache", tmp_path / "cache", *a)]), spark, Timings())
    go("--out", tmp_path / "a")
    (raw / "SPY_2020.csv.gz").unlink()
    go("--out", tmp_path / "b", "--ffill", "--max-ffill-gap-ms", "2000")
    event, clock = (spark.read.parquet(str(tmp_path / x)) for x in ("a/event", "b/clock"))
    assert event.count() == 50 and clock.count() == 49 * 1000 + 1
    with pytest.raises(Exception):  # noqa: B017
        go("--out", tmp_path / "c", "--ex", "Q")  # other rules are another grid


def test_settings_are_the_key(spark, tmp_path):
    x, calls = tape(spark, random_tape(3, 100)), []
    grid = lambda cfg, rules=QuoteConfig(): stored_grid(spark, str(tmp_path), "here", lambda: calls.append(1) or x, cfg, rules).count()
    one = grid(NbboConfig())
    assert grid(NbboConfig(winsor="clip")) == one and grid(NbboConfig(fill=True, max_fill_gap=3)) >= one and len(calls) == 1
    grid(NbboConfig(), QuoteConfig(venues="P"))
    assert len(calls) == 2


def test_texts_in_any_store(spark, tmp_path):
    path = f"file://{tmp_path}/sub/a.txt"
    files.write_text(spark, path, "é\nx")
    assert files.read_text(spark, path) == "é\nx" and files.exists(spark, path) and not files.exists(spark, path + "x")


@pytest.mark.parametrize("n", [0, 6000])
def test_stored_tables_without_rows(spark, tmp_path, n):
    """No quotes at all, or so many a minute that every book is crossed, and no event has a spread to trade on: tables without rows, of the same columns."""
    import datetime

    from quotemill.plans.roundtrips import stored_daily, stored_events, stored_nbbo, stored_trades

    full, at = {}, datetime.datetime(2024, 1, 2, 12, tzinfo=datetime.timezone.utc)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    few = [(i, at + datetime.timedelta(seconds=37 * i), i, "view", i % 7 / 100) for i in range(300)]
    many = [(i, at + datetime.timedelta(seconds=i // 10), 1 + i % 7, "view", i % 13 / 100) for i in range(n)]
    for name, rows in (("few", few), ("many", many)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "events.parquet"))
    for f in (stored_daily, stored_trades, stored_events, stored_nbbo):
        full[f], got = f(spark, str(tmp_path / "few")), f(spark, str(tmp_path / "many"))
        assert got.dtypes == full[f].dtypes and full[f].count() > 0
        assert (got.count() == 0) == (n == 0 or f in (stored_daily, stored_trades))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stored.read_daily(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stored.read_events(spark, str(tmp_path / "none"))


def test_daily_results_are_stored_whole(spark, tmp_path):
    """A sum just under a tie rounds as it does before it is stored."""
    row = ("S", 2024, 20240102, 3, -0.5, -1.07281569499, 0.1 + 0.2, 1 / 3, 1.07281569499)
    names = "symbol string, year int, day int, num_trades long, gross_ret_sum double, net_ret_sum double, gross_ret_mean double, net_ret_mean double, cumulative_net_ret double"
    stored.write_daily(spark.createDataFrame([row], names), str(tmp_path / "d"))
    back = spark.read.option("header", True).csv(str(tmp_path / "d")).collect()
    assert [float(back[0][c]) for c in ("gross_ret_sum", "net_ret_sum", "gross_ret_mean", "net_ret_mean", "cumulative_net_ret")] == list(row[4:])
    got = stored.read_daily(spark, str(tmp_path / "d")).collect()[0].asDict()
    assert got == dict(zip([x.split()[0] for x in names.split(", ")], row, strict=True))
