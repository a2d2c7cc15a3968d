import gzip
import random

from quotemill.__main__ import main, parser, run
from quotemill.plans.timing import Timings


def test_tools_end_to_end(spark, tmp_path, capsys):
    rng = random.Random(1)
    src = tmp_path / "raw"
    src.mkdir()
    for year in (2019, 2020):
        with gzip.open(src / f"SPY_{year}.csv.gz", "wt") as f:
            f.write("header\n")
            for day in (2, 3):
                for i in range(200):
                    b = 100 + rng.randrange(5) / 100
                    f.write(f"{year}01{day:02d},10:{i // 60:02d}:{i % 60:02d}.{rng.randrange(1000):03d},P,{b:.2f},{rng.randrange(9)},{b + rng.randrange(4) / 100:.2f},3,R,x\n")
    t = Timings()
    go = lambda *a: run(parser().parse_args([str(x) for x in a]), spark, t)
    go("nbbo", "--in", src, "--out", tmp_path / "nbbo", "--report", tmp_path / "glitches.txt", "--years", "2019:2020", "--winsor", "clip", "--winsor-quantiles", "0.01,0.99")
    text = (tmp_path / "glitches.txt").read_text()
    assert "nonpos_field" in text and "locked_crossed" in text and "10:00 - " in text
    go("denoise", "--in", tmp_path / "nbbo/event_winsor", "--out", tmp_path / "clean")
    go("events", "--in", tmp_path / "clean/event", "--out", tmp_path / "events")
    go("histogram", "--events-root", tmp_path / "events", "--years", "2019:2019", "--out", tmp_path / "m.json")
    (tmp_path / "s.json").write_text('{"fee_price": 0.00001, "slip_price": 0.00001, "edge_mode": 0}')
    go("backtest", tmp_path / "events", tmp_path / "m.json", tmp_path / "s.json", 2019, 2020, "--out", tmp_path / "pnl")
    go("summary", tmp_path / "pnl/trades", tmp_path / "y.txt", "2019-2020")
    rows = (tmp_path / "y.txt").read_text().splitlines()
    assert rows[1] == "Years: 2019, 2020" and rows[-1].split()[0] == "2020" and int(rows[-1].split()[3]) > 0
    assert [n for n, _ in t.entries] == ["nbbo", "denoise", "events", "histogram", "backtest", "summary"]
    t.append_to(str(tmp_path / "log/timing.txt"))
    assert "backtest" in (tmp_path / "log/timing.txt").read_text() and main is not None
