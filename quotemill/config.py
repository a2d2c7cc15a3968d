"""Settings of every stage as plain dataclasses, with JSON loaders."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import IntEnum
from pathlib import Path


class EdgeMode(IntEnum):
    LEGACY = 0
    COST_TRADE_ALL = 1
    COST_WITH_GATE = 2


@dataclass(frozen=True)
class QuoteConfig:
    """What makes a quote usable."""

    condition: str = "R"
    venues: str = "PTQZYJK"
    open_ms: int = 34_200_000  # 09:30
    close_ms: int = 57_600_000  # 16:00, not included

    @staticmethod
    def hours(text: str) -> tuple[int, int]:
        """Milliseconds of ``HH:MM-HH:MM``."""
        a, b = text.split("-")
        return tuple(int(x[:2]) * 3_600_000 + int(x[3:5]) * 60_000 for x in (a, b))


@dataclass(frozen=True)
class NbboConfig:
    clock: bool = False
    fill: bool = False
    max_fill_gap: int = 250
    winsor: str | None = None  # None, "clip" or "drop"
    quantiles: tuple[float, float] = (1e-5, 1 - 1e-5)

    def __post_init__(self):
        if self.winsor not in (None, "clip", "drop"):
            raise ValueError(f"winsor must be None, 'clip' or 'drop', not {self.winsor!r}")
        if self.fill and not self.clock:
            object.__setattr__(self, "clock", True)

    @property
    def mode(self) -> str:
        """Name of the output folder."""
        return ("clock" if self.clock else "event") + ("_winsor" if self.winsor else "")


@dataclass(frozen=True)
class DenoiseConfig:
    threshold: float = 100.0
    level_cap: float = 1000.0


@dataclass(frozen=True)
class EventConfig:
    max_next_move: float = 1.0


@dataclass(frozen=True)
class ImbalanceBin:
    lo: float
    hi: float
    lo_closed: bool
    hi_closed: bool


@dataclass(frozen=True)
class SpreadBin:
    lo: int
    hi: int | None


@dataclass(frozen=True)
class AgeBin:
    lo: float | None
    hi: float | None


# Bin edges of the standard model.
IMBALANCE = (
    ImbalanceBin(-1.0, -0.7, True, False),
    ImbalanceBin(-0.7, -0.3, True, False),
    ImbalanceBin(-0.3, -0.1, True, False),
    ImbalanceBin(-0.1, 0.1, True, True),
    ImbalanceBin(0.1, 0.3, False, True),
    ImbalanceBin(0.3, 1.0, False, True),
)
SPREAD = (SpreadBin(0, 1), SpreadBin(2, 2), SpreadBin(3, None))
AGE = (AgeBin(None, -200.0), AgeBin(-200.0, -50.0), AgeBin(-50.0, 50.0), AgeBin(50.0, 200.0), AgeBin(200.0, None))


@dataclass(frozen=True)
class BinSpec:
    imbalance: tuple[ImbalanceBin, ...] = IMBALANCE
    spread: tuple[SpreadBin, ...] = SPREAD
    age: tuple[AgeBin, ...] = AGE
    move_cut: float = 0.5
    tick: float = 0.01

    @property
    def cells(self) -> int:
        return len(self.imbalance) * len(self.spread) * len(self.age) * 3

    @staticmethod
    def from_dict(data: dict) -> "BinSpec":
        """Bins of a JSON object; a part that is absent keeps its standard bins.  ``last_move_bins`` and alpha are not read."""

        def placed(key: str, standard: tuple, make) -> tuple:
            if key not in data:
                return standard
            rows = data[key]
            if not isinstance(rows, list) or len(rows) != len(standard):
                raise ValueError(f"{key} must have {len(standard)} bins")
            out = list(standard)
            for row in rows:
                if not 0 <= row["idx"] < len(standard):
                    raise ValueError(f"{key}: idx {row['idx']} is out of range")
                out[row["idx"]] = make(row)
            return tuple(out)

        def imbalance(row: dict) -> ImbalanceBin:
            text = row.get("interval", "")
            return ImbalanceBin(float(row["lo"]), float(row["hi"]), text[:1] in ("", "["), text[-1:] in ("", "]"))

        number = lambda x: None if x is None else float(x)
        return BinSpec(
            placed("imbalance_bins", IMBALANCE, imbalance),
            placed("spread_bins", SPREAD, lambda r: SpreadBin(int(r["ticks_min"]), None if r["ticks_max"] is None else int(r["ticks_max"]))),
            placed("age_diff_ms_bins", AGE, lambda r: AgeBin(number(r["lo"]), number(r["hi"]))),
        )

    @staticmethod
    def load(path: str) -> "BinSpec":
        return BinSpec.from_dict(json.loads(Path(path).read_text()))

    def to_dict(self) -> dict:
        shape = lambda b: f"{'[' if b.lo_closed else '('}{b.lo}, {b.hi}{']' if b.hi_closed else ')'}"
        return {
            "imbalance_bins": [{"idx": i, "lo": b.lo, "hi": b.hi, "interval": shape(b)} for i, b in enumerate(self.imbalance)],
            "spread_bins": [{"idx": i, "ticks_min": b.lo, "ticks_max": b.hi} for i, b in enumerate(self.spread)],
            "age_diff_ms_bins": [{"idx": i, "lo": b.lo, "hi": b.hi} for i, b in enumerate(self.age)],
            "last_move_bins": [{"idx": i, "L": i - 1} for i in range(3)],
        }


@dataclass(frozen=True)
class StrategyConfig:
    fee_price: float = 0.03
    slip_price: float = 0.02
    min_abs_direction_score: float = 0.0
    min_expected_edge_bps: float = 0.0
    max_mean_wait_ms: float = 0.0
    edge_mode: EdgeMode = field(default=EdgeMode.LEGACY)

    @staticmethod
    def from_dict(data: dict) -> "StrategyConfig":
        """A missing ``edge_mode`` means the gated mode; ``legacy_mode`` wins; aliases count if the main key is absent."""
        own = dict(data)
        for alias, key in (("fee_per_leg", "fee_price"), ("min_expected_edge", "min_expected_edge_bps")):
            if alias in own:
                own.setdefault(key, own[alias])
        names = ("fee_price", "slip_price", "min_abs_direction_score", "min_expected_edge_bps", "max_mean_wait_ms")
        mode = EdgeMode.LEGACY if own.get("legacy_mode", 0) else EdgeMode(own.get("edge_mode", 2))
        return StrategyConfig(**{k: float(own[k]) for k in names if k in own}, edge_mode=mode)

    @staticmethod
    def load(path: str) -> "StrategyConfig":
        return StrategyConfig.from_dict(json.loads(Path(path).read_text()))


def parse_years(tokens: list[str]) -> list[int]:
    """``["2018", "2020-2022"]`` -> sorted distinct years."""
    out: set[int] = set()
    for token in tokens:
        lo, _, hi = token.partition("-")
        out.update(range(int(lo), int(hi or lo) + 1))
    return sorted(out)


def parse_range(text: str) -> tuple[int, int]:
    """``"2018:2022"`` -> (2018, 2022); 0 leaves a side open."""
    lo, _, hi = text.partition(":")
    return int(lo or 0), int(hi or 0)
