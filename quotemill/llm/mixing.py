"""Mixing sources by temperature: exponentiated token shares, the exponent found by bisection, weights realised by blocks.

Weights are ``share ** a`` normalised.  ``a`` is bisected so that their entropy meets a target: it lies ``entropy_gap`` of the
way from the natural shares' entropy up to the largest possible, or is ``entropy_share`` of the largest.  Then ``a`` is moved
towards 1 as far as needed for no source to be repeated more than ``repeat_limit`` times.  A source's budget of tokens becomes
whole passes over its rows and one part of a pass: its blocks in a pseudo-random order of that pass, as many as fit, and of the
next block as many rows, by hash, as fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_tasks, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Tables of sources up to this many counted rows are broadcast, and their token counts read by the driver.
BROADCAST_SOURCES = 1 << 17
#: Blocks hold so many tokens at least, and a source has so many blocks at most.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 18, 1 << 16
#: Exponents are looked for up to this one; so many are tried at once, so often.
MOST_EXPONENT, TRIED, ROUNDS = 64.0, 32, 12


@dataclass
class Shares:
    """Token shares of the sources that have tokens, by what the search for an exponent needs of them."""

    sources: int
    tokens: int
    least: int  # tokens of the smallest source
    most: int
    sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  # of r**a and r**a * log(r), where r = tokens / most

    @staticmethod
    def of(tokens: np.ndarray) -> "Shares":
        some = tokens[tokens > 0].astype(float)
        if not len(some):
            return Shares(0, 0, 0, 0, lambda a: (np.zeros(len(a)), np.zeros(len(a))))
        logs = np.log(some / some.max())

        def sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            powers = [np.exp(x * logs) for x in a]
            return np.array([p.sum() for p in powers]), np.array([(p * logs).sum() for p in powers])

        return Shares(len(some), int(some.sum()), int(some.min()), int(some.max()), sums)

    @staticmethod
    def of_table(table: DataFrame) -> "Shares":
        """Of a table with a column ``t`` of any length; its sums are aggregates."""
        some = table.where("t > 0")
        n, total, lo, hi = some.agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
        if n <= BROADCAST_SOURCES:
            return Shares.of(np.array([r["t"] for r in some.select("t").collect()], np.int64))

        def sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = some.select(F.log(F.col("t") / F.lit(float(hi))).alias("x"))
            power = [F.exp(F.col("x") * F.lit(float(v))) for v in a]
            row = x.agg(*[F.sum(p) for p in power], *[F.sum(p * F.col("x")) for p in power]).first()
            return np.array(row[: len(a)]), np.array(row[len(a) :])

        return Shares(n, total, lo, hi, sums)

    def entropy(self, a: np.ndarray) -> np.ndarray:
        z, s = self.sums(a)
        return np.log(z) - a * s / z

    def budget(self, a: np.ndarray, given: int | None) -> np.ndarray:
        """All tokens read under each exponent; without a given budget the least that reads every source once in full."""
        if given is not None:
            return np.full(len(a), float(given))
        t = np.where(a < 1, self.most, self.least)
        return t * self.sums(a)[0] / (t / self.most) ** a

    def repeats(self, a: np.ndarray, given: int | None) -> np.ndarray:
        """How often the source that is repeated most is read."""
        t = np.where(a < 1, self.least, self.most)
        return (t / self.most) ** a / self.sums(a)[0] * self.budget(a, given) / t


def least_exponent(good: Callable[[np.ndarray], np.ndarray], lo: float, hi: float) -> float:
    """The end of [lo, hi] nearest to ``lo`` for which ``good`` holds, given that it holds from some point on up to ``hi``."""
    for _ in range(ROUNDS):
        tried = lo + (hi - lo) * np.arange(1, TRIED) / TRIED
        ok = np.flatnonzero(good(tried))
        first = int(ok[0]) if len(ok) else TRIED - 1
        lo, hi = (float(tried[first - 1]) if first else lo), (float(tried[first]) if len(ok) else hi)
    return hi


@dataclass
class Mix:
    exponent: float
    norm: float  # sum of (tokens / most) ** exponent
    total: float
    met: bool  # the entropy is the target's and no source is repeated beyond the limit

    def weight(self, tokens: np.ndarray, most: int) -> np.ndarray:
        return np.where(tokens > 0, (np.maximum(tokens, 1) / max(most, 1)) ** self.exponent / max(self.norm, 1e-300), 0.0)


def plan(shares: Shares, entropy_gap: float | None = 0.5, entropy_share: float | None = None, repeat_limit: float | None = None, budget: int | None = None) -> Mix:
    """``budget`` None: the least budget under which every source is read once in full.  A target that no exponent reaches, such as
    one other than the natural entropy where all sources are alike, leaves the natural shares and is not ``met``."""
    if not 0 <= (entropy_gap or 0) <= 1 or not 0 <= (entropy_share or 0) <= 1:
        raise ValueError("entropy_gap and entropy_share are shares of 1")
    one = np.ones(1)
    if not shares.sources:
        return Mix(1.0, 1.0, 0.0, True)
    a, met = 1.0, True
    natural, largest = float(shares.entropy(one)[0]), math.log(shares.sources)
    target = natural if entropy_share is None and entropy_gap is None else natural + entropy_gap * (largest - natural) if entropy_share is None else entropy_share * largest
    if abs(target - natural) > 1e-12:
        lo, hi = (0.0, 1.0) if target > natural else (1.0, MOST_EXPONENT)
        met = bool(shares.entropy(np.array([hi]))[0] <= target + 1e-9)
        a = least_exponent(lambda x: shares.entropy(x) <= target, lo, hi) if met else 1.0
    if repeat_limit is not None:
        fits = lambda x: shares.repeats(x, budget) <= repeat_limit * (1 + 1e-12)
        if not fits(np.array([a]))[0]:
            met = False
            a = least_exponent(fits, a, 1.0) if fits(one)[0] else 1.0
    x = np.array([a])
    return Mix(a, float(shares.sums(x)[0][0]), float(shares.budget(x, budget)[0]), met)


def hash60(*parts: Column) -> Column:
    """60 bits of md5 of values written as text, nulls as empty text, with colons between them."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", entropy_gap: float | None = 0.5, entropy_share: float | None = None, repeat_limit: float | None = 4.0,
    budget_share: float | None = 1.0, block_tokens: int = BLOCK_TOKENS, seed: int = 17, columns: list[str] | None = None,
) -> DataFrame:
    """``docs``, or its ``columns``, with n_tokens, source_weight, source_tokens, source_budget, copies, mix_block, mix_block_key,
    mix_row_key and target_met.

    ``copies`` says how often a row is read under the budget: 0 for rows that it leaves out.  ``budget_share`` is the
    budget over all tokens; None asks for the least budget that reads every row at least once.  Reading order is
    (pass, mix_block_key, mix_row_key), by which blocks of all sources take turns.  ``target_met`` is false if no exponent reaches
    the target of entropy or if the limit of repetitions moved it.  Tokens are words.  A null source is a source of its own,
    called "".  Rows without words cost nothing and are read in each whole pass; a source without tokens is read once.  Rows of one
    id in a source stay together, null ids too.  Texts of any length are one row.  An empty table gives no rows.  Columns
    called like the new ones are replaced.  Texts are counted once if the text is not among ``columns``, else twice.
    """
    new = ("n_tokens", "source_weight", "source_tokens", "source_budget", "copies", "mix_block", "mix_block_key", "mix_row_key", "target_met")
    names = [c for c in (docs.columns if columns is None else columns) if c not in new]
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    keyed = docs.select(*names, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), n.alias("n_tokens"), hash60(F.lit(seed), F.col(id_col)).alias("_key"))
    light = materialise(keyed if text_col not in names else keyed.select("_source", "n_tokens", "_key"), "counted")
    few = few_tasks(docs)
    stats = materialise(light.groupBy("_source").agg(F.sum("n_tokens").alias("t")), "sources", few)
    shares = Shares.of_table(stats)
    mix = plan(shares, entropy_gap, entropy_share, repeat_limit, None if budget_share is None else int(budget_share * shares.tokens))
    t = F.col("t")
    weight = F.when(t > 0, F.pow(t / F.lit(float(max(1, shares.most))), F.lit(mix.exponent)) / F.lit(mix.norm)).otherwise(0.0)
    # Tokens are whole; the small step up keeps a source that is to be read in full from missing its last row.
    table = stats.withColumn("source_weight", weight).withColumn("source_budget", F.floor(F.col("source_weight") * F.lit(mix.total * (1 + 1e-9))).cast("long"))
    full = F.when(t > 0, F.expr("source_budget div t")).otherwise(1)
    rest = F.when(t > 0, F.expr("source_budget % t")).otherwise(0)
    blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(t / F.lit(block_tokens)))).cast("long")
    table = materialise(table.select("_source", "source_weight", t.alias("source_tokens"), "source_budget", full.alias("_full"), rest.alias("_rest"), blocks.alias("_blocks")), "weights", few)
    small = table.count() <= BROADCAST_SOURCES
    side = lambda x: F.broadcast(x) if small else x

    def placed(x: DataFrame) -> DataFrame:
        x = x.join(side(table), "_source")
        x = x.withColumn("mix_block", F.pmod("_key", "_blocks"))
        x = x.withColumn("mix_block_key", hash60(F.lit(seed), F.col("_source"), F.col("mix_block"), F.col("_full")))
        return x.withColumn("mix_row_key", hash60(F.lit(seed), F.col("_key"), F.col("_full")))

    # The block at which the part of a pass ends, and the last row key within it.
    sums = placed(light).groupBy("_source", "mix_block_key", "_rest").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("_source").orderBy("mix_block_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = sums.withColumn("_sum", F.sum("t").over(upto)).where(F.col("_sum") > F.col("_rest"))
    edge = edge.groupBy("_source").agg(F.min(F.struct("mix_block_key", (F.col("_rest") - F.col("_sum") + F.col("t")).alias("left"))).alias("e"))
    edge = materialise(edge.select("_source", F.col("e.mix_block_key").alias("_edge"), F.col("e.left").alias("_left")), "edges", few)
    inside = placed(light).join(side(edge), "_source").where(F.col("mix_block_key") == F.col("_edge"))
    rows_of = inside.groupBy("_source", "mix_row_key", "_left").agg(F.sum("n_tokens").alias("t"))
    by_row = Window.partitionBy("_source").orderBy("mix_row_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows_of.withColumn("_sum", F.sum("t").over(by_row)).where(F.col("_sum") <= F.col("_left")).groupBy("_source").agg(F.max("mix_row_key").alias("_cut"))
    ends = materialise(edge.join(side(cut), "_source", "left").select("_source", "_edge", "_cut"), "ends", few)
    out = placed(keyed if text_col in names else light).join(side(ends), "_source", "left")
    extra = (F.col("_rest") > 0) & ((F.col("mix_block_key") < F.col("_edge")) | ((F.col("mix_block_key") == F.col("_edge")) & (F.col("mix_row_key") <= F.col("_cut"))))
    copies = F.col("_full") + F.coalesce(extra, F.lit(False)).cast("long")
    return out.select(*names, "n_tokens", "source_weight", "source_tokens", "source_budget", copies.alias("copies"), "mix_block", "mix_block_key", "mix_row_key", F.lit(mix.met).alias("target_met"))


def realise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as it is to be read, with ``mix_pass`` beside ``columns``."""
    read = mixed.where("copies > 0")
    return read.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("mix_pass"))
