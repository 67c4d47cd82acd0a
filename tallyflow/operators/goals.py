"""Goal simulation: one row for each goal, paths drawn with numpy from the goal's own seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import query


def nearest(x: np.ndarray, p: float) -> float:
    """Nearest rank over sorted values."""
    return float(x[min(int(p * len(x)), len(x) - 1)]) if len(x) else 0.0


class Fit:
    """GA1, GA2: low outliers leave the mean; a collapse in the last three months is mixed in."""

    def __init__(self, net: np.ndarray):
        s = np.sort(net)
        q1, q3 = nearest(s, 0.25), nearest(s, 0.75)
        low = net < q1 - 1.5 * (q3 - q1) if q3 > q1 else np.zeros(len(net), bool)
        clean = net[~low] if (~low).sum() >= 3 else net
        self.clean, self.dips = clean, int(low.sum())
        self.mean = float(clean.mean()) if len(clean) else 0.0
        self.std = float(clean.std(ddof=1)) if len(clean) > 1 else 0.0
        skew = float((((clean - self.mean) / self.std) ** 3).sum() / len(clean)) if len(clean) >= 3 and self.std > 0 else 0.0
        self.normal = len(net) >= 6 and abs(skew) < 1 and self.std > 0
        self.recent = float(net[-3:].mean()) if len(net) >= 4 else self.mean
        self.shocked = len(net) >= 4 and self.mean > 0 and (self.mean - self.recent) / abs(self.mean) > 0.7
        self.centre = (self.mean + self.recent) / 2 if self.shocked else self.mean

    def draw(self, rng: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
        base = rng.normal(self.mean, self.std, shape) if self.normal else rng.choice(self.clean, shape)
        if not self.shocked:
            return base
        return np.where(rng.random(shape) < 0.5, base, rng.normal(self.recent, self.std, shape))


def chance(steps: np.ndarray, target: float) -> float:
    """Share of paths that ever reach the target."""
    return float((np.cumsum(steps, axis=1).max(axis=1) >= target).mean())


def least_shifts(steps: np.ndarray, target: float) -> np.ndarray:
    """Of each path, by how much its every month must rise so that it once reaches the target."""
    return ((target - np.cumsum(steps, axis=1)) / np.arange(1, steps.shape[1] + 1)).min(axis=1)


def needed(fit: Fit, steps: np.ndarray, target: float, share: float) -> int:
    """GA6: the mean surplus at which ``share`` of the paths arrive. A shift of the mean moves a
    path's every month alike, so each path has its least shift, and the answer is their quantile."""
    shift = least_shifts(steps, target)
    return int(np.floor(fit.centre + np.sort(shift)[max(0, int(np.ceil(share * len(shift))) - 1)] + 0.5))


def simulate(goals: DataFrame, paths: int = 10_000) -> DataFrame:
    """GA3-GA9 over (goal_id, kind, net array, months, target, gap, override)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g in frame.itertuples(index=False):
                net = np.asarray(g.net, float)
                status = "past_deadline" if g.months <= 0 else "too_little_history" if len(net) < 6 else "very_stale" if g.gap > 6 and not g.override else "ok"
                if status != "ok":
                    out.append((g.goal_id, status, *[None] * 10))
                    continue
                fit, rng = Fit(net), np.random.default_rng(int(g.goal_id) & 0xFFFFFFFF)
                steps = fit.draw(rng, (paths, int(g.months)))
                if g.kind == "reduce_category":
                    p = float((steps <= net.mean() - g.target).mean())
                    ends, need = np.sort(steps, axis=None), [None] * 3
                else:
                    p, ends = chance(steps, g.target), np.sort(steps.sum(axis=1))
                    need = [needed(fit, steps[:3000], g.target, s) for s in (0.5, 0.7, 0.9)]
                lifted = chance(steps[:5000] + 0.1 * abs(fit.centre), g.target)
                out.append((g.goal_id, status, p, "feasible" if p >= 0.7 else "stretch" if p >= 0.4 else "unlikely", nearest(ends, 0.1), nearest(ends, 0.5), nearest(ends, 0.9), *need, lifted, fit.shocked))
            yield pd.DataFrame(out, columns=["goal_id", "status", "probability", "feasibility", "p10", "p50", "p90", "need50", "need70", "need90", "lifted", "shocked"])

    kinds = "goal_id long, status string, probability double, feasibility string, p10 double, p50 double, p90 double, need50 long, need70 long, need90 long, lifted double, shocked boolean"
    return goals.mapInPandas(run, kinds)


def bands(goals: DataFrame, paths: int = 500, bins: int = 50) -> DataFrame:
    """GA5: percentiles of the running sum by month, and the histogram of the ends."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g in frame.itertuples(index=False):
                if g.months <= 0 or len(g.net) < 6:
                    continue
                runs = np.sort(np.cumsum(Fit(np.asarray(g.net, float)).draw(np.random.default_rng(int(g.goal_id) & 0xFFFFFFFF), (paths, int(g.months))), axis=1), axis=0)
                out += [(g.goal_id, "band", m + 1, *[float(np.floor(nearest(runs[:, m], p) + 0.5)) for p in (0.1, 0.5, 0.9)]) for m in range(int(g.months))]
                n, edge = np.histogram(runs[:, -1], bins)
                out += [(g.goal_id, "bin", k, float(edge[k]), float(edge[k + 1]), float(n[k])) for k in range(bins)]
            yield pd.DataFrame(out, columns=["goal_id", "part", "k", "a", "b", "c"])

    return goals.mapInPandas(run, "goal_id long, part string, k long, a double, b double, c double")


def sensitivity(goals: DataFrame, points: int = 40, paths: int = 2000) -> DataFrame:
    """GA6: the chance of arrival by mean surplus, at points from below today's (or what the target asks
    for, less a deviation) to above the surplus that nine paths in ten arrive with."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g in frame.itertuples(index=False):
                if g.months <= 0 or len(g.net) < 6:
                    continue
                fit = Fit(np.asarray(g.net, float))
                steps = fit.draw(np.random.default_rng(int(g.goal_id) & 0xFFFFFFFF), (max(paths, 3000), int(g.months)))
                first = min(fit.centre - fit.std / 2, g.target / g.months - fit.std)
                at = np.linspace(first, needed(fit, steps[:3000], g.target, 0.9) + 0.3 * fit.std, points)
                least = np.sort(least_shifts(steps[:paths], g.target))
                out += [(g.goal_id, k, float(np.floor(x + 0.5)), float(n / paths)) for k, (x, n) in enumerate(zip(at, np.searchsorted(least, at - fit.centre, "right"), strict=True))]
            yield pd.DataFrame(out, columns=["goal_id", "k", "surplus", "probability"])

    return goals.mapInPandas(run, "goal_id long, k long, surplus double, probability double")


def goals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two goals for each user: to save, and to spend less."""
    monthly = query("monthly")(spark, sf_dir)
    net = monthly.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("month_idx", "income", "expenses"))), lambda x: x["income"] - x["expenses"] * 0.4).alias("net"))
    save = net.select((F.col("user_id") * 2).cast("long").alias("goal_id"), F.lit("accumulate").alias("kind"), "net", (F.col("user_id") % 18).cast("int").alias("months"), F.lit(900_000.0).alias("target"), F.lit(1).alias("gap"), F.lit(False).alias("override"))
    less = net.select((F.col("user_id") * 2 + 1).cast("long").alias("goal_id"), F.lit("reduce_category").alias("kind"), "net", F.lit(12).alias("months"), F.lit(2_000.0).alias("target"), (F.col("user_id") % 9).cast("int").alias("gap"), F.lit(False).alias("override"))
    return save.unionByName(less)


def ga_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(goals_of(spark, sf_dir))


def ga5_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(goals_of(spark, sf_dir).filter("kind = 'accumulate'"))


def ga6_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity(goals_of(spark, sf_dir).filter("kind = 'accumulate'"))


def ga10_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GA10: rules that take a sentence as a goal; a pluggable stand-in for the model."""
    text = F.lower("text")
    saves, cuts = text.rlike("sav|set aside|accumulate|invest"), text.rlike("cut|reduce|spend less|lower")
    kind = F.when(cuts & text.rlike("[0-9]"), "reduce_category").when(saves | cuts, "accumulate")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", kind.isNotNull().alias("accepted"), kind.alias("goal_type"))


def queries() -> dict:
    return {f.__name__: f for f in (ga_goals, ga5_bands, ga6_sensitivity, ga10_gate)}


