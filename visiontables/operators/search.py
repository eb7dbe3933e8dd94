"""Interpolation joins, trial and timing statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiontables.operators.ordered import running


def interp_join(knots: DataFrame, grid: DataFrame, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Piecewise-linear lookup of grid positions x among knots (x, tie, y); outside the knots the end values hold.

    Knots and grid are read as one ordered stream in buckets of x; of knots with equal x the last by ``tie`` wins.
    """
    keys = list(keys)
    k = knots.select(*keys, F.col("x").cast("double").alias("x"), F.struct(F.col("x").cast("double").alias("x"), "tie", "y").alias("_k"), F.lit(0).alias("_g"))
    g = grid.select(*keys, F.col("x").cast("double").alias("x"), F.lit(None).cast(k.schema["_k"].dataType).alias("_k"), F.lit(1).alias("_g"))
    both = k.unionByName(g)
    coarse = F.floor(F.col("x") * scale)
    left = running(both, keys, [F.col("x"), F.col("_g")], coarse, {"_a": ("max", F.col("_k"))})
    full = running(left, keys, [F.col("x").desc(), F.col("_g")], coarse, {"_b": ("min", F.col("_k"))}, ascending=False)
    a, b, x = F.col("_a"), F.col("_b"), F.col("x")
    t = F.try_divide(x - a["x"], b["x"] - a["x"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == x), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * t)
    return full.where("_g = 1").select(*keys, "x", value.alias("y"))


def downsample_curve(points: DataFrame, keys: Sequence[str], n: int = 101, scale: float = 1.0) -> DataFrame:
    """Curves longer than n points read at n even positions; shorter ones as they are."""
    ends = points.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count("*").alias("_n"))
    tagged = points.join(ends, list(keys))
    short = tagged.where(F.col("_n") <= n).select(*keys, F.col("x").cast("double").alias("x"), "y")
    grid = ends.where(F.col("_n") > n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_i") / (n - 1))).alias("x"))
    long = tagged.where(F.col("_n") > n).select(*keys, "x", F.col("x").alias("tie"), "y")
    return short.unionByName(interp_join(long, grid, keys, scale))


def speed_summary(timings: DataFrame, stage: str, ms: str) -> DataFrame:
    """Mean time per stage and the frame rate each would allow."""
    return timings.groupBy(stage).agg(F.avg(ms).alias("mean_ms"), F.count("*").alias("images")).withColumn("fps", F.try_divide(F.lit(1000.0), F.col("mean_ms")))


def sigma_clip(rows: DataFrame, keys: Sequence[str], value: str, sigma: float = 2.0, rounds: int = 3, lower_only: bool = False) -> DataFrame:
    """Drop outliers ``rounds`` times; a round that drops nothing changes nothing, so the fixed chain is exact."""
    out = rows
    for _ in range(rounds):
        s = out.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_d"))
        low, high = F.col("_m") - sigma * F.col("_d"), F.col("_m") + sigma * F.col("_d")
        keep = (F.col(value) >= low) if lower_only else (F.col(value) > low) & (F.col(value) < high)
        out = out.join(s, list(keys)).where(keep).drop("_m", "_d")
    return out


def top_trials(trials: DataFrame, n: int, positive: bool = True) -> DataFrame:
    rows = trials.where("fitness > 0") if positive else trials
    return rows.orderBy(F.col("fitness").desc(), "iteration").limit(n)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of highest fitness, the first of equals."""
    cols = trials.columns
    best = F.max_by(F.struct(*cols), F.struct(F.col("fitness"), -F.col("iteration"))).alias("b")
    return trials.agg(best).select("b.*")


def crossover_bounds(trials: DataFrame, params: Sequence[str], k: int = 9, alpha: float = 0.2) -> DataFrame:
    """Range of each parameter among the k best trials, widened by ``alpha`` of its span on both sides."""
    long = top_trials(trials, k, positive=False).unpivot(["iteration"], [F.col(p).cast("double").alias(p) for p in params], "param", "value")
    b = long.groupBy("param").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("span", F.col("hi") - F.col("lo"))
    return b.withColumn("low", F.col("lo") - alpha * F.col("span")).withColumn("high", F.col("hi") + alpha * F.col("span"))
