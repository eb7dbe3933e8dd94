"""Summaries of scored runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.operators.ordered import join_keys, running_over_parts, sorted_parts
from visiontables.operators.stages import materialize


def finite(c: str | Column) -> Column:
    """NULL instead of NaN or infinity, so that aggregates skip the value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def top_value(df: DataFrame, keys: list[str], value: str, position: str, out: str, count: str) -> DataFrame:
    """Most common non-empty trimmed value per key; ties go to the one seen first."""
    counts = (df.withColumn("_v", F.trim(value)).where("_v <> ''").groupBy(*keys, "_v")
              .agg(F.count("*").alias("_n"), F.min(position).alias("_p")))
    best = F.max_by(F.struct("_v", "_n"), F.struct(F.col("_n"), -F.col("_p"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("_b._v").alias(out), F.col("_b._n").alias(count))


def run_summary(df: DataFrame, position: str, means: dict[str, str], tops: dict[str, str], key: str = "run_id",
                source: str | None = None) -> DataFrame:
    """One row per run: counts, accuracy, score statistics, means of other metrics and the most common labels."""
    s = finite("score")
    aggs = [F.count("*").alias("rows"), F.count_if("is_correct").alias("correct"), F.avg(s).alias("score_mean"),
            F.stddev_pop(s).alias("score_std"), F.min(s).alias("score_min"), F.max(s).alias("score_max")]
    aggs += [F.avg(finite(c)).alias(out) for c, out in means.items()]
    if source:
        aggs.append(F.coalesce(F.min_by(source, F.when(F.trim(source) != "", F.col(position))), F.lit("")).alias("source"))
    base = df.groupBy(key).agg(*aggs).withColumn("accuracy_pct", 100.0 * F.col("correct") / F.col("rows"))
    out = reduce(lambda acc, kv: acc.join(top_value(df, [key], kv[0], position, kv[1], f"{kv[1]}_count"), key, "left"), tops.items(), base)
    blank = {name: F.coalesce(F.col(name), F.lit("")) for name in tops.values()}
    zero = {f"{name}_count": F.coalesce(F.col(f"{name}_count"), F.lit(0).cast("bigint")) for name in tops.values()}
    return out.withColumns({**blank, **zero})


def quantiles(values: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, _q array): exact quantiles, linear between neighbours, of distinct values _s that occur _n times each.

    The values are written in ranges of equal depth; a running count along them gives each value the ranks it covers, so a quantile
    is picked by an aggregate and no task holds a key's values. NULL values don't count; a key without others has no row.
    """
    known = values.where(F.col("_s").isNotNull())
    placed = running_over_parts(sorted_parts(known, keys, [F.col("_s")]), keys, {"_upto": ("sum", F.col("_n"))})
    met = join_keys(placed, known.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)

    def neighbour(q, rounded):
        rank = rounded((F.col("_total") - 1) * F.lit(q))
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), F.col("_s")))

    def between(q):
        place = (F.max("_total") - 1) * F.lit(q)
        low, high, part = neighbour(q, F.floor), neighbour(q, F.ceil), place - F.floor(place)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return met.groupBy(*keys).agg(F.array(*[between(q) for q in at]).alias("_q"))


def score_boxplot(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier counts, from counts per distinct value. NULL scores count in ``n`` alone."""
    values = materialize(df.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("_n")), "values")
    q = values.groupBy(*keys).agg(F.sum("_n").alias("n")).join(quantiles(values, keys, [0.25, 0.5, 0.75]), keys, "left")
    q = q.select(*keys, "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    ends = values.join(q, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("_s") >= low, F.col("_s"))).alias("whisker_low"), F.max(F.when(F.col("_s") <= high, F.col("_s"))).alias("whisker_high"),
        F.sum(F.when((F.col("_s") < low) | (F.col("_s") > high), F.col("_n")).otherwise(0)).alias("outliers"))
    return q.join(ends, keys)


def group_compare(df: DataFrame, keys: list[str]) -> DataFrame:
    s = finite("score")
    return df.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if("is_correct").alias("accepted"), F.avg(s).alias("score_mean"),
                                 F.stddev_pop(s).alias("score_std")).withColumn("acceptance_pct", 100.0 * F.col("accepted") / F.col("windows"))


def top_runs(summary: DataFrame, n: int) -> DataFrame:
    return summary.orderBy(F.col("accuracy_pct").desc(), "run_id").limit(max(1, n))


def union_runs(groups: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("group_name", F.lit(name)) for name, df in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
