"""Mixing sources to target weights by iterative proportional fitting.

The table is reduced to cells of source, language and topic with their tokens. Each cell has a probability of keeping its
documents; the probabilities are raked: scaled source by source, language by language, topic by topic to the tokens that each
should have, cut at 1, until every value's tokens are within a thousandth of its goal. A value that lacks the tokens for its
target is kept whole and the others make up for it; goals that can't be met together give a warning with the largest miss. A document stays if its hash, read as a number from 0 to 1, is below its cell's
probability, so each value's expected tokens are its target wherever the table has enough of it.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.operators.stages import discard, materialize

#: Share of all tokens to keep, and the powers of a value's share of tokens that make its target share.
RATE = 0.6
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS = 200
#: Raking ends when each value's tokens miss its goal by at most this share of the goal, or when no probability moves by more than STILL in a round.
MISS = 1e-3
STILL = 1e-9
#: Levels tried at once for the goals of a marginal, how often the grid is narrowed at most, and how near the goals' sum must come.
GRID = 32
STEPS = 12
NEAR = 1e-6
#: Cells that are raked in the driver's memory, at most; more are raked as a table.
SMALL = 200_000
SEED = 20240801

# What makes a text of a topic, the first that fits; all others are prose.
TOPICS = (("legal", r"(?i)\b(licen[cs]e[ds]?|copyright|rights reserved)\b"), ("contact", r"[\w.]@[\w-]+\.|\+\d[\d ()-]{7}"), ("table", r" \| .* \| "), ("numbers", r"\d{6}"))


def topic_of(text: Column) -> Column:
    """A coarse topic of a text, for tables without one; NULL counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    topic = F.when(F.lit(False), F.lit(""))
    for name, pattern in TOPICS:
        topic = topic.when(whole.rlike(pattern), F.lit(name))
    return topic.otherwise(F.lit("prose"))


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _goals(cells: DataFrame, name: str, wanted: float, power: float, shares: Mapping[str, float] | None) -> DataFrame:
    """(_value, goal): the tokens a value should keep, in proportion to its weight but at most what it has, ``wanted`` in all.

    What values with too few tokens leave is spread over the others: goals are min(tokens, level * weight), and the level is
    found by narrowing a grid of levels, one aggregation a step.
    """
    if shares is None:
        weight = F.pow("t", F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col(name) == value, F.lit(float(share))) for value, share in shares.items()], F.lit(0.0))
    values = materialize(cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").select(F.col(name).alias("_value"), "t", weight.alias("w")), "values")
    ends = values.where("w > 0").agg(F.min(F.col("t") / F.col("w")), F.max(F.col("t") / F.col("w")), F.sum("t"), F.sum("w")).first()
    if not ends[3]:
        return values.select("_value", F.lit(0.0).alias("goal"))
    low, high = min(ends[0], wanted / ends[3]), ends[1]
    for _ in range(STEPS if ends[2] > wanted else 0):
        levels = [low + (high - low) * (k / GRID) ** 2 for k in range(GRID + 1)]
        sums = values.agg(*[F.sum(F.least("t", F.lit(x) * F.col("w"))) for x in levels]).first()
        k = next((k for k in range(1, GRID + 1) if sums[k] >= wanted), GRID)
        low, high = levels[k - 1], levels[k]
        if sums[k] - wanted <= NEAR * wanted:
            break
    return values.select("_value", F.least("t", F.lit(high) * F.col("w")).alias("goal"))


def _level(t: np.ndarray, w: np.ndarray, wanted: float) -> np.ndarray:
    """What ``_goals`` finds, exactly."""
    goal = np.zeros(len(t))
    able = np.flatnonzero((t > 0) & (w > 0))
    order = able[np.argsort(t[able] / w[able])]
    left, weight = wanted, w[order].sum()
    for k, at in enumerate(order):
        if left * w[at] < t[at] * weight:
            goal[order[k:]] = left * w[order[k:]] / weight
            break
        goal[at] = t[at]
        left, weight = left - t[at], w[order[k + 1:]].sum() if k % 64 == 63 else weight - w[at]
    return np.where(t > 0, goal, np.nan)


def _rake_small(table: pa.Table, names: Sequence[str], rate: float, shares: Mapping[str, Mapping[str, float]], rounds: int) -> tuple[np.ndarray, float]:
    """The probabilities of the cells, and the largest miss of a goal as a share of it."""
    tokens = table.column("tokens").to_numpy().astype(float)
    p, margins, miss = np.full(len(tokens), float(rate)), [], 0.0
    for name in names:
        coded = pc.dictionary_encode(table.column(name).combine_chunks(), null_encoding="encode")
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
        values, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        t = np.bincount(codes, tokens, len(values))
        weight = np.asarray([float(shares[name].get(v, 0.0)) for v in values]) if name in shares else t ** POWERS.get(name, 1.0)
        margins.append((codes, _level(t, weight, rate * tokens.sum())))
    for _ in range(rounds):
        was = p
        for codes, goal in margins:
            has = np.bincount(codes, tokens * p, len(goal))
            p = np.minimum(1.0, p * np.divide(goal, has, out=np.ones(len(goal)), where=(has > 0) & ~np.isnan(goal))[codes])
        miss = max((float((np.abs(np.bincount(codes, tokens * p, len(goal)) - goal)[goal > 0] / goal[goal > 0]).max(initial=0.0)) for codes, goal in margins), default=0.0)
        if miss <= MISS or np.abs(p - was).max(initial=0.0) <= STILL:
            break
    return p, miss


def _rake_table(cells: DataFrame, names: Sequence[str], rate: float, shares: Mapping[str, Mapping[str, float]], rounds: int) -> tuple[DataFrame, float]:
    """As ``_rake_small``, for more cells than the driver should hold."""
    wanted = rate * (cells.agg(F.sum("tokens")).first()[0] or 0)
    start = cells.select(*names, "tokens", F.lit(float(rate)).alias("p"))
    for name in names:
        goals = materialize(_goals(cells, name, wanted, POWERS.get(name, 1.0), shares.get(name)), "goals").withColumnRenamed("goal", f"_goal_{name}")
        start = start.join(goals, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value")
    now, miss = materialize(start, "raked"), 0.0
    for _ in range(rounds):
        moved = now.withColumn("_was", F.col("p"))
        for name in names:
            margin = moved.groupBy(F.col(name).alias("_at")).agg(F.sum(F.col("tokens") * F.col("p")).alias("_has"))
            factor = F.coalesce(F.col(f"_goal_{name}") / F.nullif("_has", F.lit(0.0)), F.lit(1.0))
            moved = moved.join(margin, F.col(name).eqNullSafe(F.col("_at")), "left").withColumn("p", F.least(F.lit(1.0), F.col("p") * factor)).drop("_at", "_has")
        last, now = now, materialize(moved, "raked")
        discard(last)
        miss = 0.0
        for name in names:
            goal = F.max(f"_goal_{name}")
            miss = max(miss, now.groupBy(name).agg(F.when(goal > 0, F.abs(F.sum(F.col("tokens") * F.col("p")) - goal) / goal).alias("_miss")).agg(F.max("_miss")).first()[0] or 0.0)
        if miss <= MISS or (now.agg(F.max(F.abs(F.col("p") - F.col("_was")))).first()[0] or 0) <= STILL:
            break
    return now.select(*names, "tokens", "p"), miss


def rake(cells: DataFrame, names: Sequence[str] = tuple(POWERS), rate: float = RATE, shares: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (names..., tokens) with ``p``, the probability of a cell's documents.

    Warns with the largest miss where some goal is not met: the goals contradict each other, or the rounds ended first.
    """
    own = cells.select(*names, "tokens")
    if own.count() <= SMALL:
        table = own.toArrow()
        p, miss = _rake_small(table, names, rate, shares or {}, rounds)
        rows = list(zip(*[table.column(c).to_pylist() for c in (*names, "tokens")], p.tolist(), strict=True))
        raked = cells.sparkSession.createDataFrame(rows, own.withColumn("p", F.lit(0.0)).schema)
    else:
        raked, miss = _rake_table(own, names, rate, shares or {}, rounds)
    if miss > MISS:
        warnings.warn(f"raking misses a goal by {100 * miss:.2g} %", stacklevel=2)
    return raked.select(*names, "tokens", F.round("p", 9).alias("p"))


def _mixed(docs: DataFrame, carry: Column, topic: Column | None, rate: float, shares: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """``carry`` of each row of ``docs`` as _row, with the struct _mix_ (topic, tokens, probability, sampled)."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) / float(1 << 53)
    own = docs.select(carry.alias("_row"), "source", "lang", draw.alias("_draw_"), (topic_of(F.col("text")) if topic is None else topic).alias("_mix_topic_"), tokens_of(F.col("text")).alias("_mix_tokens_"))
    cells = materialize(own.groupBy("source", "lang", F.col("_mix_topic_").alias("topic")).agg(F.sum("_mix_tokens_").alias("tokens")), "cells")
    raked = materialize(rake(cells, rate=rate, shares=shares).select(F.col("source").alias("_mix_a_"), F.col("lang").alias("_mix_b_"), F.col("topic").alias("_mix_c_"), F.col("p").alias("_mix_p_")), "probabilities")
    met = own.join(raked, F.col("source").eqNullSafe(F.col("_mix_a_")) & F.col("lang").eqNullSafe(F.col("_mix_b_")) & F.col("_mix_topic_").eqNullSafe(F.col("_mix_c_")), "left")
    p = F.coalesce("_mix_p_", F.lit(0.0))
    return met.select("_row", F.struct(F.col("_mix_topic_").alias("topic"), F.col("_mix_tokens_").alias("tokens"), p.alias("probability"), (F.col("_draw_") < p).alias("sampled")).alias("_mix_"))


def mix_documents(docs: DataFrame, topic: Column | None = None, rate: float = RATE, shares: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, sampled, one row per row of ``docs``.

    ``shares`` gives target shares per value of source, lang or topic; a value it does not name gets none. What it leaves
    out comes from the table's own shares, flattened by POWERS. A NULL source or lang is a value of its own; NULL and empty
    texts have no tokens and keep the probability of their cell; equal rows are kept or left out together. No rows give no
    rows. Other columns are not read.
    """
    got = _mixed(docs, F.struct("doc_id", "source", "lang"), topic, rate, shares)
    return got.select("_row.doc_id", "_row.source", "_row.lang", "_mix_.*")


def sample_documents(docs: DataFrame, topic: Column | None = None, rate: float = RATE, shares: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix_documents`` samples, with all their columns, whatever their names."""
    return _mixed(docs, F.struct("*"), topic, rate, shares).where("_mix_.sampled").select("_row.*")
