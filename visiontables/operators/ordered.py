"""Order-dependent work that does not put one key's rows into one task.

A plain window over a hot key (one class, one track, one image) sorts all its rows in a single task. Here a
monotone ``coarse`` column cuts each key into ordered buckets; per-bucket totals are aggregated map-side, the
tiny table of totals is scanned to get what precedes each bucket, and only the rows of one bucket meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiontables.operators.stages import materialize

BLOCK = 4096


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def join_keys(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL."""
    other = few.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(other, same).drop(*[f"_key_{k}" for k in keys])


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Column, out: str = "rn") -> DataFrame:
    """Exact 1-based row number within ``keys``; ``coarse`` must not decrease along ``order``."""
    keys = list(keys)
    rows = df.withColumn("_b", coarse)
    offsets = (
        rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return (
        join_keys(rows.withColumn("_local", local), offsets, [*keys, "_b"])
        .withColumn(out, (F.col("_local") + F.col("_off")).cast("bigint"))
        .drop("_b", "_local", "_off")
    )


def sorted_rank(df: DataFrame, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """Exact 1-based row number over the whole table in ``order``, whatever the values look like.

    A range-partitioned sort is written once; within a part the position is known, and the counts per part give what
    lies before it. Needs no bucket column and does not mind ties.
    """
    rows = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = rows.withColumn("_p", part).join(offsets, "_p")
    return placed.withColumn(out, F.col("_off") + F.col("_id") - F.shiftleft("_p", 33) + 1).drop("_p", "_id", "_off")


def sorted_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows sorted by ``keys`` and ``order``, written once as parts of about equal depth, with columns _part and _id.

    The ranges are cut by the whole order, so rows of one key, and rows that tie on its first columns, spread over as many
    parts as they fill. ``_id`` grows along the order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*_cols(keys), *order]
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return materialize(rows, "sorted").withColumn("_part", F.shiftright("_id", 33))


def running_over_parts(rows: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """Inclusive running aggregates as ``running``, along (or against) the order of ``sorted_parts``; a task sees one part of one key.

    What lies before a part comes from totals per key and part and enters the part as a row of its own, so the rows move once, to
    their part, with none but their own columns.
    """
    keys = list(keys)
    along = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    totals = rows.groupBy(*keys, "_part").agg(*[_COMBINE[kind][0](value).alias(f"_t_{out}") for out, (kind, value) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(along("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.struct(*[_COMBINE[kind][0](f"_t_{out}").over(before).alias(out) for out, (kind, _) in aggs.items()]).alias("_before"))
    blank = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns}
    first = F.lit(2 ** 63 - 1 if backwards else -1).cast("bigint").alias("_id")
    heads = offsets.select(*[c if c in (*keys, "_part") else first if c == "_id" else blank[c] for c in rows.columns], "_before")
    none = F.lit(None).cast(heads.schema["_before"].dataType).alias("_before")
    met = rows.select("*", none).unionByName(heads).repartition(*keys, "_part")
    local = Window.partitionBy(*keys, "_part").orderBy(along("_id")).rowsBetween(Window.unboundedPreceding, 0)
    run = met.select("*", *[_COMBINE[kind][0](F.when(F.col("_before").isNull(), value).otherwise(F.col("_before")[out])).over(local).alias(f"_r_{out}")
                            for out, (kind, value) in aggs.items()])
    return run.where("_before IS NULL").select(*rows.columns, *[F.col(f"_r_{out}").alias(out) for out in aggs])


def rank_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """Exact 1-based row number within ``keys``, however many rows a key or a tie has."""
    ranked = running_over_parts(sorted_parts(df, keys, order), keys, {out: ("sum", F.lit(1))})
    return ranked.withColumn(out, F.col(out).cast("bigint")).drop("_part", "_id")


def grid_cell(x: Column, steps: int) -> Column:
    """The first of ``steps`` even points of [0, 1] whose value is >= x, found with the grid values themselves; past the last one ``steps``."""
    n = steps - 1
    guess = F.floor(x * n).cast("int")
    cell = F.when(guess.cast("double") / n >= x, guess).otherwise(guess + 1)
    return F.least(F.greatest(cell, F.lit(0)), F.lit(steps))


def _before(keys: Sequence[str], ascending: bool = True):
    order = F.col("_b").asc() if ascending else F.col("_b").desc()
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Column,
            aggs: dict[str, tuple[str, Column]], ascending: bool = True) -> DataFrame:
    """Inclusive running aggregates ``{out: (sum|max|min, value)}`` along ``order`` within ``keys``.

    ``ascending`` says whether ``coarse`` grows (True) or falls (False) along ``order``.
    """
    keys = list(keys)
    rows = df.withColumn("_b", coarse)
    for out, (_, value) in aggs.items():
        rows = rows.withColumn(f"_v_{out}", value)
    totals = rows.groupBy(*keys, "_b").agg(
        *[_COMBINE[kind][0](f"_v_{out}").alias(f"_t_{out}") for out, (kind, _) in aggs.items()])
    before = _before(keys, ascending)
    offsets = totals.select(*keys, "_b", *[
        _COMBINE[kind][0](f"_t_{out}").over(before).alias(f"_o_{out}") for out, (kind, _) in aggs.items()])
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[
        _COMBINE[kind][0](f"_v_{out}").over(local).alias(f"_l_{out}") for out, (kind, _) in aggs.items()])
    joined = join_keys(rows, offsets, [*keys, "_b"])
    return joined.select(*df.columns, *[
        _COMBINE[kind][1](F.col(f"_o_{out}"), F.col(f"_l_{out}")).alias(out) for out, (kind, _) in aggs.items()])


def blocks_with_halo(df: DataFrame, rn: str, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Cut dense 1-based row numbers into blocks; copy each row to every block whose frames can reach it.

    Windows then partition by (key, _blk); ``drop_halo`` removes the copies. Exact for frames that look at most
    ``before`` rows back and ``after`` rows ahead, however long; a frame longer than a block copies rows further.
    """
    block = max(block, before, after)
    at = lambda n: F.floor(n / block).cast("bigint")
    place = F.col(rn) - 1
    if not before and not after:
        return df.withColumn("_blk", at(place)).withColumn("_own", F.lit(True))
    reached = F.sequence(F.greatest(at(place - after), F.lit(0).cast("bigint")), at(place + before))
    return df.withColumn("_home", at(place)).withColumn("_blk", F.explode(reached)).withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_blk", "_own")


def block_window(keys: Sequence[str], rn: str):
    return Window.partitionBy(*keys, "_blk").orderBy(rn)


def lag_rows(df: DataFrame, keys: Sequence[str], rn: str, cols: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Previous row's ``cols`` ({source: out}) within ``keys`` by dense row number ``rn``."""
    w = block_window(keys, rn)
    cut = blocks_with_halo(df, rn, before=1, block=block)
    return drop_halo(cut.select("*", *[F.lag(src).over(w).alias(out) for src, out in cols.items()]))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``; a partial aggregate, so a hot key costs no more than others."""
    best = F.min_by(F.struct(*take), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in take])


def interpolate_on_grid(knots: DataFrame, keys: Sequence[str], x: Column, y: Column, tie: Column, steps: int,
                        left: float | None = None, out: str = "y") -> DataFrame:
    """Piecewise-linear lookup of (x, y) knots on ``steps`` even points of [0, 1], as rows (keys, g, x, out).

    Every knot is folded into the grid cell it falls in by a partial aggregate: the last knot at or before each
    grid point and the first one after it are all that is needed. Of knots with equal x the last by ``tie`` wins.
    Below the first knot ``left`` (or the first value) applies, above the last the last value.
    """
    keys = list(keys)
    n = steps - 1
    k = knots.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y"), tie.alias("_tie"))
    k = k.withColumn("_g", grid_cell(F.col("_x"), steps))
    per_cell = k.groupBy(*keys, "_g").agg(
        F.max_by(F.struct("_x", "_y"), F.struct("_x", "_tie")).alias("_last"),
        F.min_by(F.struct("_x", "_y"), F.struct("_x", "_tie")).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_g")
    lead_g, lead_first = F.lead("_g").over(w), F.lead("_first").over(w)
    # each filled cell serves the grid points up to the next one; the first also those before it
    spans = per_cell.select(
        *keys, F.col("_g").alias("_lo"), (F.coalesce(lead_g, F.lit(steps)) - 1).alias("_hi"), F.col("_last").alias("_a"),
        lead_first.alias("_b"), F.when(F.lag("_g").over(w).isNull() & (F.col("_g") > 0), F.col("_first")).alias("_head"))
    none = F.lit(None).cast(spans.schema["_a"].dataType)
    body = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    head = F.when(F.col("_head").isNotNull(), F.struct(
        F.lit(0).alias("lo"), (F.col("_lo") - 1).alias("hi"), none.alias("a"), F.col("_head").alias("b")))
    pieces = F.filter(F.array(body, head), lambda s: s.isNotNull() & (s["lo"] <= s["hi"]))
    filled = (spans.select(*keys, F.explode(pieces).alias("_s"))
              .select(*keys, "_s.a", "_s.b", F.explode(F.sequence(F.col("_s.lo"), F.col("_s.hi"))).alias("_g")))
    gx = F.col("_g").cast("double") / n
    a, b = F.col("a"), F.col("b")
    low = F.lit(left).cast("double") if left is not None else b["_y"]
    value = (F.when(a.isNull(), low).when(b.isNull() | (a["_x"] == gx), a["_y"])
             .otherwise(a["_y"] + (b["_y"] - a["_y"]) / (b["_x"] - a["_x"]) * (gx - a["_x"])))
    return filled.where(F.col("_g") < steps).select(*keys, F.col("_g").alias("g"), gx.alias("x"), value.alias(out))
