"""Zones, lines, parking slots and tiles joined with objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visiontables.functions import boxes as B
from visiontables.functions import geometry as G

Zones = dict[str, list[tuple[float, float]]]


def regions_table(spark: SparkSession, zones: Zones) -> DataFrame:
    """Configured zones as rows (region_id, name, pts)."""
    rows = [(i, name, [(float(x), float(y)) for x, y in pts]) for i, (name, pts) in enumerate(zones.items())]
    return spark.createDataFrame(rows, "region_id int, name string, pts array<struct<x:double,y:double>>")


def region_join(objects: DataFrame, regions: DataFrame, x: str = "cx", y: str = "cy", edge_inside: bool = False,
                size: float = 128) -> DataFrame:
    """Objects with every region that holds their centre, met in the grid cells the regions touch."""
    bound = G.points_box(F.col("pts"))
    cells = (regions.withColumn("_b", bound)
             .withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_b.x1") / size), F.floor(F.col("_b.x2") / size))))
             .withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_b.y1") / size), F.floor(F.col("_b.y2") / size)))).drop("_b"))
    placed = objects.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))
    inside = G.point_in_points(F.col(x), F.col(y), F.col("pts"), edge_inside)
    return placed.join(cells, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy", "pts")


def tag_zones(x: Column, y: Column, zones: Zones, edge_inside: bool = False) -> Column:
    """Names of the configured zones around a point, as an array; no join."""
    hits = [F.when(G.point_in_polygon(x, y, pts, edge_inside), F.lit(name)) for name, pts in zones.items()]
    return F.filter(F.array(*hits), lambda n: n.isNotNull())


def line_cross_join(steps: DataFrame, lines: Zones) -> DataFrame:
    """Track steps (px, py to cx, cy) with every configured line they cross or touch."""
    p, q = (F.col("px"), F.col("py")), (F.col("cx"), F.col("cy"))
    hits = [F.when(G.segments_intersect(p, q, *pts), F.lit(name)) for name, pts in lines.items()]
    named = F.filter(F.array(*hits), lambda n: n.isNotNull())
    return steps.where("px IS NOT NULL").withColumn("line", F.explode(named))


def pair_distance(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Centre distance, frame by frame, of chosen track pairs (source_id, a_id, b_id); centres cut to integers."""
    at = objects.select("source_id", "frame", "track_id", F.floor("cx").alias("x"), F.floor("cy").alias("y"))
    a = pairs.join(at.withColumnRenamed("track_id", "a_id"), ["source_id", "a_id"])
    b = at.select("source_id", "frame", F.col("track_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return a.join(b, ["source_id", "frame", "b_id"]).select("source_id", "frame", "a_id", "b_id", F.sqrt(dx * dx + dy * dy).alias("distance"))


def occupancy(objects: DataFrame, slots: Zones) -> DataFrame:
    """Per frame and slot whether any object's integer centre is inside or on the edge."""
    x, y = F.col("cx").cast("int").cast("double"), F.col("cy").cast("int").cast("double")
    per_frame = objects.groupBy("source_id", "frame").agg(*[
        F.bool_or(G.point_in_polygon(x, y, pts, edge_inside=True)).alias(f"_s{i}") for i, pts in enumerate(slots.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("slot"), F.col(f"_s{i}").alias("taken")) for i, name in enumerate(slots)])
    return per_frame.select("source_id", "frame", F.explode(rows).alias("r")).select("source_id", "frame", "r.*")


def _axis(low: Column, high: Column, length: Column, size: int, step: int) -> tuple[Column, Column]:
    """Tile numbers along one side that an interval can touch, and the start of the (pulled-in) last tile."""
    n = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step + 1)).cast("int")
    last = F.greatest(length - size, F.lit(0))
    first = F.least(F.greatest(F.floor((low - size) / step).cast("int") + 1, F.lit(0)), n - 1)
    final = F.when(high > last, n - 1).otherwise(F.least(F.floor(high / step).cast("int"), n - 1))
    return F.sequence(first, F.greatest(first, final)), last


def tile_objects(objects: DataFrame, sizes=((256, 64),), min_iof: float = 0.7, min_rate: float = 0.6, eps: float = 0.01) -> DataFrame:
    """Objects (x1..y2, image size w, h) with each tile of their image that holds at least ``min_iof`` of their area.

    The tiles of an image follow from its size, so the few an object can touch are computed in the row; nothing is
    joined. All tiles of one size are filled alike, so the fill rule keeps or drops a whole size.
    """
    b = B.box()
    fill = [F.least(F.lit(1.0), F.col("w") / size) * F.least(F.lit(1.0), F.col("h") / size) for size, _ in sizes]
    best = F.greatest(*fill) if len(fill) > 1 else fill[0]
    parts = []
    for (size, gap), rate in zip(sizes, fill):
        step = size - gap
        kept = F.when(best > min_rate, rate > min_rate).otherwise(F.abs(rate - best) < eps)
        xs, last_x = _axis(b.x1, b.x2, F.col("w"), size, step)
        ys, last_y = _axis(b.y1, b.y2, F.col("h"), size, step)
        d = objects.where(kept).withColumn("_i", F.explode(xs)).withColumn("_j", F.explode(ys))
        x, y = F.least(F.col("_i") * step, last_x).cast("bigint"), F.least(F.col("_j") * step, last_y).cast("bigint")
        parts.append(d.withColumn("tile", F.struct(x.alias("x1"), y.alias("y1"), (x + size).alias("x2"), (y + size).alias("y2"))))
    d = parts[0]
    for more in parts[1:]:
        d = d.unionByName(more)
    t = B.Box(*[F.col(f"tile.{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])
    share = B.intersection(b, t) / F.greatest(B.area(b), F.lit(1e-6))
    return d.withColumn("iof", share).where(F.col("iof") >= min_iof).drop("_i", "_j")


def tile_quads(objects: DataFrame, sizes=((256, 64),), min_iof: float = 0.7) -> DataFrame:
    """As ``tile_objects`` for four-point outlines in ``pts``: of the tiles that the outline's box touches, those that hold enough of it."""
    bounds = G.quad_box(F.col("pts")).named("x1", "y1", "x2", "y2")
    bounded = objects.select(F.struct("*").alias("_object"), "w", "h", *bounds, G.quad_area(F.col("pts")).alias("_area"))
    rect = B.Box(*[F.col(f"tile.{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])
    own = B.box()
    inside = (own.x1 >= rect.x1) & (own.y1 >= rect.y1) & (own.x2 <= rect.x2) & (own.y2 <= rect.y2)
    most = B.intersection(own, rect) / F.greatest(F.col("_area"), F.lit(1e-6))
    # clip only where the outline's box leaves the answer open
    share = F.when(inside, F.lit(1.0)).when(most < min_iof, F.lit(0.0)).otherwise(G.quad_iof(F.col("_object.pts"), rect))
    touched = tile_objects(bounded, sizes, min_iof=0.0).withColumn("iof", share)
    return touched.where(F.col("iof") >= min_iof).select("_object.*", "tile", "iof")
