"""Points, polygons and datums: point-in-polygon by grid cells, geography coverage, the national datum shift."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPE = "shape_id string, ord long, rings array<array<struct<x:double,y:double>>>"


def valid_point(x: Column, y: Column, geographic: bool = True) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    ok = finite(x) & finite(y)
    return ok & x.between(-180, 180) & y.between(-90, 90) if geographic else ok


def in_rings(x: float, y: float, rings) -> bool:
    """Even-odd rule over all rings; the boundary counts as inside."""
    inside = False
    for ring in rings:
        n = len(ring)
        for i in range(n):
            (ax, ay), (bx, by) = (ring[i]["x"], ring[i]["y"]), (ring[(i + 1) % n]["x"], ring[(i + 1) % n]["y"])
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


@F.pandas_udf(T.BooleanType())
def _inside(x: pd.Series, y: pd.Series, rings: pd.Series) -> pd.Series:
    return pd.Series([in_rings(a, b, r) for a, b, r in zip(x, y, rings)])


def point_in_polygon(points: DataFrame, shapes: DataFrame, cell: float = 1.0, mode: str = "first", geographic: bool = True) -> DataFrame:
    """points: longitude, latitude and more; shapes: SHAPE. Adds shape_id and ord (null outside all shapes).

    Distinct coordinates meet shapes by grid cell, an equi-join; only those inside a shape's box go to the exact test.
    """
    if mode not in ("first", "all"):
        raise ValueError("mode must be first or all")
    dots = points.select("longitude", "latitude").where(valid_point(F.col("longitude"), F.col("latitude"), geographic)).distinct()
    dots = dots.withColumns({"cx": F.floor(F.col("longitude") / cell), "cy": F.floor(F.col("latitude") / cell)})

    def all_of(axis: str) -> Column:
        return F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[axis])))

    xs, ys = all_of("x"), all_of("y")
    boxes = shapes.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    cells = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    near = dots.join(cells, ["cx", "cy"]).where(F.col("longitude").between(F.col("x0"), F.col("x1")) & F.col("latitude").between(F.col("y0"), F.col("y1")))
    hits = near.where(_inside("longitude", "latitude", "rings")).select("longitude", "latitude", "shape_id", "ord")
    if mode == "first":
        hits = hits.groupBy("longitude", "latitude").agg(F.min_by("shape_id", "ord").alias("shape_id"), F.min("ord").alias("ord"))
    return points.join(hits, ["longitude", "latitude"], "left")


def coverage(addresses: DataFrame, layer: DataFrame, attributes: list[str]) -> DataFrame:
    """Long form per attribute: addresses, how many have a value, percent (null without addresses), orphans of the layer."""
    both = addresses.select("address_detail_pid").join(layer, "address_detail_pid", "left")
    counts = both.agg(F.count("*").alias("n"), *[F.count(a).alias(f"c_{a}") for a in attributes])
    orphans = layer.join(addresses.select("address_detail_pid"), "address_detail_pid", "left_anti").agg(F.count("*").alias("orphans"))
    long = counts.join(orphans).select("n", "orphans", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"c_{a}").alias("non_missing")) for a in attributes])).alias("x"))
    return long.select("x.attribute", "n", "x.non_missing", (F.col("x.non_missing") * 100.0 / F.nullif(F.col("n"), F.lit(0))).alias("pct"), "orphans")


def heat(points: DataFrame, size: float) -> DataFrame:
    """A two-dimensional histogram of points."""
    return points.where(valid_point(F.col("longitude"), F.col("latitude"))).groupBy((F.floor(F.col("longitude") / size) * size).alias("x"), (F.floor(F.col("latitude") / size) * size).alias("y")).agg(F.count("*").alias("n"))


# GRS80 and the published seven parameters from GDA94 to GDA2020 (metres, parts per million, arc seconds).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
SHIFT, SCALE, ROTATION = (0.06155, -0.01087, -0.04019), -0.009994, (-0.0394924, -0.0327221, -0.0328979)


def gda94_to_gda2020(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Geographic coordinates of the newer datum, at ellipsoid height zero (coordinate-frame rotation)."""
    e2 = FLATTENING * (2 - FLATTENING)
    f, l = F.radians(lat), F.radians(lon)
    nu = F.lit(AXIS) / F.sqrt(1 - e2 * F.pow(F.sin(f), F.lit(2)))
    x, y, z = nu * F.cos(f) * F.cos(l), nu * F.cos(f) * F.sin(l), nu * (1 - e2) * F.sin(f)
    rx, ry, rz = (math.radians(r / 3600) for r in ROTATION)
    s = 1 + SCALE * 1e-6
    x2 = SHIFT[0] + s * (x + rz * y - ry * z)
    y2 = SHIFT[1] + s * (-rz * x + y + rx * z)
    z2 = SHIFT[2] + s * (ry * x - rx * y + z)
    p, b = F.sqrt(x2 * x2 + y2 * y2), AXIS * (1 - FLATTENING)
    t = F.atan2(z2 * AXIS, p * b)
    e3 = e2 / (1 - e2)
    lat2 = F.atan2(z2 + e3 * b * F.pow(F.sin(t), F.lit(3)), p - e2 * AXIS * F.pow(F.cos(t), F.lit(3)))
    return F.degrees(F.atan2(y2, x2)), F.degrees(lat2)


def metres_apart(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt(F.pow((lon2 - lon1) * 111320.0 * F.cos(F.radians(lat1)), F.lit(2)) + F.pow((lat2 - lat1) * 110574.0, F.lit(2)))
