"""Polygon shapefiles (.shp with .dbf) through Spark's binary reader, one row a shape with its attributes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shapes(data: bytes) -> Iterator[list[list[dict]]]:
    """The rings of each polygon record; other records give no ring."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack(">i", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            yield []
            continue
        n_parts, n_points = struct.unpack("<2i", body[36:44])
        parts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        start = 44 + 4 * n_parts
        points = [dict(zip("xy", struct.unpack_from("<2d", body, start + 16 * i))) for i in range(n_points)]
        yield [points[a:z] for a, z in zip(parts, parts[1:])]


def records(data: bytes) -> Iterator[dict[str, str]]:
    """The attributes of each record, as trimmed text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for i in range(n):
        row, off = data[head + i * size : head + (i + 1) * size], 1
        out = {}
        for name, width in fields:
            out[name] = row[off : off + width].decode("latin-1").strip()
            off += width
        yield out


def read_shapefile(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(shape_id, ord, rings, attributes): key is the attribute that names a shape; path ends in .shp."""
    files = spark.read.format("binaryFile").load([path, path[:-4] + ".dbf"]).select(F.lower(F.substring("path", -4, 4)).alias("kind"), "content")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(batch["kind"], batch["content"]))
        rows = [(r.get(key), i, rings, r) for i, (rings, r) in enumerate(zip(shapes(parts[".shp"]), records(parts[".dbf"])))]
        return pd.DataFrame(rows, columns=["shape_id", "ord", "rings", "attributes"])

    return files.withColumn("layer", F.lit(1)).groupBy("layer").applyInPandas(run, "shape_id string, ord long, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>")


def subset(layer: DataFrame, column: str, values: list, invert: bool = False) -> DataFrame:
    """Shapes whose attribute is, or is not, one of the values; null counts as not."""
    inside = F.coalesce(F.col(column).isin(values), F.lit(False))
    return layer.where(~inside if invert else inside)
