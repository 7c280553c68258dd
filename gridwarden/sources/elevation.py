"""Elevation of points from zipped height tiles.

Tiles are decoded in Arrow batches, one tile at a time, to one row per scan line. A tile is then spread
over its lines, so a tile that holds most points is still met by many tasks in an ordinary equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.session import cut_lineage

NO_DATA = -32768
_LINES = "south_lat int, west_lon int, side int, line int, samples array<int>"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    import zipfile

    import numpy as np

    for batch in batches:
        for row in batch.itertuples(index=False):
            with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                member = next((n for n in archive.namelist() if n.lower().endswith(".hgt")), None)
                if member is None:
                    raise ValueError(f"no height member in {row.path}")
                heights = np.frombuffer(archive.read(member), dtype=">i2")
            side = int(round(heights.size**0.5))
            if side * side != heights.size:
                raise ValueError(f"heights in {row.path} are not a square")
            grid = heights.reshape(side, side).astype("int32")
            yield pd.DataFrame({"south_lat": row.south_lat, "west_lon": row.west_lon, "side": side, "line": range(side), "samples": list(grid)})


def read_height_lines(spark: SparkSession, path: str) -> DataFrame:
    """Scan lines of all tiles named like ``N17E042...zip``; other files are ignored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    part = [F.regexp_extract(name, r"^([NS])(\d{2})([EW])(\d{3})", i) for i in (1, 2, 3, 4)]

    def signed(letter: Column, digits: Column, negative: str) -> Column:
        return F.when(letter == negative, -digits.cast("int")).otherwise(digits.cast("int"))

    tiles = files.filter(part[0] != "").select("path", "content", signed(part[0], part[1], "S").alias("south_lat"), signed(part[2], part[3], "W").alias("west_lon"))
    return tiles.mapInPandas(_decode, _LINES)


def elevation_from_tiles(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Nearest sample per point; points on a tile's upper edge use the neighbour tile, no-data is NULL.

    ``lines`` should be a stored table (see ``stored_height_lines``), as it is read twice.
    """
    coords = points.select("latitude", "longitude").distinct()
    tiles = lines.filter("line = 0").select("south_lat", "west_lon", "side")
    lat, lon = F.floor("latitude").cast("int"), F.floor("longitude").cast("int")
    steps = ((0, 0), (1, 1), (1, 0), (0, 1))
    options = F.array(*[F.struct(F.lit(i).alias("_p"), (lat - a).alias("south_lat"), (lon - b).alias("west_lon")) for i, (a, b) in enumerate(steps)])
    wanted = coords.select("latitude", "longitude", F.explode(options).alias("_o")).select("latitude", "longitude", "_o.*")
    chosen = wanted.join(tiles, ["south_lat", "west_lon"]).groupBy("latitude", "longitude").agg(F.min_by(F.struct("south_lat", "west_lon", "side"), "_p").alias("_t"))
    chosen = chosen.select("latitude", "longitude", "_t.*")

    def index(value: Column) -> Column:
        last = F.col("side") - 1
        return F.greatest(F.lit(0), F.least(last, F.bround(value * last, 0).cast("int")))

    at = chosen.withColumns({"line": index(F.col("south_lat") + 1.0 - F.col("latitude")), "_c": index(F.col("longitude") - F.col("west_lon"))})
    found = at.join(lines, ["south_lat", "west_lon", "side", "line"])
    height = F.get("samples", "_c")
    heights = found.select("latitude", "longitude", F.when(height != NO_DATA, height.cast("double")).alias("elevation_m"))
    return points.drop("elevation_m").join(heights, ["latitude", "longitude"], "left")


def stored_height_lines(spark: SparkSession, path: str) -> DataFrame:
    """Decode tiles once into the shared folder."""
    return cut_lineage(read_height_lines(spark, path), "height-lines")


def attach_elevation(points: DataFrame, tile_path: str) -> DataFrame:
    """Add ``elevation_m`` to any point table."""
    return elevation_from_tiles(points, stored_height_lines(points.sparkSession, tile_path))
