"""A field over HEALPix cells on a grid of latitudes and longitudes, by joins: nearest fill, linear interpolation, smoothing, palette.

Cells (12 nside^2) and grid points (a few ten thousand) are fixed in number, whatever the number of tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import healpix

RGB = ("r", "g", "b")


def cell_colours(dominant: DataFrame, colours: DataFrame, nside: int) -> DataFrame:
    """(ring_id, r, g, b) of all cells: the colour of the dominant label; cells without data take the nearest one's that has (least id on ties)."""
    spark = dominant.sparkSession
    places = healpix.cells(spark, nside)
    known = dominant.join(F.broadcast(colours), "label").select("cell_id", *RGB)
    rows = places.join(known, "cell_id", "left").select("cell_id", "ring_id", "lon", "lat", *RGB)
    have = rows.where("r is not null").orderBy("cell_id").collect()  # at most 12 nside^2 cells
    if not have:
        return rows.select("ring_id", *[F.lit(0.5).alias(c) for c in RGB])
    unit = lambda lon, lat: np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], axis=1)
    shared = spark.sparkContext.broadcast((unit(np.array([r["lon"] for r in have]), np.array([r["lat"] for r in have])), np.array([[r[c] for c in RGB] for r in have], float)))

    def fill(batches):
        for batch in batches:
            place, colour = shared.value
            at = unit(batch.column("lon").to_numpy(), batch.column("lat").to_numpy())
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RGB], axis=1)
            for i in np.flatnonzero(np.isnan(own[:, 0].astype(float))):
                own[i] = colour[np.round(place @ at[i], 12).argmax()]
            yield pa.record_batch({"ring_id": batch.column("ring_id")} | {c: pa.array(own[:, j].astype(float)) for j, c in enumerate(RGB)})

    return rows.mapInArrow(fill, "ring_id long, r double, g double, b double")


def grid_points(spark: SparkSession, degrees: float) -> DataFrame:
    """(row, col, lat, lon) of the middles of a grid, north first, longitudes from -180 on given in [0, 360)."""
    rows, cols = round(180 / degrees), round(360 / degrees)
    row, col = F.floor(F.col("id") / cols), F.col("id") % cols
    lon = F.pmod(F.lit(-180 + degrees / 2) + col * degrees, F.lit(360.0))
    return spark.range(rows * cols).select(row.cast("int").alias("row"), col.cast("int").alias("col"), (F.lit(90 - degrees / 2) - row * degrees).alias("lat"), lon.alias("lon"))


def _ring_lat(ring: Column, nside: int) -> Column:
    r = ring.cast("double")
    south = 4 * nside - r
    z = F.when(ring < nside, 1 - r * r / (3 * nside * nside)).when(ring > 3 * nside, south * south / (3 * nside * nside) - 1).otherwise((2 * nside - r) * 2 / (3 * nside))
    return F.degrees(F.asin(z))


def spots(points: DataFrame, nside: int) -> DataFrame:
    """(row, col, ring_id, weight): the cells a point is interpolated from, two on the ring above it and two on the ring below."""
    z = F.sin(F.radians("lat"))
    ring = F.when(z > 2 / 3, nside * F.sqrt(3 * (1 - z))).when(z < -2 / 3, 4 * nside - nside * F.sqrt(3 * (1 + z))).otherwise(2 * nside - 1.5 * nside * z)
    below = F.ceil(ring - 1e-9)  # the first ring at or south of the point
    placed = points.select("row", "col", "lat", "lon", below.alias("below"))
    last = 4 * nside - 1
    high, low = _ring_lat(F.col("below") - 1, nside), _ring_lat(F.col("below"), nside)
    part = (high - F.col("lat")) / (high - low)
    outside = (F.col("below") <= 1) | (F.col("below") > last)
    only = F.array(F.struct(F.greatest(F.lit(1).cast("long"), F.least(F.lit(last).cast("long"), "below")).alias("ring"), F.lit(1.0).alias("w")))
    both = F.array(F.struct((F.col("below") - 1).alias("ring"), (1 - part).alias("w")), F.struct(F.col("below").alias("ring"), part.alias("w")))
    rings = placed.select("row", "col", "lon", F.explode(F.when(outside, only).otherwise(both)).alias("s")).select("row", "col", "lon", "s.ring", "s.w")
    r = F.col("ring")
    quarter = F.least(r, F.lit(nside).cast("long"), 4 * nside - r)
    cap = (r < nside) | (r > 3 * nside)
    shift = F.when(cap | ((r - nside) % 2 == 0), 0.5).otherwise(0.0)
    first = F.when(r < nside, 2 * r * (r - 1)).when(r > 3 * nside, 12 * nside * nside - 2 * quarter * (quarter + 1)).otherwise(2 * nside * (nside - 1) + (r - nside) * 4 * nside)
    rings = rings.select("row", "col", "w", quarter.alias("quarter"), first.alias("first"), (F.col("lon") * quarter / 90 - shift).alias("at"))
    left = F.floor("at")
    inside = F.col("at") - left
    four = 4 * F.col("quarter")
    two = F.array(F.struct((F.col("first") + F.pmod(left, four)).alias("ring_id"), (F.col("w") * (1 - inside)).alias("weight")), F.struct((F.col("first") + F.pmod(left + 1, four)).alias("ring_id"), (F.col("w") * inside).alias("weight")))
    return rings.select("row", "col", F.explode(two).alias("s")).select("row", "col", "s.ring_id", "s.weight")


def interpolated(cells: DataFrame, nside: int, degrees: float) -> DataFrame:
    """(row, col, r, g, b) of the grid, linear along and between rings."""
    found = spots(grid_points(cells.sparkSession, degrees), nside).join(F.broadcast(cells), "ring_id")
    return found.groupBy("row", "col").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in RGB])


def gauss(sigma: float) -> dict[int, float]:
    """Weights by offset, of sum 1."""
    reach = max(1, int(4 * sigma + 0.5))
    weight = {o: math.exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)}
    total = sum(weight.values())
    return {o: w / total for o, w in weight.items()}


def smoothed(field: DataFrame, degrees: float, sigma: float = 0.9) -> DataFrame:
    """A separable Gaussian over the grid: it wraps in longitude, repeats the outer rows, and is clipped to [0, 1]."""
    rows, cols = round(180 / degrees), round(360 / degrees)
    offsets = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in gauss(sigma).items()])

    def along(df: DataFrame, row: Column, col: Column) -> DataFrame:
        asked = df.select("row", "col", F.explode(offsets).alias("k")).select("row", "col", F.col("k.w").alias("w"), row.cast("int").alias("y"), col.cast("int").alias("x"))
        there = df.select(F.col("row").alias("y"), F.col("col").alias("x"), *RGB)
        return asked.join(there, ["y", "x"]).groupBy("row", "col").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in RGB])

    across = along(field, F.col("row"), F.pmod(F.col("col") + F.col("k.o"), F.lit(cols)))
    down = along(across, F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.col("row") + F.col("k.o"))), F.col("col"))
    return down.select("row", "col", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias(c) for c in RGB])


def palette(field: DataFrame) -> DataFrame:
    """The grid with ``colour``, 8 bits a channel packed, and ``number``, its rank among the distinct colours."""
    eight = [F.round(F.col(c) * 255).cast("long") for c in RGB]
    packed = field.withColumn("colour", eight[0] * 65536 + eight[1] * 256 + eight[2])
    distinct = packed.select("colour").distinct().withColumn("number", F.row_number().over(Window.orderBy("colour")) - 1)  # colours of one grid
    return packed.join(distinct, "colour")
