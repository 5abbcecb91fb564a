"""HEALPix as column expressions (Gorski et al. 2005): nested cells to rings and to longitude and latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ring and longitude offsets of the twelve base faces.
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_LON = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _every_second_bit(value: Column, order: int) -> Column:
    """The even bits of a number, moved together."""
    out = F.lit(0).cast("long")
    for bit in range(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, 2 * bit).bitwiseAND(F.lit(1).cast("long")), bit))
    return out


def _order(nside: int) -> int:
    order = int(nside).bit_length() - 1
    if nside < 1 or 1 << order != nside:
        raise ValueError("nside has to be a power of two")
    return order


def nest_xyf(cell: Column, nside: int) -> tuple[Column, Column, Column]:
    """Column, row and face of a nested cell."""
    order, cell = _order(nside), cell.cast("long")
    within = cell % (nside * nside)
    return _every_second_bit(within, order), _every_second_bit(F.shiftright(within, 1), order), F.floor(cell / (nside * nside))


def _ring_place(cell: Column, nside: int) -> dict[str, Column]:
    x, y, face = nest_xyf(cell, nside)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (face + 1).cast("int")).cast("long")
    ring = pick(FACE_RING) * nside - x - y - 1
    north, south = ring < nside, ring > 3 * nside
    quarter = F.when(north, ring).when(south, 4 * nside - ring).otherwise(nside).cast("long")
    shift = F.when(north | south, 0).otherwise((ring - nside).bitwiseAND(F.lit(1).cast("long")))
    place = F.floor((pick(FACE_LON) * quarter + x - y + 1 + shift) / 2)
    place = F.when(place > 4 * quarter, place - 4 * quarter).when(place < 1, place + 4 * quarter).otherwise(place)
    return {"ring": ring, "quarter": quarter, "shift": shift, "place": place, "north": north, "south": south}


def nest_to_ring(cell: Column, nside: int) -> Column:
    p = _ring_place(cell, nside)
    cells, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    before = F.when(p["north"], 2 * p["quarter"] * (p["quarter"] - 1)).when(p["south"], cells - 2 * (p["quarter"] + 1) * p["quarter"]).otherwise(cap + (p["ring"] - nside) * 4 * nside)
    return (before + p["place"] - 1).cast("long")


def _signed_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def nest_lonlat(cell: Column, nside: int) -> tuple[Column, Column]:
    """Degrees, longitude in [-180, 180)."""
    p = _ring_place(cell, nside)
    cap = p["quarter"].cast("double") * p["quarter"] / (3.0 * nside * nside)
    z = F.when(p["north"], 1 - cap).when(p["south"], cap - 1).otherwise((2 * nside - p["ring"]) * 2.0 / (3.0 * nside))
    lon = (p["place"] - (p["shift"] + 1) * 0.5) * 90.0 / p["quarter"]
    return _signed_lon(lon), F.degrees(F.asin(z))


def ring_lonlat(cell: Column, nside: int) -> tuple[Column, Column]:
    """Degrees of a ring-ordered cell, longitude in [0, 360)."""
    cell = cell.cast("long")
    cells, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    mirrored = F.when(cell >= cells - cap, cells - 1 - cell).otherwise(cell)
    ring = F.floor((1 + F.sqrt(1.0 + 2 * mirrored)) / 2)
    in_ring = mirrored - 2 * ring * (ring - 1)
    polar = (cell < cap) | (cell >= cells - cap)
    step = F.when(cell >= cells - cap, 4 * ring - 1 - in_ring).otherwise(in_ring)
    band = F.floor((cell - cap) / (4 * nside))
    odd = (band + 1) % 2
    z_cap = 1 - ring.cast("double") * ring / (3.0 * nside * nside)
    z = F.when(polar, F.when(cell < cap, z_cap).otherwise(-z_cap)).otherwise((nside - band) * 2.0 / (3.0 * nside))
    lon = F.when(polar, (step + 0.5) * 90.0 / ring).otherwise(((cell - cap) % (4 * nside) + odd * 0.5) * 90.0 / nside)
    return lon, F.degrees(F.asin(z))


def cells(spark: SparkSession, nside: int) -> DataFrame:
    """cell_id (nested), ring_id, lon, lat."""
    lon, lat = nest_lonlat(F.col("id"), nside)
    return spark.range(12 * nside * nside).select(F.col("id").cast("int").alias("cell_id"), nest_to_ring(F.col("id"), nside).alias("ring_id"), lon.alias("lon"), lat.alias("lat"))


def neighbours(spark: SparkSession, nside: int) -> DataFrame:
    """(a, b), a < b: cells of one face that share an edge."""
    x, y, face = nest_xyf(F.col("id"), nside)
    grid = spark.range(12 * nside * nside).select(F.col("id").cast("int").alias("cell"), x.alias("x"), y.alias("y"), face.alias("face"))
    steps = grid.select("cell", "face", F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))).alias("to"))
    there = grid.select(F.col("cell").alias("other"), F.col("face").alias("f"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = steps.join(there, (F.col("face") == F.col("f")) & (F.col("to.x") == F.col("tx")) & (F.col("to.y") == F.col("ty")))
    return found.select(F.least("cell", "other").alias("a"), F.greatest("cell", "other").alias("b"))


def edges(spark: SparkSession, nside: int) -> DataFrame:
    """(a, b), a < b: all cells that share an edge, across base faces too.

    A corner of a cell lies on a circle between rings (0 at the north pole,
    4 nside at the south pole) at a multiple of an eighth of a turn over the
    circle's quarter, so it has the same pair of whole numbers in each face that
    touches it.  Two cells share an edge if they share both of its corners.
    """
    x, y, face = nest_xyf(F.col("id"), nside)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (face + 1).cast("int")).cast("long")

    def corner(dx: int, dy: int) -> Column:
        circle = pick(FACE_RING) * nside - (x + dx) - (y + dy)
        quarter = F.least(circle, F.lit(nside).cast("long"), 4 * nside - circle)
        turn = F.when(quarter > 0, F.pmod(pick(FACE_LON) * quarter + (x + dx) - (y + dy), F.greatest(8 * quarter, F.lit(1).cast("long")))).otherwise(0)
        return F.struct(circle.alias("circle"), turn.cast("long").alias("turn"))

    ring = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
    sides = F.array(*[F.array_sort(F.array(ring[i], ring[(i + 1) % 4])) for i in range(4)])
    rows = spark.range(12 * nside * nside).select(F.col("id").cast("int").alias("cell"), F.explode(sides).alias("side"))
    pairs = rows.groupBy("side").agg(F.min("cell").alias("a"), F.max("cell").alias("b"))  # two cells a side
    return pairs.where("a < b").select("a", "b").distinct()


def angular_cell(lon: float, lat: float, nside: int) -> int:
    """The nested cell of a point in degrees (for grids drawn on the driver)."""
    z, phi = math.sin(math.radians(lat)), (math.radians(lon) % (2 * math.pi)) / (math.pi / 2)
    if abs(z) <= 2 / 3:
        up, down = nside * (0.5 + phi - z * 0.75), nside * (0.5 + phi + z * 0.75)
        a, b = int(up), int(down)
        fa, fb = a // nside, b // nside
        face = (fa % 4) + 4 if fa == fb else fa % 4 if fa < fb else fb % 4 + 8
        x, y = b % nside, nside - a % nside - 1
    else:
        quarter = min(int(phi), 3)
        near = nside * math.sqrt(3 * (1 - abs(z)))
        a, b = min(int((phi - quarter) * near), nside - 1), min(int((1 - phi + quarter) * near), nside - 1)
        face, x, y = (quarter, nside - b - 1, nside - a - 1) if z > 0 else (quarter + 8, a, b)
    out = 0
    for bit in range(_order(nside)):
        out |= ((x >> bit) & 1) << 2 * bit | ((y >> bit) & 1) << 2 * bit + 1
    return face * nside * nside + out
