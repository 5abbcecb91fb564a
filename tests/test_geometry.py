import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import healpix
from orrery.operators import affinity, render


def test_known_centres(spark):
    got = {r["cell_id"]: (r["lon"], r["lat"]) for r in healpix.cells(spark, 32).collect()}
    for cell, want in {0: (45, 1.193748), 1: (46.40625, 2.388015), 1023: (45, 88.538029), 1024: (135, 1.193748), 4096: (0, -40.228185), 8192: (45, -88.538029), 12287: (-45, -1.193748)}.items():
        assert got[cell] == pytest.approx(want, abs=1e-6)
    assert abs(sum(abs(lat) > 60 for _, lat in got.values()) / len(got) - 0.1367) < 1e-4


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_orders_agree(spark, nside):
    rows = healpix.cells(spark, nside).collect()
    assert sorted(r["ring_id"] for r in rows) == list(range(12 * nside * nside))
    lon, lat = healpix.ring_lonlat(F.col("ring_id"), nside)
    for r in healpix.cells(spark, nside).select("*", lon.alias("x"), lat.alias("y")).collect():
        assert (r["lon"] - r["x"] + 180) % 360 - 180 == pytest.approx(0, abs=1e-9) and r["lat"] == pytest.approx(r["y"])
        assert healpix.angular_cell(r["lon"] + 1e-7, r["lat"] + 1e-7, nside) == r["cell_id"]


def test_neighbours(spark):
    assert healpix.neighbours(spark, 4).count() == 12 * 2 * 4 * 3
    with pytest.raises(ValueError):
        healpix.nest_to_ring(F.lit(0), 3)


def test_map(spark):
    cells = healpix.cells(spark, 4).withColumn("label", F.when(F.col("lat") > 0, 0).otherwise(1)).where("cell_id <> 7")
    colours = affinity.rainbow(np.array([0.0, 1.0]))
    assert colours.tolist() == [[0, 0, 1], [1, 0, 0]]
    svg = render.world_map(cells, colours, 4, "halves", [np.array([[0, 0], [10, 10]])], 10.0)
    assert svg.startswith("<svg") and "polyline" in svg and "0000ff" in svg
    assert "circle" in render.world_map(cells, colours, 4, heatmap=False)
    x, y = render.mollweide(np.array([0.0, 180.0, 0.0]), np.array([0.0, 0.0, 90.0]))
    assert np.allclose(x, [0, 2, 0], atol=1e-6) and np.allclose(y, [0, 0, 1], atol=1e-3)
    flat = np.full((10, 20, 3), 0.25)
    assert np.allclose(render.smooth(flat), flat)


def test_seriation_follows_a_chain():
    k = 9
    order = np.random.default_rng(0).permutation(k)
    a = np.exp(-np.abs(order[:, None] - order[None, :]) / 1.5)
    rank = affinity.seriation(a)
    assert (rank == order).all() or (rank == k - 1 - order).all()
    assert affinity.colours(np.ones((1, 1))).shape == (1, 4)


def test_all_edges(spark):
    """Every cell has four edges; those inside a face are the neighbours; ends are about a cell's width apart."""
    for nside in (1, 2, 4):
        pairs = {(r["a"], r["b"]) for r in healpix.edges(spark, nside).collect()}
        degree = np.bincount(np.array(sorted(pairs)).ravel(), minlength=12 * nside * nside)
        assert len(pairs) == 24 * nside * nside and (degree == 4).all()
        assert {(r["a"], r["b"]) for r in healpix.neighbours(spark, nside).collect()} <= pairs
    place = {r["cell_id"]: (np.radians(r["lon"]), np.radians(r["lat"])) for r in healpix.cells(spark, 4).collect()}
    for a, b in pairs:
        (l, p), (m, q) = place[a], place[b]
        assert np.degrees(np.arccos(np.clip(np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * np.cos(l - m), -1, 1))) < 26


def test_interpolation(spark):
    rows = healpix.cells(spark, 8).collect()
    field = np.zeros((len(rows), 1))
    for r in rows:
        field[r["cell_id"]] = np.sin(np.radians(r["lat"]))
    got = render.interpolated(field, 8, 10.0)[..., 0]
    assert np.abs(got - np.sin(np.radians(np.arange(85, -90, -10)))[:, None]).max() < 0.03
    assert np.allclose(render.interpolated(np.ones((12, 1)), 1, 30.0), 1)
    gap = field.copy()
    gap[5] = np.nan
    assert np.abs(render.filled(gap, 8) - field).max() < 0.2 and not np.isnan(render.filled(gap, 8)).any()


def test_seriation_of_parts_and_turbo():
    blocks = np.kron(np.eye(2), np.ones((3, 3)))
    rank = affinity.seriation(blocks)
    assert {tuple(sorted(rank[:3])), tuple(sorted(rank[3:]))} == {(0, 1, 2), (3, 4, 5)} and affinity.seriation(np.eye(4)).tolist() is not None
    assert np.allclose(affinity.turbo([0.0, 0.5, 1.0]), [[0.19, 0.07, 0.23], [0.64, 0.99, 0.23], [0.48, 0.02, 0.01]], atol=0.13)  # the polynomial is that close to the table
