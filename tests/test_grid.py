"""The grid by joins against the same steps over arrays."""

import numpy as np
import pytest

from orrery.operators import grid, render


@pytest.mark.parametrize(("nside", "degrees", "missing"), [(4, 10.0, 0), (4, 7.5, 60), (2, 30.0, 47), (1, 20.0, 3)])
def test_equal_to_arrays(spark, nside, degrees, missing):
    rng = np.random.default_rng(nside)
    cells = 12 * nside * nside
    label = rng.integers(0, 5, cells)
    colour = rng.random((5, 3))
    known = np.sort(rng.permutation(cells)[missing:])
    best = spark.createDataFrame([(int(c), int(label[c])) for c in known], "cell_id int, label int")
    colours = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(colour)], "label int, r double, g double, b double")
    values = np.full((cells, 3), np.nan)
    values[known] = colour[label[known]]
    whole = render.filled(values, nside)
    field = grid.interpolated(grid.cell_colours(best, colours, nside), nside, degrees).persist()
    rows, cols = round(180 / degrees), round(360 / degrees)

    def array(df):
        out = np.full((rows, cols, 3), np.nan)
        for r in df.collect():
            out[r["row"], r["col"]] = r["r"], r["g"], r["b"]
        return out

    assert np.allclose(array(field), render.interpolated(whole, nside, degrees), atol=1e-9)
    soft = grid.smoothed(field, degrees).persist()
    want = render.smooth(render.interpolated(whole, nside, degrees))
    assert np.allclose(array(soft), want, atol=1e-9)
    packed = {(r["row"], r["col"]): (r["colour"], r["number"]) for r in grid.palette(soft).collect()}
    seen, number = render.palette(array(soft))
    assert all(packed[i, j] == (seen[number[i, j]], number[i, j]) for i in range(rows) for j in range(cols))
    field.unpersist()
    soft.unpersist()


def test_no_data_is_grey(spark):
    none = spark.createDataFrame([], "cell_id int, label int")
    colours = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "label int, r double, g double, b double")
    assert {(r["r"], r["g"], r["b"]) for r in grid.cell_colours(none, colours, 2).collect()} == {(0.5, 0.5, 0.5)}
