from itertools import permutations

import numpy as np
import pytest

from rasterloom.functions.axes import Axes, Layout, axes_held, canonical_axes, stored_layout

#: The canonical orders.
NAMES = ["YX", "ZYX", "CYX", "TYX", "CZYX", "TCYX", "TZYX", "TCZYX"]


@pytest.mark.parametrize("bad", ["YYX", "CZX", "TCY", "XYQW", ""])
def test_axes_are_validated(bad):
    with pytest.raises(ValueError):
        Axes(bad)


def test_an_unknown_axis_needs_a_free_name():
    assert Axes("QYX").named().dims == "TYX" and Axes("TYXQ").named().dims == "TYXZ"
    with pytest.raises(ValueError):
        Axes("QTCZYX").named()


@pytest.mark.parametrize("name", NAMES)
def test_all_permutations_have_one_canonical_order(name):
    for p in permutations(name):
        assert Axes("".join(p)).canonical((2,) * len(p)).dims == name


def test_canonical_drops_units_but_keeps_x_and_y():
    assert Axes("TCZYX").canonical((1, 3, 1, 1, 5)).dims == "CYX"
    assert Axes("YXQ").canonical((4, 5, 2)).dims == "TYX"


@pytest.mark.parametrize("source", NAMES)
def test_layouts_equal_transpose_on_arrays_shapes_and_tiles(source):
    a = np.random.default_rng(1).random(tuple(range(2, 2 + len(source))))
    for p in permutations(source):
        target = "".join(p)
        want = a.transpose([source.index(d) for d in target])
        there = Layout(source, target)
        np.testing.assert_array_equal(there.array(a), want)
        np.testing.assert_array_equal(there.back().array(want), a)
        assert there.shape(a.shape) == want.shape and there.back().shape(want.shape) == a.shape
        tile = tuple(slice(1, n) for n in a.shape)
        np.testing.assert_array_equal(want[there.tile(tile)], there.array(a[tile]))


def test_layouts_drop_and_add_single_cells():
    a = np.random.default_rng(1).random((1, 3, 4, 5))
    there = Layout("TCYX", "YXCZ")
    assert there.array(a).shape == (4, 5, 3, 1) == there.shape(a.shape)
    np.testing.assert_array_equal(there.back().array(there.array(a)), a)
    assert there.tile((slice(0, 1), slice(1, 2), slice(0, 4), slice(2, 3))) == (slice(0, 4), slice(2, 3), slice(1, 2), slice(None))
    with pytest.raises(ValueError):
        Layout("TYX", "YX").shape((2, 3, 4))


@pytest.mark.parametrize("source", ["YXC", "CYX", "ZYXC"])
def test_channels_side_by_side(source):
    shape = {"Y": 4, "X": 5, "C": 3, "Z": 1}
    a = np.arange(60).reshape([shape[d] for d in source])
    there = Layout(source, "YX", 1, 3)
    folded = there.array(a)
    assert folded.shape == (4, 15) == there.shape(a.shape)
    np.testing.assert_array_equal(folded[2, 3:6], a.reshape(a.shape[-3:])[2, 1] if source != "CYX" else a[:, 2, 1])
    np.testing.assert_array_equal(there.back().array(folded), a)
    tile = tuple({"Y": slice(1, 3), "X": slice(2, 4), "C": slice(0, 3), "Z": slice(0, 1)}[d] for d in source)
    assert there.tile(tile) == (slice(1, 3), slice(6, 12))
    assert Layout("YX", "YXC", 3, 1).tile((slice(1, 3), slice(6, 12))) == (slice(1, 3), slice(2, 4), slice(0, 3))


def test_channels_side_by_side_are_all_there_and_last():
    with pytest.raises(ValueError):
        Layout("YXC", "YX", 1, 3).shape((4, 5, 4))
    with pytest.raises(ValueError):
        Layout("YXC", "YX", 1, 3).tile((slice(0, 2), slice(0, 2), slice(1, 3)))
    with pytest.raises(ValueError):
        Layout("YXC", "XY", 1, 3)


def test_stored_layout():
    assert stored_layout("YXC", (4, 5, 3))[0] == "CYX"
    assert stored_layout("YXC", (4, 5, 3), preserve=True)[0] == "YXC"
    axes, change = stored_layout("YXC", (4, 5, 3), folded=3)
    assert axes == "YX" and change.shape((4, 5, 3)) == (4, 15)


def test_columns_agree_with_the_driver(spark):
    rows = [(tuple(1 + (k >> i & 1) for i in range(5)), 1 + 2 * (k % 2)) for k in range(32)]
    got = spark.createDataFrame(rows, "shape array<int>, depth int").select("shape", canonical_axes("shape").alias("axes"), "depth")
    got = got.select("*", axes_held(got["axes"], got["depth"]).alias("held")).collect()
    for r in got:
        assert r.axes == Axes("TCZYX").canonical(tuple(r.shape)).dims
        assert r.held == {d: ["X", "C"] if d == "X" and r.depth > 1 else [d] for d in r.axes}
