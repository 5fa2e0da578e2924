"""Several attributes of a cell."""

import numpy as np
import pytest

from rasterloom import api
from rasterloom.operators.slide import Slide


def cells(spark, a, b):
    rows = [(int(c), int(y), int(x), int(a[c, y, x]), float(b[c, y, x]), "other") for c, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "c int, y int, x int, intensity int, weight double, note string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60000, (2, 37, 29)).astype("uint16"), rng.random((2, 37, 29)).astype("float32")
    path = str(tmp_path_factory.mktemp("attributes"))
    slide = api.store_cells(spark, cells(spark, a, b), path, "i", "CYX", a.shape, {"intensity": "uint16", "weight": "float32"}, {"Y": 16, "X": 16})
    return a, b, path, slide


def test_each_attribute_is_read_by_itself(spark, stored):
    a, b, path, slide = stored
    assert slide.attributes(0) == {"intensity": "uint16", "weight": "float32"}
    for name, whole in (("intensity", a), ("weight", b)):
        got = slide.read_level(0, attribute=name).toPandas()
        assert len(got) == whole.size
        np.testing.assert_array_equal(whole[got["c"], got["y"], got["x"]], got[name].to_numpy(whole.dtype))
        part = Slide(spark, path, "i").read_region((5, 10), 0, (7, 20), name)
        assert part.columns == ["y", "x", "c", name] and part.count() == 7 * 20 * 2
        spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
        plan = part._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        read = plan.split("ReadSchema: ")[1].split("\n")[0]
        assert ("data_weight" in read) == (name == "weight") and ("data:binary" in read) == (name == "intensity")
        assert "PushedFilters: [IsNotNull(ty)" in plan


def test_what_is_no_attribute_is_told(spark, stored, tmp_path):
    a, b, path, slide = stored
    with pytest.raises(KeyError, match="no attribute 'mask'"):
        slide.read_level(0, attribute="mask")
    df = cells(spark, a, b)
    with pytest.raises(ValueError, match="intensity"):
        api.store_cells(spark, df, str(tmp_path), "i", "CYX", a.shape, {"weight": "float32"})
    with pytest.raises(ValueError, match="no names"):
        api.store_cells(spark, df.withColumnRenamed("weight", "a-b"), str(tmp_path), "i", "CYX", a.shape, {"intensity": "uint16", "a-b": "float32"})
    for wrong in (df.filter("y <> 3 or x <> 4"), df.union(df.limit(1))):
        with pytest.raises(Exception, match="lacks cells, or has some twice"):
            api.store_cells(spark, wrong, str(tmp_path), "i", "CYX", a.shape, {"intensity": "uint16", "weight": "float32"})
    with pytest.raises(KeyError):
        Slide(spark, str(tmp_path), "i")


def test_a_pyramid_is_of_intensities(spark, stored):
    a, _, path, _ = stored
    api.build_pyramid(spark, path, "i", 0, [2.0])
    again = Slide(spark, path, "i")
    assert again.attributes(1) == {"intensity": "uint16"} and again.read_level(1).count() == 2 * 18 * 14
    assert again.read_level(0, attribute="weight").count() == a.size
