import zlib

import numpy as np

from rasterloom.operators.slide import Slide
from rasterloom.sources import png, store
from rasterloom.streaming.ingest import watch


def write_png(path, a):
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in a))
    path.write_bytes(png.head(*a.shape, 1, 8) + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b""))


def test_several_files_at_a_time(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "s")
    folder.mkdir()
    for k in range(10):
        write_png(folder / f"f{k}.png", np.full((5, 4 + k), k, np.uint8))
    watch(spark, str(folder), path, str(tmp_path / "c"), "png").awaitTermination(300)
    assert {r.image_id for r in store.images(spark, path).filter("valid").collect()} == {f"f{k}" for k in range(10)}
    assert {k: Slide(spark, path, f"f{k}").dimensions for k in range(10)} == {k: (4 + k, 5) for k in range(10)}


def test_new_files_are_loaded_once(spark, tmp_path):
    folder, path, mark = tmp_path / "in", str(tmp_path / "s"), str(tmp_path / "c")
    folder.mkdir()
    a = np.arange(12 * 9, dtype=np.uint8).reshape(12, 9)
    write_png(folder / "one.png", a)
    watch(spark, str(folder), path, mark, "png").awaitTermination(120)
    write_png(folder / "two.png", a.T.copy())
    watch(spark, str(folder), path, mark, "png").awaitTermination(120)
    assert sorted(r.image_id for r in store.images(spark, path).collect()) == ["one", "two"]
    assert store.tiles(spark, path).count() == 2
    rows = Slide(spark, path, "two").read_level(0).toPandas()
    assert (a.T[rows["y"], rows["x"]] == rows["intensity"]).all() and len(rows) == a.size
