"""Series of OME-TIFF files and the planes that TiffData names."""

import importlib.util
from pathlib import Path

import numpy as np
import pytest

from rasterloom import api
from rasterloom.metadata import ome
from rasterloom.sources import planes, tiff

_spec = importlib.util.spec_from_file_location("files_of_tests", Path(__file__).with_name("test_files.py"))
made = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(made)


def described(*images, more="", head="", uuid=""):
    """OME-XML of images (sizes by axis, DimensionOrder, TiffData elements)."""
    out = ""
    for i, (sizes, order, data) in enumerate(images):
        at = "".join(f' Size{d}="{sizes.get(d, 1)}"' for d in "XYZCT")
        out += f'<Image ID="Image:{i}" Name="picture {i}"><Pixels ID="Pixels:{i}" Type="uint8" DimensionOrder="{order}"{at}>{data}</Pixels></Image>'
    return f'{head}<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"{uuid}>{out}{more}</OME>'


def whole(t, level=0):
    out = np.zeros(t.describe()["levels"][level]["shape"], t.dtype(level))
    for i in range(t.segments(level)):
        start, block = t.segment(level, i)
        assert t.bounds(level, i) == (start, block.shape)
        out[tuple(slice(s, s + n) for s, n in zip(start, block.shape, strict=True))] = block
    return out


def paged(path, pages, text):
    made.paged_tiff(path, [(a, text if i == 0 else "", True) for i, a in enumerate(pages)])
    return str(path)


SIZE = {"X": 33, "Y": 20}


@pytest.mark.parametrize("head", ["", "\n  ", '<?xml version="1.0" encoding="UTF-8"?>\n<!-- note -->'])
def test_images_of_equal_size_are_series_of_their_own(spark, tmp_path, head):
    a = made.image((3, 20, 33))
    tags = [f'<TiffData IFD="{k}"/>' for k in (1, 0)]
    uri = paged(tmp_path / "a.ome.tif", a, described((SIZE, "XYCZT", tags[0]), (SIZE, "XYCZT", tags[1]), head=head))
    first, second = tiff.TiffFile(uri), tiff.TiffFile(uri, series=1)
    assert first.describe()["axes"] == "YX" and len(first.levels) == 1
    np.testing.assert_array_equal(whole(first), a[1])
    np.testing.assert_array_equal(whole(second), a[0])
    with pytest.raises(ValueError, match="no series 2"):
        tiff.TiffFile(uri, series=2)
    slide = api.ingest(spark, uri, str(tmp_path / "s"), "i", "tiff", series=1)
    np.testing.assert_array_equal(made.pixels(slide.read_level(0), "YX", (20, 33)), a[0])


def test_images_without_tiffdata_follow_each_other(tmp_path):
    a = made.image((5, 20, 33))
    uri = paged(tmp_path / "a.ome.tif", a, described((SIZE | {"Z": 2}, "XYCZT", ""), (SIZE | {"C": 3}, "XYCZT", "")))
    one, two = tiff.TiffFile(uri), tiff.TiffFile(uri, series=1)
    assert (one.describe()["axes"], two.describe()["axes"]) == ("ZYX", "CYX")
    np.testing.assert_array_equal(whole(one), a[:2])
    np.testing.assert_array_equal(whole(two), a[2:])


@pytest.mark.parametrize("order", ["XYCZT", "XYZCT", "XYTCZ", "XYTZC", "XYCTZ", "XYZTC"])
def test_permuted_planes(tmp_path, order):
    sizes = {"C": 2, "Z": 3, "T": 2}
    a = made.image((2, 3, 2, 20, 33))  # CZT
    places = [(c, z, t) for c in range(2) for z in range(3) for t in range(2)]
    shuffled = np.random.default_rng(3).permutation(12)
    pages = [None] * 12
    data = ""
    for k, (c, z, t) in zip(shuffled, places, strict=True):
        pages[k] = a[c, z, t]
        data += f'<TiffData IFD="{k}" FirstC="{c}" FirstZ="{z}" FirstT="{t}"/>'
    got = tiff.TiffFile(paged(tmp_path / "a.ome.tif", pages, described((SIZE | sizes, order, data))))
    axes = got.describe()["axes"]
    assert axes == "".join(reversed(order))[:3] + "YX"
    np.testing.assert_array_equal(whole(got), a.transpose(["CZT".index(d) for d in axes[:3]] + [3, 4]))


def test_intervals_run_in_the_order_of_dimensions(tmp_path):
    a = made.image((6, 20, 33))
    data = '<TiffData IFD="4" PlaneCount="2"/><TiffData IFD="0" FirstC="0" FirstZ="1" PlaneCount="4"/>'
    got = tiff.TiffFile(paged(tmp_path / "a.ome.tif", a, described((SIZE | {"C": 2, "Z": 3}, "XYCZT", data))))
    np.testing.assert_array_equal(whole(got).reshape(6, 20, 33), a[[4, 5, 0, 1, 2, 3]])
    everything = tiff.TiffFile(paged(tmp_path / "b.ome.tif", a, described((SIZE | {"C": 2, "Z": 3}, "XYCZT", "<TiffData/>"))))
    np.testing.assert_array_equal(whole(everything).reshape(6, 20, 33), a)


def test_sets_of_several_files(spark, tmp_path):
    a = made.image((2, 3, 20, 33))
    names = ["one.ome.tif", "two.ome.tif"]
    data = "".join(f'<TiffData FirstT="{t}" FirstZ="{z}" IFD="{2 - z}"><UUID FileName="{names[t]}">urn:uuid:{t}</UUID></TiffData>' for t in range(2) for z in range(3))
    text = described((SIZE | {"T": 2, "Z": 3}, "XYZCT", data))
    for name, part in zip(names, a, strict=True):
        paged(tmp_path / name, part[::-1], text)
    for name in names:
        np.testing.assert_array_equal(whole(tiff.TiffFile(str(tmp_path / name))), a)
    slide = api.ingest(spark, str(tmp_path / names[1]), str(tmp_path / "s"), "i", "tiff")
    np.testing.assert_array_equal(made.pixels(slide.read_level(0, original_axes=True), "TZYX", a.shape), a)
    (tmp_path / "two.ome.tif").unlink()
    with pytest.warns(UserWarning, match="3 of 6 planes"):
        got = whole(tiff.TiffFile(str(tmp_path / "one.ome.tif")))
    np.testing.assert_array_equal(got[0], a[0])
    assert not got[1].any()


def test_a_renamed_file_is_known_by_its_mark(tmp_path):
    a = made.image((2, 20, 33))
    data = "".join(f'<TiffData FirstZ="{z}" IFD="{z}"><UUID FileName="old.tif">urn:uuid:me</UUID></TiffData>' for z in range(2))
    uri = paged(tmp_path / "new.tif", a, described((SIZE | {"Z": 2}, "XYZCT", data), uuid=' UUID="urn:uuid:me"'))
    np.testing.assert_array_equal(whole(tiff.TiffFile(uri)), a)


@pytest.mark.parametrize("kind", ["companion", "tiff"])
def test_metadata_in_another_file(tmp_path, kind):
    a = made.image((2, 20, 33))
    data = "".join(f'<TiffData FirstC="{c}" IFD="{1 - c}"><UUID FileName="a.tif">urn:uuid:a</UUID></TiffData>' for c in range(2))
    text, name = described((SIZE | {"C": 2}, "XYCZT", data)), "all.ome"
    if kind == "companion":
        (tmp_path / name).write_text(text)
    else:
        paged(tmp_path / name, a[:1], text)
    uri = paged(tmp_path / "a.tif", a, described(more=f'<BinaryOnly MetadataFile="{name}" UUID="urn:uuid:m"/>'))
    t = tiff.TiffFile(uri)
    np.testing.assert_array_equal(whole(t), a[::-1])
    assert t.describe()["axes"] == "CYX"


def test_what_does_not_fit_is_an_error(tmp_path):
    a = made.image((4, 20, 33))
    for k, (images, told) in enumerate([
        ([(SIZE | {"Z": 3}, "XYCZT", "")], "3 planes"), ([(SIZE | {"Z": 5}, "XYCZT", "")], "5 planes"), ([(SIZE, "XYCZ", "")], "no order"),
        ([(SIZE | {"Z": 2}, "XYCZT", '<TiffData IFD="3" PlaneCount="2"/>')], "pages 3 to 4 of 4"), ([(SIZE | {"Z": 2}, "XYCZT", '<TiffData FirstZ="2"/>')], "outside"),
        ([(SIZE | {"Z": 2}, "XYCZT", "")] * 3, "6 planes"), ([(SIZE, "XYCZT", '<TiffData IFD="9"/>')], "no page"),
    ]):
        uri = paged(tmp_path / f"{k}.tif", a, described(*images))
        with pytest.raises(ValueError, match=told):
            tiff.TiffFile(uri, series=len(images) - 1)
    mixed = paged(tmp_path / "m.tif", [a[0], a[1, :10]], described((SIZE | {"Z": 2}, "XYCZT", '<TiffData IFD="0" PlaneCount="2"/>')))
    with pytest.raises(ValueError, match="differ in form"):
        tiff.TiffFile(mixed)


def test_planes_that_no_interval_covers_are_zero(tmp_path):
    a = made.image((4, 20, 33))
    uri = paged(tmp_path / "a.tif", a, described((SIZE | {"Z": 4}, "XYCZT", '<TiffData IFD="3" FirstZ="2"/>')))
    with pytest.warns(UserWarning, match="3 of 4 planes"):
        got = whole(tiff.TiffFile(uri))
    np.testing.assert_array_equal(got[2], a[3])
    assert not got[[0, 1, 3]].any()


def test_samples_of_a_page_are_channels_of_one_plane(tmp_path):
    a = made.image((2, 20, 33, 3))
    uri = paged(tmp_path / "a.tif", a, described((SIZE | {"C": 3, "Z": 2}, "XYCZT", '<TiffData IFD="1"/><TiffData IFD="0" FirstZ="1"/>')))
    t = tiff.TiffFile(uri)
    assert t.describe()["axes"] == "ZYXC"
    np.testing.assert_array_equal(whole(t), a[::-1])


def test_exports_name_their_planes(spark, tmp_path):
    a = made.image((2, 3, 20, 33))
    made.write_zarr(str(tmp_path / "a"), a, "TZYX", (1, 3, 20, 33))
    api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr")
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b.tif"), "tiff")
    t = tiff.TiffFile(str(tmp_path / "b.tif"))
    (pixels,) = planes.images(t.text)
    assert planes.intervals(pixels, 1, "b.tif", None) == [planes.Interval(0, 0, 6, None)]
    np.testing.assert_array_equal(whole(t), a)


def test_what_ome_xml_is():
    assert all(ome.is_ome(t) for t in ("<OME>", '\n<?xml version="1.0"?><OME/>', '<?xml version="1.0"?>\n<!-- a\nb --> <ome:OME xmlns:ome="u">', "  <OME\nx='1'>"))
    assert not any(ome.is_ome(t) for t in ("", "OME", "<OMEX>", "text <OME>", '<?xml version="1.0"?><other><OME/></other>'))
    assert "macro" not in ome.prune('\n\t<OME><Image Name="macro"/><Image Name="x"/></OME>')
