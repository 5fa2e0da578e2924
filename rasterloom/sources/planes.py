"""Which page of which file holds each plane of an image of OME-XML.

A plane is a YX picture; the planes of an image are numbered in its DimensionOrder, the first named axis counting
fastest. Each TiffData element is an interval: planes from FirstC, FirstZ, FirstT on lie in the pages from IFD on, in the
file that its UUID names. Without any, the planes of all images follow each other in the pages of the one file.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from typing import NamedTuple

import numpy as np

from rasterloom.metadata.ome import children


class Interval(NamedTuple):
    """count planes from plane on, in the pages from page on of a file (None: the one that holds the text); count None: all pages of it."""

    plane: int
    page: int
    count: int | None
    file: str | None


def images(text: str) -> list[ET.Element]:
    """The Pixels of each image that a text describes."""
    return [children(i, "Pixels")[0] for i in children(ET.fromstring(text.strip()), "Image") if children(i, "Pixels")]


def plane_axes(pixels: ET.Element, samples: int) -> tuple[str, tuple[int, ...]]:
    """Axes over planes, slowest first, and their sizes; samples of a page count as channels of one plane."""
    order = pixels.get("DimensionOrder", "XYCZT")
    if sorted(order) != sorted("XYCZT"):
        raise ValueError(f"{order} is no order of dimensions")
    sizes = {d: int(pixels.get(f"Size{d}", 1)) for d in "CZT"}
    if sizes["C"] % samples:
        raise ValueError(f"{sizes['C']} channels in pages of {samples} samples")
    sizes["C"] //= samples
    lead = "".join(d for d in reversed(order) if d not in "XY")
    return lead, tuple(sizes[d] for d in lead)


def intervals(pixels: ET.Element, samples: int, own: str, uuid: str | None) -> list[Interval]:
    """The TiffData of an image; own and uuid: name and mark of the file that holds the text."""
    lead, sizes = plane_axes(pixels, samples)
    out = []
    for data in children(pixels, "TiffData"):
        first = {d: int(data.get(f"First{d}", 0)) for d in lead}
        first["C"] //= samples
        if any(first[d] >= n for d, n in zip(lead, sizes, strict=True)):
            raise ValueError(f"TiffData begins outside its image, at {first}")
        count = data.get("PlaneCount", "1" if data.get("IFD") is not None else None)
        named = children(data, "UUID")
        file = named[0].get("FileName") if named else None
        if file == own or (named and uuid and (named[0].text or "").strip() == uuid):
            file = None
        out.append(Interval(int(np.ravel_multi_index([first[d] for d in lead], sizes)), int(data.get("IFD", 0)), None if count is None else int(count), file))
    return out


def located(found: list[Interval], planes: int, pages: dict[str | None, int]) -> list[tuple[str | None, int] | None]:
    """File and page of each plane, None for planes that no interval covers; pages: the number of pages of each file, 0 if it is lost."""
    out: list[tuple[str | None, int] | None] = [None] * planes
    for at in found:
        there = pages[at.file]
        count = min(there - at.page, planes - at.plane) if at.count is None else at.count
        if at.plane + count > planes or (there and at.page + count > there):
            raise ValueError(f"TiffData names planes {at.plane} to {at.plane + count - 1} of {planes}, in pages {at.page} to {at.page + count - 1} of {there}")
        if there:
            out[at.plane : at.plane + count] = [(at.file, at.page + k) for k in range(count)]
    return out


def following(described: list[ET.Element], series: int, samples: int, pages: int) -> list[tuple[str | None, int] | None]:
    """The planes of an image without TiffData: the pages after those of the images before it."""
    many = [int(np.prod(plane_axes(p, samples if i == series else 1)[1])) for i, p in enumerate(described)]
    first = sum(many[:series])
    if first + many[series] > pages or (len(described) == 1 and many[series] != pages):
        raise ValueError(f"the OME-XML describes {sum(many)} planes, but there are {pages} pages")
    return [(None, first + k) for k in range(many[series])]
