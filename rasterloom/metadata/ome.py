"""Metadata of microscopy formats, as one common form.

image: {"channels": [{id, name, color{red,green,blue,alpha}, min?, max?, emissionWavelength?, ...Unit?}],
        "physicalSizeX": number, "physicalSizeXUnit": text, ..., "timeIncrement": number, ...}
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names and words that mark images and comments to prune.
PRUNED_IMAGES = ("macro", "label")
PRUNED_COMMENTS = ("barcode", "label")
PIXELS = {"PhysicalSizeX": "µm", "PhysicalSizeY": "µm", "PhysicalSizeZ": "µm", "TimeIncrement": "s"}


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def children(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node if local(x.tag) == name]


def is_ome(text: str) -> bool:
    """Whether a text is OME-XML: its first element is OME, with any prefix."""
    return bool(re.match(r"\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<(\w+:)?OME[\s>/]", text, re.DOTALL))


def uuid_of(text: str) -> str | None:
    """The mark of the file that holds an OME-XML."""
    return ET.fromstring(text.strip()).get("UUID")


def metadata_file(text: str) -> str | None:
    """The file that holds the metadata instead, if there is one."""
    other = children(ET.fromstring(text.strip()), "BinaryOnly")
    return other[0].get("MetadataFile") if other else None


def prune(text: str | None) -> str | None:
    """OME-XML without label and macro images and without comments on labels and barcodes; None for other text.

    White space may stand before it, but no XML declaration.
    """
    if text is None or not text.lstrip().startswith("<OME"):
        return None
    root = ET.fromstring(text.lstrip())
    space = root.tag[1:].split("}")[0] if root.tag.startswith("{") else ""
    for image in children(root, "Image"):
        if image.get("Name") in PRUNED_IMAGES:
            root.remove(image)
    for notes in children(root, "StructuredAnnotations"):
        for note in children(notes, "CommentAnnotation"):
            told = " ".join(d.text or "" for d in children(note, "Description"))
            if any(w in told for w in PRUNED_COMMENTS):
                notes.remove(note)
        if not children(notes, "CommentAnnotation"):
            root.remove(notes)
    if space:
        ET.register_namespace("", space)
    return ET.tostring(root, encoding="unicode")


@F.pandas_udf(T.StringType())
def prune_column(texts: pd.Series) -> pd.Series:
    return texts.map(prune, na_action="ignore")


def rgba(value: int) -> dict[str, int]:
    value &= 0xFFFFFFFF
    return {n: (value >> s) & 255 for n, s in (("red", 24), ("green", 16), ("blue", 8), ("alpha", 0))}


def default_colors(n: int) -> list[dict[str, int]]:
    from rasterloom.functions.colors import RGB

    plain = [(255, 255, 255)] if n == 1 else RGB if n == 3 else [tuple((k + 1) * p % 256 for p in (73, 151, 199)) for k in range(n)]
    return [dict(zip(("red", "green", "blue", "alpha"), (*c, 255), strict=True)) for c in plain]


def from_ome_xml(text: str, image: int = 0) -> dict:
    """The common form of one image of OME-XML; a channel of several samples counts as so many channels."""
    root = ET.fromstring(text.strip())
    found = children(root, "Image")
    if image >= len(found):
        return {"channels": []}
    pixels = children(found[image], "Pixels")[0]
    out: dict = {}
    for name, unit in PIXELS.items():
        if (size := pixels.get(name)) is not None:
            key = name[0].lower() + name[1:]
            out |= {key: float(size), f"{key}Unit": pixels.get(f"{name}Unit", unit)}
    channels: list[dict] = []
    for c in children(pixels, "Channel"):
        for _ in range(int(c.get("SamplesPerPixel", 1))):
            one: dict = {"id": str(len(channels)), "name": c.get("Name") or f"Channel {len(channels)}"}
            if c.get("Color") is not None:
                one["color"] = rgba(int(c.get("Color")))
            if c.get("EmissionWavelength") is not None:
                one |= {"emissionWavelength": float(c.get("EmissionWavelength")), "emissionWavelengthUnit": c.get("EmissionWavelengthUnit", "nm")}
            channels.append(one)
    for one, color in zip(channels, default_colors(len(channels)), strict=True):
        one.setdefault("color", color)
    return out | {"channels": channels}


def annotation(text: str, key: str) -> str | None:
    """The value of the first original-metadata annotation with this key."""
    for node in ET.fromstring(text.strip()).iter():
        if local(node.tag) == "OriginalMetadata":
            at = {local(x.tag): x.text for x in node}
            if at.get("Key") == key:
                return at.get("Value")
    return None


def aperio(description: str) -> dict[str, str]:
    """Settings of a scanner's description, `k = v` after bars in its second line; entries without `=` are left out."""
    lines = description.splitlines()
    parts = (p.partition("=") for p in (lines[1] if len(lines) > 1 else "").split("|"))
    return {k.strip(): v.strip() for k, eq, v in parts if eq}


def aperio_column(description: Column) -> Column:
    """The same for a column of descriptions, as a map; of settings of one name the last counts."""
    entries = F.filter(F.split(F.coalesce(F.get(F.split(description, "\r?\n"), F.lit(1)), F.lit("")), r"\|"), lambda e: e.contains("="))
    pairs = F.transform(entries, lambda e: F.struct(F.trim(F.substring_index(e, "=", 1)).alias("k"), F.trim(F.substr(e, F.instr(e, F.lit("=")) + 1)).alias("v")))
    names = F.transform(pairs, lambda p: p.k)
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p.k)))


def from_aperio(description: str) -> dict:
    mpp = aperio(description).get("MPP")
    sizes = {f"physicalSize{d}{u}": (float(mpp) if not u else "µm") for d in "XY" for u in ("", "Unit")} if mpp else {}
    return sizes | {"channels": [{"id": str(i), "name": n, "color": c} for i, (n, c) in enumerate(zip(("red", "green", "blue"), default_colors(3), strict=True))]}


def from_page_xml(pages: list[tuple[str, tuple[float, float] | None, bool]]) -> dict:
    """Pages of a multispectral scan (XML with Name and Color, resolution in cells per cm, is RGB): one channel each."""
    channels: list[dict] = []
    out: dict = {}
    for text, resolution, is_rgb in pages:
        at = {local(x.tag): (x.text or "") for x in ET.fromstring(text).iter()}
        if is_rgb:
            channels = [{"id": str(i), "name": n, "color": c} for i, (n, c) in enumerate(zip(("red", "green", "blue"), default_colors(3), strict=True))]
        else:
            color = [int(x) for x in at["Color"].split(",")] if at.get("Color") else [255, 255, 255]
            channels.append({"id": str(len(channels)), "name": at.get("Name") or f"Channel {len(channels)}", "color": dict(zip(("red", "green", "blue", "alpha"), (*color[:3], 255), strict=True))})
        if resolution:
            out |= {"physicalSizeX": 1 / resolution[0], "physicalSizeXUnit": "cm", "physicalSizeY": 1 / resolution[1], "physicalSizeYUnit": "cm"}
        if is_rgb:
            break
    return out | {"channels": channels}


def from_omero(attributes: dict) -> dict:
    """The common form of the `omero` record of a Zarr image."""
    channels = []
    for i, c in enumerate(attributes.get("omero", {}).get("channels", [])):
        one = {"id": str(i), "name": c.get("label", f"Channel {i}"), "color": rgba(int(c.get("color", "FFFFFF") + "FF", 16))}
        span = c.get("window", {})
        one |= {k: span[w] for k, w in (("min", "start"), ("max", "end")) if w in span}
        channels.append(one)
    return {"channels": channels}


def to_omero(image: dict) -> dict:
    def one(c: dict) -> dict:
        rgb = c["color"]
        out = {"label": c["name"], "color": f"{rgb['red']:02X}{rgb['green']:02X}{rgb['blue']:02X}", "active": True}
        return out | ({"window": {"start": c["min"], "end": c["max"]}} if "min" in c else {})

    return {"channels": [one(c) for c in image.get("channels", [])]}


def is_rgb_hex(colors: Column) -> Column:
    return colors == F.array(F.lit("FF0000"), F.lit("00FF00"), F.lit("0000FF"))


def plain_decimal(value: float) -> str:
    """A number without an exponent, as schemas of image metadata want it."""
    from decimal import Context

    return format(Context(prec=32).create_decimal(repr(value)), "f")


def to_ome_xml(image: dict, shape: dict[str, int], dtype: str, planes: int | None = None) -> str:
    """OME-XML of the common form; colours become signed numbers; planes: their number, if they lie in the pages from the first on."""
    kinds = {"float32": "float", "float64": "double"}
    attrs = {"ID": "Pixels:0", "DimensionOrder": "XYCZT", "Type": kinds.get(dtype, dtype)} | {f"Size{d}": str(shape.get(d, 1)) for d in "XYCZT"}
    for name in PIXELS:
        key = name[0].lower() + name[1:]
        if key in image:
            attrs |= {name: plain_decimal(image[key]), f"{name}Unit": image.get(f"{key}Unit", PIXELS[name])}
    root = ET.Element("OME", xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06")
    pixels = ET.SubElement(ET.SubElement(root, "Image", ID="Image:0"), "Pixels", attrs)
    for i, c in enumerate(image.get("channels", [])):
        color = c.get("color", {})
        value = sum(color.get(n, 255) << s for n, s in (("red", 24), ("green", 16), ("blue", 8), ("alpha", 0)))
        ET.SubElement(pixels, "Channel", ID=f"Channel:0:{i}", Name=c["name"], Color=str((value ^ 1 << 31) - (1 << 31)), SamplesPerPixel="1")
    if planes is not None:
        ET.SubElement(pixels, "TiffData", IFD="0", PlaneCount=str(planes))
    return re.sub(r">\s+<", "><", ET.tostring(root, encoding="unicode"))
