"""Channel colours as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ((255, 0, 0), (0, 255, 0), (0, 0, 255))


def rgba_unpack(value: Column) -> Column:
    """Red, green, blue, alpha of a 32-bit number, signed or not, from the highest byte down."""
    v = value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.struct(*[F.shiftrightunsigned(v, s).bitwiseAND(F.lit(255)).cast("int").alias(n) for n, s in (("red", 24), ("green", 16), ("blue", 8), ("alpha", 0))])


def rgba_pack(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """The signed 32-bit number of a colour; computed as long, since a plain cast overflows."""
    v = red.cast("long") * (1 << 24) + green.cast("long") * (1 << 16) + blue.cast("long") * 256 + alpha.cast("long")
    return v.bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)


def hex_color(text: Column) -> Column:
    """RRGGBB with full opacity as an unsigned number."""
    return F.conv(F.concat(text, F.lit("FF")), 16, 10).cast("long")


def default_color(index: Column, count: Column) -> Column:
    """White for one channel, red, green and blue for three; else a colour that follows from the index alone."""

    def pick(k: int) -> Column:
        one, three = F.lit(255), F.element_at(F.array(*[F.lit(c[k]) for c in RGB]), (index + 1).cast("int"))
        mixed = F.pmod((index + 1) * F.lit((73, 151, 199)[k]), F.lit(256)).cast("int")
        return F.when(count == 1, one).when(count == 3, three).otherwise(mixed)

    return F.struct(pick(0).alias("red"), pick(1).alias("green"), pick(2).alias("blue"), F.lit(255).alias("alpha"))


def pixel_depth(layout: Column) -> Column:
    """Channels that a colour layout folds into X: NONE 1, RGB and BGR 3, RGBA and BGRA 4."""
    return (
        F.when(layout.isNull() | (layout == "NONE"), 1).when(layout.isin("RGB", "BGR"), 3).when(layout.isin("RGBA", "BGRA"), 4)
        .otherwise(F.raise_error(F.concat(F.lit("unknown colour layout "), layout)).cast("int"))
    )
