"""Colour conversions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_to_byte(c: Column) -> Column:
    """0..1 to 0..255, cut off; null outside."""
    return F.when((c >= 0) & (c <= 1), F.floor(c * 255)).cast("smallint")


def byte_to_unit(c: Column) -> Column:
    return c / 255.0


def word_to_byte(c: Column, most: Column | int) -> Column:
    """16-bit channels: as they are where none exceeds 255, else the high byte."""
    return F.when(F.lit(most) > 255 if isinstance(most, int) else most > 255, F.floor(c / 256)).otherwise(c).cast("smallint")


def yxy_to_xyz(big_y: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    d = F.nullif(y, F.lit(0.0))
    return x * big_y / d, big_y, (1 - x - y) * big_y / d


def xyz_to_srgb(x: Column, y: Column, z: Column) -> list[Column]:
    """Linear sRGB (D65) with the standard's transfer curve, clamped to 0..1."""
    #: Fixed values of the sRGB standard.
    rows = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    out = []
    for a, b, c in rows:
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * x + b * y + c * z))
        out.append(F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))
    return out


def rescale_to_byte(v: Column, low: float, high: float) -> Column:
    """0..255 over a range; one value alone becomes 255."""
    return F.lit(255).cast("int") if high <= low else F.floor((v - low) * (255.999 / (high - low))).cast("int")
