"""Text point clouds: lines of blank-separated columns in any layout.

Lines are split, cast and filtered by DataFrame functions; lines that lack a
number where the layout asks for one (headers, comments, cut lines) are
dropped, and further tokens on a line are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour

#: What a column of a layout may be.
TOKENS = {
    "PositionX": ("x", "double"),
    "PositionY": ("y", "double"),
    "PositionZ": ("z", "double"),
    "NormalX": ("nx", "float"),
    "NormalY": ("ny", "float"),
    "NormalZ": ("nz", "float"),
    "ColorR": ("r", "byte"),
    "ColorG": ("g", "byte"),
    "ColorB": ("b", "byte"),
    "ColorA": ("a", "byte"),
    "ColorRf": ("r", "unit"),
    "ColorGf": ("g", "unit"),
    "ColorBf": ("b", "unit"),
    "ColorAf": ("a", "unit"),
    "Intensity": ("intensity", "whole"),
    "CustomByte": ("custom", "byte"),
    "CustomInt32": ("custom", "int"),
    "CustomFloat32": ("custom", "float"),
    "CustomFloat64": ("custom", "double"),
    "Skip": ("", ""),
}
#: Layouts of known extensions.
LAYOUTS = {
    "pts": ("PositionX", "PositionY", "PositionZ", "Skip", "ColorR", "ColorG", "ColorB"),
    "yxh": ("PositionX", "PositionY", "PositionZ", "Intensity", "ColorR", "ColorG", "ColorB"),
    "xyzrgb": ("PositionX", "PositionY", "PositionZ", "ColorR", "ColorG", "ColorB"),
    "xyz": ("PositionX", "PositionY", "PositionZ"),
}


def _value(token: Column, kind: str) -> Column:
    number = token.try_cast("double")
    if kind == "byte":
        n = token.try_cast("int")
        return F.when(n.between(0, 255), n).cast("smallint")
    if kind == "unit":
        return colour.unit_to_byte(number)
    if kind == "whole":
        return F.when(number.between(-2147483648.0, 2147483647.0), number).cast("int")
    return token.try_cast(kind)


def _tokens(column: str) -> Column:
    """The line's tokens as column _parts. A generator makes them, so that a line is
    split once; filters on tokens would bring copies of a plain expression."""
    blank = F.lit(" \t\n\x0b\f\r")
    return F.explode(F.array(F.split(F.btrim(F.col(column), blank), r"\s+"))).alias("_parts")


def parse_lines(lines: DataFrame, layout: Sequence[str], column: str = "value") -> DataFrame:
    """Points of the lines that have every token the layout asks for."""
    out, seen = [], {}
    for i, token in enumerate(layout):
        if token not in TOKENS:
            raise ValueError(f"unknown token {token}")
        name, kind = TOKENS[token]
        if name == "custom":
            seen[name] = seen.get(name, -1) + 1
            name = f"custom{seen[name]}"
        if name:
            out.append(_value(F.get(F.col("_parts"), F.lit(i)), kind).alias(name))
    made = lines.select("*", _tokens(column)).select(*[c for c in lines.columns if c != column], F.size("_parts").alias("_n"), *out)
    names = [c for c in made.columns if c not in lines.columns and c != "_n"]
    whole = F.col("_n") >= len(layout)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    return made.where(whole).drop("_n")


def read(spark: SparkSession, path: str | Sequence[str], layout: str | Sequence[str]) -> DataFrame:
    layout = LAYOUTS[layout] if isinstance(layout, str) else layout
    return parse_lines(spark.read.text(path if isinstance(path, str) else list(path)), layout)


def lines(points: DataFrame, layout: str | Sequence[str]) -> DataFrame:
    """(value): the text of each point; columns that the layout skips are 0."""
    layout = LAYOUTS[layout] if isinstance(layout, str) else layout
    names = [TOKENS[t][0] for t in layout]
    return points.select(F.concat_ws(" ", *(F.col(n).cast("string") if n else F.lit("0") for n in names)).alias("value"))


def write(points: DataFrame, path: str, layout: str | Sequence[str]) -> None:
    lines(points, layout).write.text(path)


#: Columns of the particle files.
PARTICLES = (
    *("x", "y", "z", "vx", "vy", "vz", "mass", "density", "energy", "smoothing", "interactions", "material", "flaws", "active", "damage", "strain"),
    *(f"sigma{i}{j}" for i in range(3) for j in range(3)),
    "alpha",
    "pressure",
)


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    """Smoothed-particle text: 27 numbers a line; the 3 x 3 tensor is one array."""
    return parse_particles(spark.read.text(path))


def parse_particles(lines: DataFrame) -> DataFrame:
    """Particles of the lines (value) that have all numbers."""
    d = lines.select(_tokens("value")).withColumnRenamed("_parts", "p").where(F.size("p") >= len(PARTICLES))
    whole = ("interactions", "material", "flaws", "active")
    cols = {n: F.get("p", F.lit(i)).try_cast("int" if n in whole else "double") for i, n in enumerate(PARTICLES)}
    d = d.select(*(c.alias(n) for n, c in cols.items())).where("x is not null and y is not null and z is not null")
    tensor = [f"sigma{i}{j}" for i in range(3) for j in range(3)]
    return d.withColumn("sigma", F.array(*(F.col(t).cast("float") for t in tensor))).drop(*tensor)
