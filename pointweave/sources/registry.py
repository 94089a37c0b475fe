"""Formats by file extension, and stores of point clouds as Parquet folders."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ascii, binary

Reader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Format:
    description: str
    extensions: tuple[str, ...]
    read: Reader
    info: Reader | None = None


_known: dict[str, Format] = {}


def register(form: Format) -> None:
    """An extension has one format, and a description is used once."""
    if any(f.description == form.description for f in _known.values()) or any(e in _known for e in form.extensions):
        raise ValueError(f"{form.description} or one of {form.extensions} is registered already")
    _known.update(dict.fromkeys(form.extensions, form))


def format_of(path: str) -> Format | None:
    """By extension, case aside; None if unknown."""
    name = path.rstrip("/").rpartition("/")[2]
    return _known.get(name.rpartition(".")[2].lower()) if "." in name else None


def text_format(description: str, extensions: tuple[str, ...], layout: tuple[str, ...]) -> Format:
    """A named text format with its own layout."""
    return Format(description, extensions, lambda spark, path: ascii.read(spark, path, layout))


for _name in ("pts", "yxh", "xyz"):
    register(text_format(_name, (_name,), ascii.LAYOUTS[_name]))
register(Format("ply", ("ply",), binary.read_ply, lambda s, p: binary.header_info(s, p, "ply")))
register(Format("las", ("las",), binary.read_las, lambda s, p: binary.header_info(s, p, "las")))
register(Format("e57", ("e57",), binary.read_e57, lambda s, p: binary.header_info(s, p, "e57")))


def read(spark: SparkSession, path: str) -> DataFrame:
    form = format_of(path)
    if form is None:
        raise ValueError(f"no format is registered for {path}")
    return form.read(spark, path)


def info(spark: SparkSession, path: str) -> DataFrame:
    """(path, points, lo, hi); from headers where the format has them."""
    form = format_of(path)
    if form is None:
        raise ValueError(f"no format is registered for {path}")
    if form.info:
        return form.info(spark, path)
    lo, hi = (F.array(*(f(c) for c in "xyz")).alias(n) for n, f in (("lo", F.min), ("hi", F.max)))
    return form.read(spark, path).groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("points"), lo, hi)


class Store:
    """A folder with points/, nodes/, node_points/ and meta/ for each cloud."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, key: str, table: str) -> str:
        return f"{self.path}/{key}/{table}"

    def put(self, key: str, tables: dict[str, DataFrame], meta: dict) -> None:
        """Tables are written as they are partitioned; the metadata comes last,
        so a cloud that can be loaded is whole."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.at(key, name))
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(self.at(key, "meta"))

    def meta(self, key: str) -> dict:
        return json.loads(self.spark.read.text(self.at(key, "meta")).first()[0])

    def table(self, key: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(key, name))

    def copy_to(self, key: str, other: Store) -> None:
        """Export: all tables and metadata of a cloud."""
        other.put(key, {t: self.table(key, t) for t in ("points", "nodes", "node_points")}, self.meta(key))
