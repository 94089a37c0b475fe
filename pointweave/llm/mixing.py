"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should have: a whole part, and a fractional part that is rounded.
Rounding takes two fractional documents, moves words' worth of probability
from one to the other at random until one of them is 0 or 1, and goes on with
the other. Expectations hold for each document, and the expected words of the
whole source stay exactly what they were. Buckets of a source (by a hash of
the id and text) are rounded apart and leave at most one fractional document each;
those residuals meet in a reduction tree of fan-in ``FAN``. Rows of one id, source
and text are counted first and rounded as one. Random numbers come from ids and
texts alone, so reruns and other partitionings agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import checkpointed, fresh, splitmix64, uniform

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0
#: Documents of a source that one task step rounds, and residuals that meet in one.
BUCKET, FAN = 2048, 256
SEED = 8
EPS = 1e-12


def words(text):
    """Number of runs of anything but space and 09-0D; 0 for null."""
    flat = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, docs, target) by water-filling, one row a source.

    Sources by code point, null last, take the weights in turn; targets share
    the total size by weight, none above ``most`` times its source's size.
    With r = most * size / weight ascending, a prefix of sources is full and
    the rest share what is left: the level is one running sum, no loop.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("i", F.row_number().over(in_turn) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("i", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("full", F.lit(most) * F.col("source_size"))
    s = s.withColumn("r", F.col("full") / F.col("w"))
    by_level = Window.orderBy("r", "i")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("r").desc(), F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "i", "level"))).over(every)
    s = s.withColumn("first", first)
    full = F.col("first").isNull() | (F.struct("r", "i") < F.struct("first.r", "first.i"))
    s = s.withColumn("target", F.when(full, F.col("full")).otherwise(F.least(F.col("full"), F.col("w") * F.col("first.level"))))
    return s.select("source", F.col("i").cast("long").alias("source_no"), "source_size", "docs", "target")


def pivot(p: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded ``p`` and the place of what is left fractional, or -1."""
    p, u = p.copy(), uniform(key)
    size = np.where(size > 0, size, 1e-9)
    at = -1
    for j in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        if at < 0:
            at = j
            continue
        a, b, x, y = size[at], size[j], p[at], p[j]
        up, down = min(1 - x, y * b / a), min(x, (1 - y) * b / a)
        move = up if u[j] * (up + down) < down else -down
        x, y = x + move, y - move * a / b
        x = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        y = 0.0 if y < EPS else 1.0 if y > 1 - EPS else y
        p[at], p[j] = x, y
        at = at if 0 < x < 1 else j if 0 < y < 1 else -1
    return p, at


def _rounder(level: int):
    salt = np.uint64(SEED * 1_000_003 + level)

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "doc_id", "text_key", "size"], na_position="first", kind="stable").reset_index(drop=True)
        ids = pdf["doc_id"].fillna(-1).to_numpy().astype(np.int64).view(np.uint64)
        text = pdf["text_key"].to_numpy().astype(np.int64).view(np.uint64)
        key = splitmix64(ids ^ splitmix64(text + salt))
        p, left = pivot(pdf["p"].to_numpy(np.float64), pdf["size"].to_numpy(np.float64), key)
        if left >= 0 and pdf["last"].iloc[0]:
            p[left] = float(uniform(key[left : left + 1])[0] < p[left])
        pdf["p"] = p
        pdf["bucket"] = pdf["bucket"] // FAN
        return pdf

    return rounded


def text_key(docs: DataFrame):
    """What tells texts of one id apart; null is not empty."""
    text = F.col("text").cast("string")
    return F.xxhash64(text, text.isNull())


def grouped_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(doc_id, source, text_key, size, rows, source_size, target, copies), one row for
    each id, source and text of ``docs``: its rows, and the copies they take together."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_key(docs).alias("text_key"), words(F.col("text")).alias("size"))
    sized = checkpointed(sized)
    per = checkpointed(source_targets(sized, weights, most))
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    d = sized.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("rows"))
    d = d.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("f", f * F.col("rows")).withColumn("whole", F.floor(F.col("f") + EPS))
    d = d.withColumn("p", F.greatest(F.lit(0.0), F.col("f") - F.col("whole")))
    d = d.withColumn("buckets", F.ceil(F.col("docs") / BUCKET))
    d = d.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_key"), F.col("buckets")))
    d = d.select("source_no", "bucket", "buckets", "doc_id", "source", "text_key", "size", "rows", "source_size", "target", "whole", "p")
    most_buckets = per.agg(F.ceil(F.max("docs") / BUCKET)).first()[0] or 1
    done, level = [], 0
    while True:
        last = most_buckets <= 1
        schema = d.drop("last").schema.add("last", "boolean")
        d = d.drop("last").withColumn("last", F.lit(last))
        d = checkpointed(d.groupBy("source_no", "bucket").applyInPandas(_rounder(level), schema))
        fractional = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(d.where(~fractional))
        if last:
            break
        d = d.where(fractional)
        most_buckets, level = -(-most_buckets // FAN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "text_key", "size", "rows", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def _share(copies, rows, nth):
    """Copies of the ``nth`` (from 1) of equal rows: as equal as can be."""
    return F.floor(copies / rows) + (nth <= F.pmod(copies, rows)).cast("long")


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row a row of ``docs``.

    A null text has size 0. Documents of size 0 are rounded like others; they
    add no words. Rows that share an id are rounded one by one, equal ones
    together. Null ids hash alike. An empty table gives an empty one; other
    columns are not read.
    """
    g = grouped_copies(docs, weights, most).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return g.select("doc_id", "source", "size", "source_size", "target", _share(F.col("copies"), F.col("rows"), F.col("nth")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as :func:`copies` says, with
    its columns whatever their names. Rows of one id, source and text share their
    copies in the order of the rows' hashes."""
    keys = {fresh(docs, f"_{k}"): v for k, v in (("doc_id", F.col("doc_id").cast("long")), ("source", F.col("source").cast("string")), ("text_key", text_key(docs)))}
    made, rows, nth, copy = (fresh(docs, c) for c in ("_made", "_rows", "_nth", "_copy"))
    right = {k: f"{k}_found" for k in keys}
    plan = grouped_copies(docs, weights, most).select(*(F.col(c).alias(right[k]) for k, c in zip(keys, ("doc_id", "source", "text_key"))), F.col("copies").alias(made), F.col("rows").alias(rows)).where(F.col(made) > 0)
    d = docs.withColumns(keys)
    same = [d[f"`{k}`"].eqNullSafe(plan[f"`{r}`"]) for k, r in right.items()]
    d = d.join(plan, same)
    # only rows that repeat are numbered
    once = d.where(F.col(rows) == 1).withColumn(nth, F.lit(1))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)))))
    again = d.where(F.col(rows) > 1).withColumn(nth, number)
    d = once.unionByName(again).withColumn(made, _share(F.col(made), F.col(rows), F.col(nth))).where(F.col(made) > 0)
    return d.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(made)))).select(*(f"`{c}`" for c in docs.columns))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each document."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
