"""Normals and local density from nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn

NEIGHBOURS = 16


def moments(points: DataFrame, radius: float, k: int = NEIGHBOURS) -> DataFrame:
    """(point_id, n, density, cov_xx .. cov_zz) over each point's ``k`` nearest
    (itself included). density is the mean squared distance to their centroid."""
    if k < 3:
        raise ValueError("normals need three neighbours or more")
    q = points.select(F.col("point_id").alias("query_id"), "x", "y", "z")
    s = knn.summary(knn.k_nearest(q, points, radius, k), ["query_id"])
    return s.withColumn("density", F.col("cov_xx") + F.col("cov_yy") + F.col("cov_zz")).withColumnRenamed("query_id", "point_id")


def estimate(points: DataFrame, radius: float, k: int = NEIGHBOURS) -> DataFrame:
    """(point_id, nx, ny, nz, density, flatness): the direction of least variance
    of the neighbours, its component of greatest magnitude made positive; no
    normal where fewer than three neighbours are in reach."""
    cov = ["cov_xx", "cov_xy", "cov_xz", "cov_yy", "cov_yz", "cov_zz"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = pdf[cov].to_numpy(float)
            m = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            w, v = np.linalg.eigh(m)
            n = v[:, :, 0]
            lead = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], 1)
            n = np.where(lead < 0, -n, n)
            n[pdf["n"].to_numpy() < 3] = np.nan
            flat = 1 - np.clip(w[:, 0], 0, None) / np.where(w[:, 1] > 0, w[:, 1], 1)
            out = pd.DataFrame({"point_id": pdf["point_id"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "density": pdf["density"], "flatness": flat})
            yield out.astype({"nx": "float32", "ny": "float32", "nz": "float32"})

    return moments(points, radius, k).select("point_id", "n", "density", *cov).mapInPandas(solve, "point_id long, nx float, ny float, nz float, density double, flatness double")


def colours(estimated: DataFrame) -> DataFrame:
    """Flatness and verticality of each point as 0..255."""
    return estimated.select("point_id", F.floor(F.col("flatness") * 255).cast("int").alias("flat"), F.floor(F.abs("nz") * 255).cast("int").alias("vertical"))
