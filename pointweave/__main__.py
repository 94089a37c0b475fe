"""Command line: info FILE | import FILE STORE KEY | batch FOLDER_GLOB STORE KEY."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.cloud import ImportConfig, PointCloud
from .sources import registry


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("info", "import", "batch"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args[0] == "info":
        registry.info(spark, args[1]).show(truncate=False)
        return 0
    PointCloud.import_file(spark, args[1], ImportConfig()).save(registry.Store(spark, args[2]), args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
