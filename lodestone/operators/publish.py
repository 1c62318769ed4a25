"""Several tables that readers see together, or not at all.

Every write goes to a folder of its own under ``root``; when all of its tables are complete an empty marker file is created, whose name
holds a number and the folder. Readers take the folder of the greatest marker. A writer that fails leaves the folder without a marker, which no reader
looks at; of writers at one time the greatest name wins, whole. Folders that an older marker names stay until ``clean``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKERS = "_published"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _markers(spark: SparkSession, root: str) -> list[str]:
    files, folder = _files(spark, f"{root}/{_MARKERS}")
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], *, sort: dict[str, list[str]] | None = None) -> str:
    """Write the tables as Parquet and show them to readers at once; gives their folder.

    ``sort``: columns by which a table is range-partitioned and sorted, so that filters on them skip files and row groups.
    """
    folder = uuid.uuid4().hex
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in tables.items():
        keys = (sort or {}).get(name)
        rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if keys else df
        rows.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(f"{root}/{folder}/{name}")
    latest = _markers(spark, root)
    number = int(latest[-1].split("-")[0]) + 1 if latest else 1
    files, marker = _files(spark, f"{root}/{_MARKERS}/{number:010d}-{folder}")
    files.create(marker, False).close()
    return f"{root}/{folder}"


def published(spark: SparkSession, root: str) -> str | None:
    """The folder of the latest tables; a reader that keeps it goes on with the same ones."""
    latest = _markers(spark, root)
    return f"{root}/{latest[-1].split('-')[1]}" if latest else None


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder = published(spark, root)
    if folder is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{folder}/{name}")


def clean(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete the folders and markers of all but the latest ``keep`` writes, and no unmarked folder, which may be at work."""
    for name in _markers(spark, root)[:-keep]:
        for path in (f"{root}/{_MARKERS}/{name}", f"{root}/{name.split('-')[1]}"):
            files, hadoop = _files(spark, path)
            files.delete(hadoop, True)
