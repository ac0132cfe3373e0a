"""Tables from files: an extension, for what Spark's readers know."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}, not {format!r}")
    return spark.read.format(format).options(**options).load(path)


def parquet_tables(folder: str, names: list[str] | None = None) -> dict[str, str]:
    """Names and paths of the `<name>.parquet` below a folder of this machine, or of the names given."""
    if names is not None:
        return {n: f"{folder}/{n}.parquet" for n in names}
    return {f[: -len(".parquet")]: f"{folder}/{f}" for f in sorted(os.listdir(folder)) if f.endswith(".parquet")}
