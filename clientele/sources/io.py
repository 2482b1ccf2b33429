"""Sources and sinks (SRC-1..3, SNK-1)."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Reader format per file extension (SRC-1). Excel is a single-machine format
# with no Spark reader and is not supported.
_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}

# The driver's test tables (SRC-3: named sources).
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               mapping: Mapping[str, str] | None = None, schema=None, **options) -> DataFrame:
    """Read a table by extension; globs and directories work as in Spark.

    An unknown extension raises instead of returning an empty table. ``mapping``
    is standard name -> actual name, as in SRC-2.
    """
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/").replace("*", ""))[1].lower()
        if ext not in _FORMATS:
            raise ValueError(f"unsupported file type {ext!r} for {path}")
        fmt = _FORMATS[ext]
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", schema is None)
    if fmt == "json" and not path.endswith(".jsonl"):
        # A records-oriented JSON document (one array) as written by common tools.
        reader = reader.option("multiLine", options.pop("multiLine", "true"))
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return standardise_columns(df, mapping) if mapping else df


def standardise_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """SRC-2: rename actual columns to standard names (mapping is standard -> actual)."""
    present = {actual: std for std, actual in mapping.items() if actual in df.columns}
    return df.withColumnsRenamed(present)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def save_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> str:
    """SNK-1: keep a result for later steps as files in a shared folder."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)
    return path
