"""Line-based sources with bad records set apart (SRC-1).

A permissive reader turns what it cannot parse into nulls, silently. Here every
line of a csv or json-lines source is parsed with the caller's schema, and a line
that does not fit it goes, unchanged, to a quarantine table with its file and place.
Good rows + quarantined lines = lines of the files (headers and blank lines left out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, block, at``: each line with its file, the first byte of the split it was read from and a number
    that grows with the lines of that split."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def load_checked(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", header: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantined)``: the rows that fit ``schema``, and ``line, file, block, place, reason`` of those that do not.

    ``fmt`` is ``csv`` or ``json`` (one record a line); ``header`` says that every csv file's first line repeats the column
    names. ``place`` counts the split's lines from 0. A line does not fit if it has too few or too many fields, a value
    that is not of its type, is no json object, or lacks a field that the schema says is not null. Blank lines are no records.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"not a line-based format: {fmt!r}")
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = read_lines(spark, path).where(F.trim("line") != "")
    opts = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    if fmt == "csv":
        if header:
            names = options.get("sep", ",").join(f.name for f in fields.fields)
            lines = lines.where(~((F.col("block") == 0) & (F.regexp_replace("line", '["\\s\ufeff]', "") == names.replace(" ", ""))))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.fields) + f", {BAD} string"
        parsed = lines.withColumn("r", F.from_csv("line", F.lit(ddl), opts))
    else:
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.fields] + [T.StructField(BAD, T.StringType())])
        parsed = lines.withColumn("r", F.from_json("line", nullable, opts))
    missing = [f.name for f in fields.fields if not f.nullable]
    unread = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull()
    lacks = F.lit(False)
    for n in missing:
        lacks = lacks | F.col(f"r.`{n}`").isNull()
    good = parsed.where(~unread & ~lacks).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in fields.fields])
    first = read_lines(spark, path).groupBy("file", "block").agg(F.min("at").alias("first"))  # a row a split
    reason = F.when(unread, "does not fit the schema").otherwise("a required field is missing")
    bad = parsed.where(unread | lacks).select("line", "file", "block", "at", reason.alias("reason")).join(F.broadcast(first), ["file", "block"])
    return good, bad.select("line", "file", "block", (F.col("at") - F.col("first")).alias("place"), "reason")
