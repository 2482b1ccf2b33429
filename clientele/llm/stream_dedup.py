"""Exact deduplication as a stateful stream.

``ingest`` streams a folder of documents through a grouped aggregation whose
state is kept on disk (RocksDB), has no expiry, and holds for every digest the
largest document id with the locator of its content (file and row) and the
number of rows seen. The state lives in a folder; a later run continues from
it with the new files only. ``classes`` reads that state as a table.
``resolve`` gives every document its class: rows whose digest occurs twice or
more are hits, and a hit counts only after its full text has been compared
with the retained one. If texts with one digest differ, that digest's rows are
grouped again by their full texts, so the result never rests on the hash.

DataFrame and SQL functions only. State and shuffles hold a digest and a few
numbers per row. Full texts travel only for rows that a fixed-size bitmap of
the repeated digests lets through. Copies are never paired with each other:
each is compared with the one retained row of its class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower, bitmap_has, bitmap_of, bitmap_position, scratch, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, located: bool, digest) -> DataFrame:
    """``doc_id, file, row, norm, digest``; without file metadata the locator is null."""
    place = ([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if located
             else [F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row")])
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), *place, F.coalesce(ascii_lower(text), F.lit("")).alias("norm"))
    return rows.withColumn("digest", digest(F.col("norm")))


def ingest(spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text",
           digest=sha256) -> None:
    """Stream all files under ``path`` that ``state_dir`` has not seen into the keyed state."""
    schema = spark.read.parquet(path).schema
    own = spark.newSession()  # the state store's settings stay out of the caller's session
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "300")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # no reserved space per store
    own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    path = path.rstrip("/")
    # as a glob of itself the path may name a folder or a single file
    stream = own.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    seen = (_rows(stream, id_col, text_col, True, digest)
            .groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("n")))
    query = (seen.writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", state_dir).trigger(availableNow=True).start())
    query.awaitTermination()


def classes(spark: SparkSession, state_dir: str) -> DataFrame:
    """The state as a table ``digest, keep_id, keep_file, keep_row, group_size``."""
    state = spark.read.format("statestore").load(state_dir)
    return state.select("key.digest", F.col("value").getField(state.schema["value"].dataType.names[0]).alias("kept"),
                        F.col("value").getField(state.schema["value"].dataType.names[1]).alias("group_size")).select(
        "digest", F.col("kept.doc_id").alias("keep_id"), F.col("kept.file").alias("keep_file"),
        F.col("kept.row").alias("keep_row"), "group_size")


def resolve(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Per row of ``docs`` (read from files): ``doc_id, keep_id, group_size, kept, digest, verified``.

    ``known`` is the result of ``classes`` after the same files were ingested.
    Defined cases: a null text counts as empty; of equal texts the largest id
    stays, of rows with that id the one with the last locator; null ids are the
    smallest; no rows give no rows; other columns are ignored.
    """
    repeated = known.filter(F.col("group_size") > 1)
    n = repeated.count()
    bits = min(27, max(15, math.ceil(math.log2(max(n, 1) * 8))))  # at most 16 MB of bitmap
    parts = F.broadcast(bitmap_of(repeated, "digest", bits))
    rows = (_rows(docs, id_col, text_col, True, digest).withColumn("pos", bitmap_position(F.col("digest"), bits))
            .withColumn("part", F.shiftright("pos", 15)).join(parts, "part", "left"))
    rows = written(rows.withColumn("norm", F.when(bitmap_has(), F.col("norm"))).drop("pos", "part", "bitmap"), "hits")
    single = rows.filter(F.col("norm").isNull()).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                        F.lit(True).alias("kept"), "digest", F.lit(True).alias("verified"))
    hits = rows.filter(F.col("norm").isNotNull()).join(repeated, "digest", "left")
    is_kept = (F.col("file").eqNullSafe(F.col("keep_file"))) & (F.col("row").eqNullSafe(F.col("keep_row")))
    retained = (hits.filter(F.col("group_size").isNotNull() & is_kept)
                .select("digest", F.col("norm").alias("kept_norm")))
    checked = (hits.join(retained, "digest", "left")
               .withColumn("verified", F.col("group_size").isNull() | F.coalesce(F.col("norm") == F.col("kept_norm"), F.lit(False)))
               .select("doc_id", "file", "row", "digest", "verified", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                       F.coalesce("group_size", F.lit(1)).alias("group_size"),
                       (F.col("group_size").isNull() | is_kept).alias("kept")))
    checked = written(checked, "checked")
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "verified"]
    differing = checked.filter(~F.col("verified")).select("digest").distinct()
    if differing.limit(1).count() == 0:
        return single.unionByName(checked.select(columns))
    again = rows.join(differing, "digest", "left_semi")
    exact = again.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("k"),
                                                F.count(F.lit(1)).alias("group_size"))
    redone = (again.join(exact, ["digest", "norm"])
              .select("doc_id", F.col("k.doc_id").alias("keep_id"), "group_size",
                      (F.col("file").eqNullSafe(F.col("k.file")) & F.col("row").eqNullSafe(F.col("k.row"))).alias("kept"),
                      "digest", F.lit(True).alias("verified")))
    return single.unionByName(checked.join(differing, "digest", "left_anti").select(columns)).unionByName(redone)


def exact_dedup(spark: SparkSession, path: str, state_dir: str | None = None, **options) -> DataFrame:
    """Ingest ``path`` (into a new state folder unless one is given) and resolve its rows."""
    state_dir = state_dir or scratch(spark, "dedup-state")
    ingest(spark, path, state_dir, **options)
    return resolve(spark.read.parquet(path), classes(spark, state_dir), **options)
