"""Line deduplication over levelled sorted runs of line hashes.

The store is a set of runs: tables ``(h, n)`` bucketed and sorted by the line
key's 128-bit hash, with the number of documents in which the key was found. A
new batch of documents is merge-anti-joined with the runs of settled keys
(those that have reached the document threshold need no more counting), and
what is left is added as a run of level 0. When a level has ``fanout`` runs
they are compacted into one run of the next level, and keys that reach the
threshold move to the settled runs. Because all runs share buckets and order,
these joins are sort-merge joins that shuffle none of the runs.

DataFrame and SQL functions only. A key that stands in a third of all
documents is pre-aggregated before each shuffle; the final lookup moves hashes
and line numbers, no text, and splits such a key (adaptive skew join).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WS_CHARS, ascii_lower, discard, scratch, written


def line_keys(text: Column, min_chars: int = 1) -> Column:
    """Per line its key's hash as 32 hexadecimal digits; null for keys under ``min_chars`` code points."""
    def key(line):
        k = F.btrim(line, F.lit(WS_CHARS))
        return F.when(F.length(k) >= min_chars, F.md5(k.cast("binary")))
    return F.transform(F.split(ascii_lower(text), "\n"), key)


def distinct_sorted(arr: Column) -> Column:
    """Distinct non-null elements, by sorting (no quadratic scan for very long arrays)."""
    s = F.array(F.sort_array(F.filter(arr, lambda x: x.isNotNull())))
    return F.transform(s, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))[0]


class LineRuns:
    """The run store in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    def _write(self, df: DataFrame, partition_by=()) -> str:
        """Write a bucketed, sorted run and return its table's name."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "h").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def stage(self, lines: DataFrame) -> str:
        """Distinct keys per document ``(batch, h)`` as one table of candidate counts per batch."""
        return self._write(lines.groupBy("batch", "h").agg(F.count(F.lit(1)).alias("n")), ["batch"])

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join the batch's ``(h, n)`` with the settled runs and add the rest as a run."""
        for name in self.settled:
            batch = batch.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        self.levels[0].append(self._write(batch.select("h", "n")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].extend(self._compact(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _plain(self, names: list[str]) -> DataFrame:
        """The rows of several runs, read as plain files (a union of bucketed tables is not co-located)."""
        return self.spark.read.schema("h string, n long").parquet(*[f"{self.folder}/{name}" for name in names])

    def _compact(self, names: list[str]) -> list[str]:
        merged = self._plain(names).groupBy("h").agg(F.sum("n").alias("n"))
        merged = written(merged, "merged-run")
        self.settled.append(self._write(merged.filter(F.col("n") >= self.min_docs)))
        rest = self._write(merged.filter(F.col("n") < self.min_docs))
        self.drop(names)
        discard(merged)
        return [rest]

    def drop(self, names: list[str]) -> None:
        """Let go of tables that no later step reads."""
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def finish(self) -> DataFrame:
        """Compact what is left, but not a single run of a compaction again; the settled keys ``h``, each once
        (one may have been settled twice, by what runs of higher levels held)."""
        left = [name for level in self.levels for name in level]
        if len(left) > 1 or self.levels[0]:
            self.levels = [[], self._compact(left)]
        return self._plain(self.settled).select("h").distinct()


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 8, fanout: int = 2,
                        id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Per row ``doc_id, n_lines, n_dropped, kept_text``: lines whose key is found
    in at least ``min_docs`` rows are dropped in every row.

    Defined cases: a null text is one empty line, which has no key and stays;
    rows repeated alike count as documents of their own; null ids are allowed;
    no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    store = LineRuns(spark, folder or scratch(spark, "line-runs"), min_docs, fanout)
    batch = F.pmod(F.xxhash64("doc_id", "th"), F.lit(n_batches)).cast("int").alias("batch")
    staged = store.stage(rows.select(batch, F.explode(distinct_sorted(line_keys(F.col("text"), min_chars))).alias("h")))
    for k in range(n_batches):
        store.add(spark.table(staged).filter(F.col("batch") == k).select("h", "n"))
    store.drop([staged])
    settled = store.finish()
    keyed = rows.select("doc_id", "th", F.posexplode(line_keys(F.col("text"), min_chars)).alias("i", "h")).filter("h is not null")
    dropped = (keyed.join(settled, "h", "left_semi").groupBy("doc_id", "th")
               .agg(F.collect_list("i").alias("gone"), F.lit(1).alias("some")))
    dropped = written(dropped, "dropped-lines").withColumnsRenamed({"doc_id": "d_id", "th": "d_th"})
    out = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")), "left")
    lines = F.split("text", "\n")
    n = F.size(lines)
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    out = out.withColumn("lines", lines).withColumn("keep", F.when(F.col("some").isNotNull(), keep))
    kept_text = F.when(F.col("some").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("keep", lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                      F.when(F.col("some").isNull(), 0).otherwise(F.size("lines") - F.size("keep")).cast("long").alias("n_dropped"),
                      kept_text.alias("kept_text"))
