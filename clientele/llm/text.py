"""Helpers shared by the corpus operators: native text columns, scratch folders
in the shared checkpoint folder, a fixed-size bitmap filter, array hashing."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space (Java and Python regular expressions read it alike).
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for a text of ASCII, which its
    lengths show at once, and is much faster than ``translate``."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def word_count(col: Column) -> Column:
    """Number of maximal runs of characters that are no ASCII white space; 0 for null."""
    blank = [F.lit(c) for c in WS_CHARS]
    lead = (F.substring(col, 1, 1).isin(*blank) | (col == "")).cast("int")
    tail = F.substring(col, -1, 1).isin(*blank).cast("int")
    return F.coalesce(F.size(F.split(col, f"{WS}+")) - lead - tail, F.lit(0)).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, rows go to Python functions ``BATCH_BYTES`` at a time, unless the session has a limit of its own. The usual
    10,000 rows are tens of megabytes of text, held by the JVM and twice by every Python worker at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is None:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute once into a table in the shared folder and read it back (cuts
    the lineage, survives lost executors)."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark removes them when the
    driver's JVM collects their plans, which it is asked to do here."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if ensure_checkpoint_dir(spark).split(":", 1)[-1].strip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        sweep(spark)


def bitmap_of(keys: DataFrame, hex_col: str, bits: int) -> DataFrame:
    """Bitmap of the first hexadecimal digits of ``hex_col``: at most
    2**(bits-15) rows ``(part, bitmap)`` of 4 KB, whatever the input, so it can
    be broadcast (2**22 bits are 512 KB)."""
    pos = bitmap_position(F.col(hex_col), bits)
    return (keys.select(pos.alias("pos")).groupBy(F.shiftright("pos", 15).alias("part"))
            .agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND(32767)).alias("bitmap")))


def bitmap_position(hex_col: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("long"), 32 - bits)


def bitmap_has(pos: str = "pos", bitmap: str = "bitmap") -> Column:
    """Whether the bit of column ``pos`` is set in column ``bitmap`` (false for null)."""
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast((({pos} & 32767) >> 3) + 1 as int), 1)")), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr(f"1 << cast({pos} & 7 as int)")) != 0, F.lit(False))


def row_mark(id_col: Column, text_col: Column) -> Column:
    """Digest of a row's id and text: 32 hexadecimal digits of two 64-bit hashes, made without copies of the text
    (a null id differs from any other, a null text counts as empty)."""
    parts = [id_col.isNull(), id_col, F.coalesce(text_col.cast("string"), F.lit(""))]
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(*p))), 16, "0") for p in (parts, parts[::-1])])


def without(docs: DataFrame, judged: DataFrame, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose ``mark`` is not in ``judged (mark, keep)``, and one row of each mark that is kept there.

    A fixed-size bitmap of the judged marks (4 MB at most) tells most rows apart, so only the others, and no text
    of the rows that simply stay, are shuffled. One row of equal marks is the smallest, by a plain aggregate."""
    judged = written(judged, "judged-rows")
    bits = min(25, max(15, int(np.ceil(np.log2(max(judged.count(), 1) * 16)))))
    parts = F.broadcast(bitmap_of(judged, "mark", bits).withColumnsRenamed({"part": "__part", "bitmap": "__bits"}))
    pos = bitmap_position(F.col("__mark"), bits)
    rows = docs.withColumn("__mark", mark).withColumn("__pos", pos).withColumn("__part", F.shiftright("__pos", 15)).join(parts, "__part", "left")
    hit = bitmap_has("__pos", "__bits")
    clear = rows.filter(~hit).select(docs.columns)
    doubt = rows.filter(hit).select("__mark", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    doubt = doubt.join(judged.select(F.col("mark").alias("__mark"), F.col("keep").alias("__keep")), "__mark", "left").filter(F.coalesce("__keep", F.lit(True)))
    free = doubt.filter("__keep is null").select("__row.*")
    one = doubt.filter("__keep").groupBy("__mark").agg(F.min("__row").alias("__row")).select("__row.*")
    return clear.unionByName(free).unionByName(one)


# ---- vectorised hashing of the words of a batch of texts (numpy) ----

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_chunks(texts, budget: int):
    """Lists of (position, text) whose texts have about ``budget`` characters together."""
    group, held = [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if group and held + len(t) > budget:
            yield group
            group, held = [], 0
        group.append((i, t))
        held += len(t)
    if group:
        yield group


_P = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE = 1 << 16  # small enough for the processor caches


def word_hashes(data: bytes, lower: bool = True, cut=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, first bytes, sizes)`` of the words (runs of bytes that are no
    ASCII white space; with ``lower``, A-Z lower-cased) of ``data``: 64-bit
    hashes, the same for the same word anywhere. ``cut(bytes, inside)`` may give
    more places where a word starts. Works through slices that end at white space."""
    hashes, firsts, lengths, at = [], [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE:
            end = max(data.rfind(c, at, at + SLICE) for c in (b" ", b"\n", b"\t", b"\r")) + 1
            if end <= at:  # no white space in the whole slice
                ends = [e for c in (b" ", b"\n", b"\t", b"\r") if (e := data.find(c, at + SLICE)) >= 0]
                end = min(ends, default=len(data) - 1) + 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_BLANK[b]
        first = inside & ~np.concatenate([[False], inside[:-1]])
        if cut is not None:
            first |= cut(b, inside)
        starts = np.flatnonzero(first)
        if len(starts):
            sizes = np.diff(np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)))
            chars = (_LOWER[b[inside]] if lower else b[inside]).astype(np.uint64)
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(chars)) - np.repeat(begin, sizes)
            powers = np.cumprod(np.full(int(sizes.max()), _P, np.uint64))
            h = np.add.reduceat((chars + np.uint64(1)) * powers[place], begin)
            hashes.append(mix64(h + sizes.astype(np.uint64)))
            firsts.append(starts + at)
            lengths.append(sizes)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lengths)


_C = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles (all, in order); with fewer words the whole sequence as one."""
    size = min(k, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        out = out + words[j:j + n] * _C[j % 64]
    return mix64(out)


def doc_words(texts: list[str]):
    """Word hashes of each text of a list, hashed together."""
    parts = [t.encode() for t in texts]
    hashes, firsts, _ = word_hashes(b"\n".join(parts))
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    cuts = np.searchsorted(firsts, np.cumsum(sizes))
    return [hashes[a:z] for a, z in zip([0, *cuts[:-1]], cuts)]
