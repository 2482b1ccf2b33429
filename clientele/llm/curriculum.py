"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight and a schedule: its rate over the training time
``t`` in [0, 1] as a piecewise-linear curve. The integral of the curve, scaled
to the source's target, is its cumulative token demand. A document's words are
a stretch of its source's token stream (documents in the order of a hash of
their id, the stream repeated for further epochs); inverting the demand at the
start of the stretch gives the training time at which the document is due.
Sorting by that time (range partitioning) gives the curriculum.

DataFrame functions only. Per-source running sums are taken in two levels
(buckets of the hash, then bucket totals), so a source that holds a third of
all rows is spread over all buckets. Per-source values are one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import word_count, written

#: Flat rate.
FLAT = ((0.0, 1.0), (1.0, 1.0))


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """Pieces ``(t0, length, rate at t0, rate at its end, share before t0)`` of
    the curve through ``knots`` ((t, rate), ...), scaled to the integral 1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(r < 0 for _, r in knots):
        raise ValueError("knots run from t=0 to t=1 with rates of 0 or more")
    pieces = [(a, b - a, u, v) for (a, u), (b, v) in zip(knots, knots[1:]) if b > a]
    area = sum(h * (u + v) / 2 for _, h, u, v in pieces)
    if area <= 0:
        raise ValueError("the rates are 0 everywhere")
    out, before = [], 0.0
    for a, h, u, v in pieces:
        out.append((a, h, u / area, v / area, before))
        before += h * (u + v) / 2 / area
    return out


def demand_time(share: Column, pieces) -> Column:
    """Inverse of the cumulative demand: the time by which ``share`` of it has passed."""
    out = None
    for a, h, u, v, before in reversed(pieces):
        x = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(u * u) + F.lit(2 * (v - u) / h) * x, F.lit(0.0)))
        d = F.lit(a) + F.coalesce(F.try_divide(2 * x, F.lit(u) + root), F.lit(0.0))
        out = d if out is None else F.when(share < F.lit(before + h * (u + v) / 2), d).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _key(col: Column) -> Column:
    """A join key for a source that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit("n"))


def cyclic_weights(sources: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """``(source, weight, schedule)``: the weights repeat over the sources by
    code point, null last; the schedule's number is the weight's place."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    place = (n % len(weights)).cast("int")
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("weight"),
                          place.alias("schedule"))


def targets(sizes: DataFrame, weights: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(skey, source_size, target, schedule)`` per source. The targets share
    the total by weight; none is above ``max_epochs`` times its source's size,
    and the excess goes to the others by weight (sources without a weight: 0).

    A source is capped exactly if the level at which its cap fills
    (cap / weight) already asks for no more than the total; then the level of
    the others follows. One row a source throughout.
    """
    w = weights.select(_key(F.col("source")).alias("skey"), F.col("weight").cast("double").alias("weight"), "schedule")
    s = (sizes.join(w, "skey", "left")
         .withColumn("weight", F.coalesce(F.greatest("weight", F.lit(0.0)), F.lit(0.0)))
         .withColumn("schedule", F.coalesce("schedule", F.lit(0)))
         .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
         .withColumn("level", F.try_divide("cap", "weight")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(F.col("level").asc_nulls_last())
    s = (s.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
         .withColumn("w_all", F.sum("weight").over(everything))
         .withColumn("asked", F.sum("cap").over(upto) + F.col("level") * (F.col("w_all") - F.sum("weight").over(upto)))
         .withColumn("capped", F.coalesce(F.col("asked") <= F.col("total"), F.lit(False)))
         .withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
         .withColumn("w_free", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)))
    share = F.coalesce(F.try_divide(F.col("rest") * F.col("weight"), F.col("w_free")), F.lit(0.0))
    return s.select("skey", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"), "schedule")


def curriculum(docs: DataFrame, weights=None, schedules=(FLAT,), max_epochs: int = 3, cut_last: bool = True,
               carry=(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               buckets: int | None = None) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken, instances`` and
    the columns in ``carry`` as the struct ``kept``.

    ``instances`` is one ``(epoch, position, words)`` for each time that the
    mix takes the document; ``taken`` sums the words. ``weights`` is a
    DataFrame ``(source, weight, schedule)`` or a function that makes it from
    the distinct sources (default: 5, 2, 1 repeating). ``schedules`` are the
    curves by number. With ``cut_last`` the last document that a source gives
    is cut at its target; without, it is taken whole if at least half of its
    words are due.

    Defined cases: a null text has size 0; documents of size 0 are taken 0
    times; a null source is a source of its own; null ids sort by an empty
    hash; rows repeated alike each count and are interchangeable; no rows give
    no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n_buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    order = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    kept = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), order.alias("ord"), kept.alias("kept"))
    bucket = F.coalesce((F.conv(F.substring("ord", 1, 6), 16, 10).cast("long") * n_buckets / F.lit(16 ** 6)).cast("int"),
                        F.lit(0))
    rows = rows.withColumn("skey", _key(F.col("source"))).withColumn("bucket", bucket)
    if not carry:
        rows = written(rows.drop("kept"), "sizes").withColumn("kept", kept)  # the texts are read once
    totals = rows.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = written(totals, "source-buckets")  # at most a row for each source and bucket
    per_source = totals.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size"))
    weights = cyclic_weights if weights is None else weights
    given = weights(per_source.select("source")) if callable(weights) else weights
    goal = targets(per_source.drop("source"), given, max_epochs)
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
               .join(goal, "skey").select("skey", "bucket", "before", "source_size", "target", "schedule"))
    inside = (Window.partitionBy("skey", "bucket").orderBy("ord", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["skey", "bucket"])
              .withColumn("start", F.col("before") + F.col("upto") - F.col("size")))

    def instance(e: Column) -> Column:
        at = F.col("start") + e * F.col("source_size")
        share = F.coalesce(F.try_divide(at.cast("double"), F.col("target")), F.lit(0.0))
        time = None
        for k, knots in reversed(list(enumerate(schedules))):
            t = demand_time(share, segments(knots))
            time = t if time is None else F.when(F.col("schedule") == k, t).otherwise(time)
        if cut_last:
            words = F.greatest(F.least(F.col("size"), F.floor("target") - at), F.lit(0))
        else:
            words = F.when(2 * at + F.col("size") <= 2 * F.col("target"), F.col("size")).otherwise(F.lit(0))
        return F.struct(e.cast("int").alias("epoch"), time.alias("position"), words.cast("long").alias("words"))

    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1)).cast("array<long>")
    taken = F.filter(F.transform(epochs, instance), lambda x: x["words"] > 0)
    out = placed.withColumn("instances", taken)
    total = F.aggregate("instances", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"),
                      "target", total.alias("taken"), "instances", *(["kept"] if carry else []))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents in the order of training: a row for each instance, range-sorted
    by position, with the input's columns (a document that is taken twice comes twice)."""
    columns = docs.columns
    out = curriculum(docs, carry=columns, **options)
    out = out.select("kept", "doc_id", F.explode("instances").alias("x"))
    return out.orderBy("x.position", "doc_id", "x.epoch").select(*[F.col(f"kept.`{c}`").alias(c) for c in columns])
