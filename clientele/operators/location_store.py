"""A store of resolved locations (JOIN-5): a run resolves only places it has not seen.

The store is a folder of immutable parts (city, key, tier, coordinates) and of versions,
each a small list of parts. A run reads the last version, anti-joins its distinct
locations with it, resolves the rest, writes them as one new part, and publishes the next
version by one write. Until that write is committed readers see the version before, so a
run that dies leaves at most an unlisted part. Places that match nothing are stored too
(with a null key), or they would be tried again in every run.

A version holds the fingerprint of the gazetteer: with another gazetteer the store starts anew.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partitioning import materialize
from .geo import resolve_locations

PART = "city string, key string, match_tier string, lat double, lon double, iso3 string"


def fingerprint(gaz: DataFrame) -> str:
    row = gaz.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("ord", "key", "lat", "lon", "iso3").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h}"


def latest(spark: SparkSession, store: str, mark: str) -> tuple[int, list[str]]:
    """Number and parts of the last published version of this gazetteer (0 and none without one)."""
    try:
        versions = spark.read.schema("gazetteer string, parts array<string>, version int").parquet(f"{store.rstrip('/')}/versions")
        last = versions.where(F.col("gazetteer") == mark).orderBy(F.desc("version")).limit(1).collect()
        newest = versions.agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return 0, []
    return newest, list(last[0].parts) if last else []


def resolve_with_store(cities: DataFrame, gaz: DataFrame, store: str, **how) -> DataFrame:
    """The resolution of ``cities (city)``: ``city, key, match_tier, lat, lon, iso3``, as ``resolve_locations`` gives it.
    New places are resolved and published first; ``store`` is a shared folder, ``how`` goes to ``resolve_locations``.
    The store must always be used with the same ``how``."""
    spark, store, mark = cities.sparkSession, store.rstrip("/"), fingerprint(gaz)
    cities = materialize(cities.select("city").where(F.col("city").isNotNull() & (F.col("city") != "")).distinct())
    version, parts = latest(spark, store, mark)
    known = spark.read.schema(PART).parquet(*parts) if parts else spark.createDataFrame([], PART)
    new = materialize(cities.join(known.select("city"), "city", "left_anti"))
    if new.limit(1).count():
        found = new.join(resolve_locations(new, gaz, **how), "city", "left").select(*[c.split()[0] for c in PART.split(", ")])
        part = f"{store}/parts/{uuid.uuid4().hex}"
        found.write.parquet(part)
        parts = [*parts, part]
        row = spark.createDataFrame([(mark, parts)], "gazetteer string, parts array<string>")
        row.coalesce(1).write.parquet(f"{store}/versions/version={version + 1}")  # fails if another run published it first
        known = spark.read.schema(PART).parquet(*parts)
    return known.join(cities, "city", "left_semi").where("key is not null")
