"""Queries of the stores: bad records set apart (SRC-1), resolved locations (JOIN-5), mergeable profiles (PRF-5, PRF-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import location_store, profile_store
from ..operators.geo import clean_location, distinct_locations
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources.dimensions import gazetteer, iata
from ..sources.quarantine import load_checked
from .registry import query


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/clientele-{name}/{uuid.uuid4().hex}"


@query("quarantined_records")
def q_quarantined_records(spark, sf_dir):
    """SRC-1: customers as csv and json lines, every tenth line broken: good and quarantined ones, with sums of the good."""
    c = fx.churn_customers(spark, sf_dir).select("customerID", "Contract", F.col("Tenure").cast("int").alias("Tenure"))
    broken = F.col("customerID") % 10 == 0
    lines = {"csv": F.concat_ws(",", F.col("customerID").cast("string"), "Contract", F.when(broken, F.lit("many")).otherwise(F.col("Tenure").cast("string"))),
             "json": F.when(broken, F.substring(F.to_json(F.struct("*")), F.lit(2), F.lit(1000))).otherwise(F.to_json(F.struct("*")))}
    out = None
    for fmt, line in lines.items():
        path = _folder(spark, f"lines-{fmt}")
        c.select(line.alias("value")).write.text(path)
        good, bad = load_checked(spark, path, "customerID long, Contract string, Tenure int", fmt=fmt, header=False)
        part = good.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("good"), F.sum("Tenure").alias("tenure"), F.sum("customerID").alias("ids"))
        part = part.withColumn("quarantined", bad.agg(F.count(F.lit(1))).scalar())
        out = part if out is None else out.unionByName(part)
    return out


@query("resolution_store")
def q_resolution_store(spark, sf_dir):
    """JOIN-5 with a store: half of the trips' places first, then all of them; the second run resolves the new ones only."""
    trips, gaz, store = fx.routes(spark, sf_dir), gazetteer(spark), _folder(spark, "places")
    cities = lambda t: distinct_locations(clean_location(t, "Route", iata(spark)))
    location_store.resolve_with_store(cities(trips.where("TripID % 2 = 0")), gaz, store)
    return location_store.resolve_with_store(cities(trips), gaz, store).select("city", "key", "match_tier", "lat", "lon")


@query("merged_profile")
def q_merged_profile(spark, sf_dir):
    """PRF-5, PRF-6: three deliveries of customers profiled alone and merged; numbers of distinct values below 50 counted."""
    c = fx.churn_customers(spark, sf_dir)
    parts = None
    for k in range(3):
        p = profile_store.profile(c.where(F.col("customerID") % 3 == k))
        parts = p if parts is None else parts.unionByName(p)
    merged = profile_store.merge(parts)
    few = profile_store.groupable(merged, c, 50).where("distinct_values <= 20").select("column_name", "distinct_values")
    return merged.drop("sketch", "kind").join(F.broadcast(few), "column_name", "left")
