"""Queries: location clean-up and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.geo import (analyze_locations, clean_location, distinct_locations, exact_tier, fuzzy_tier,
                             fuzzy_tier_ratio, geo_quality, location_frequency, substring_tier,
                             top_locations, unmatched_locations)
from ..sources import fixtures as fx
from ..sources.dimensions import gazetteer, iata
from .registry import query


def _cleaned(spark, sf_dir, keep_iata=False):
    return clean_location(fx.routes(spark, sf_dir), "Route", iata(spark), keep_iata=keep_iata)


def _resolved(spark, sf_dir):
    return analyze_locations(fx.routes(spark, sf_dir), "Route", gazetteer(spark), iata(spark))


@query("clean_location")
def q_clean_location(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    return c.select("TripID", "Route", "clean_loc", F.initcap("clean_loc").alias("Mapped_Location"))


@query("geo_iata")
def q_geo_iata(spark, sf_dir):
    c = _cleaned(spark, sf_dir, keep_iata=True)
    return c.select("TripID", "Route", "iata_city")


@query("geo_exact")
def q_geo_exact(spark, sf_dir):
    c, gaz = _cleaned(spark, sf_dir), gazetteer(spark)
    hits = exact_tier(distinct_locations(c), gaz).join(gaz.select("key", "lat", "lon"), "key")
    return c.join(hits, F.col("clean_loc") == F.col("city"), "left").select("TripID", "clean_loc", "key", "lat", "lon")


@query("geo_substring")
def q_geo_substring(spark, sf_dir):
    return substring_tier(distinct_locations(_cleaned(spark, sf_dir)), gazetteer(spark))


@query("geo_fuzzy")
def q_geo_fuzzy(spark, sf_dir):
    f = fuzzy_tier(distinct_locations(_cleaned(spark, sf_dir)), gazetteer(spark))
    return f.select("city", "key", F.round("score", 6).alias("score"))


@query("geo_fuzzy_ratio")
def q_geo_fuzzy_ratio(spark, sf_dir):
    f = fuzzy_tier_ratio(distinct_locations(_cleaned(spark, sf_dir)), gazetteer(spark))
    return f.select("city", "key", F.round("score", 6).alias("score"))


@query("geo_resolve")
def q_geo_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("TripID", "Route", "clean_loc", "lat", "lon", "iso3",
                                          "match_tier", "Mapped_Location")


@query("geo_unmatched")
def q_geo_unmatched(spark, sf_dir):
    return unmatched_locations(_resolved(spark, sf_dir))


@query("geo_frequency")
def q_geo_frequency(spark, sf_dir):
    """JOIN-9: the name counted is that of the cleaned location, so nothing needs to be resolved."""
    named = _cleaned(spark, sf_dir).withColumn("Mapped_Location", F.initcap("clean_loc"))
    return location_frequency(named).select("TripID", "Mapped_Location", "Frequency")


@query("geo_quality")
def q_geo_quality(spark, sf_dir):
    return geo_quality(fx.routes(spark, sf_dir), _resolved(spark, sf_dir), "Route")


@query("top_locations")
def q_top_locations(spark, sf_dir):
    t = top_locations(_resolved(spark, sf_dir), "Amount", n=10)
    return t.select("Mapped_Location", F.round("avg_Amount", 6).alias("avg_Amount"))
