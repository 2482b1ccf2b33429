"""Tiered location resolution against a gazetteer (PRJ-10, PRJ-11, JOIN-1..6,
JOIN-9, AGG-14..16).

Each tier runs on the *distinct* cleaned locations only, and each later tier
only on what the earlier tiers left (``left_anti``). All tiers are equi-joins on
indexes of the gazetteer (``similarity``): the substring tier joins three
characters that anchor a key, the fuzzy tiers join pairs of rare characters and
measure only pairs of texts with as many characters in common as the cutoff
demands. So any gazetteer size works, without a broadcast hint: the planner
broadcasts a side when its measured size allows.
The per-location result joins back to the rows once; rows without a location
are kept apart in that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import strip
from ..functions.partitioning import materialize
from ..functions.scalars import row_values
from .similarity import candidate_pairs, contained_keys, matching_ratio


# Patterns of the location clean-up.
ROUTE_PATTERN = r"(?iU)^(.*?)(?:\s+to\s+|-|\s+via\s+)"
NOISE_PATTERN = r"(?iU)\b(airport|intl|international|hub|city|ft|fort)\b"
PAREN_PATTERN = r"\(.*?\)"
COMMA_PATTERN = r",.*"
ACCENTS_FROM, ACCENTS_TO = "İüãé", "Iuae"
FUZZY_CUTOFF = 0.75


def clean_location(df: DataFrame, col: str, iata: DataFrame, out: str = "clean_loc",
                   keep_iata: bool = False) -> DataFrame:
    """PRJ-10 + JOIN-2: add the cleaned location.

    strip -> empty/'nan'/NULL to NULL -> keep a route's origin -> a 3-letter
    airport code becomes its city (and skips the rest) -> drop noise words,
    brackets and everything from the first comma -> fold İüãé -> strip -> lower.
    """
    v = strip(F.col(col).cast("string"))
    v = F.when(v.isNull() | (v == "") | (F.lower(v) == "nan"), F.lit(None).cast("string")).otherwise(v)
    origin = F.when(v.rlike(ROUTE_PATTERN), strip(F.regexp_extract(v, ROUTE_PATTERN, 1))).otherwise(v)
    staged = df.withColumn("__o", origin)
    # one row per three-character code
    codes = (iata.where(F.length("code") == 3)
             .groupBy(F.upper("code").alias("__code")).agg(F.max(F.lower("city")).alias("__iata_city")))
    j = staged.join(codes, (F.length("__o") == 3) & (F.upper("__o") == F.col("__code")), "left")
    w = F.regexp_replace(F.col("__o"), NOISE_PATTERN, "")
    w = F.regexp_replace(w, PAREN_PATTERN, "")
    w = F.regexp_replace(w, COMMA_PATTERN, "")
    w = F.lower(strip(F.translate(w, ACCENTS_FROM, ACCENTS_TO)))
    res = F.when(F.col("__iata_city").isNotNull(), F.col("__iata_city")).otherwise(w)
    j = j.withColumn(out, res)
    if keep_iata:
        j = j.withColumnRenamed("__iata_city", "iata_city")
    return j.drop("__o", "__code", "__iata_city")


def distinct_locations(cleaned: DataFrame, loc: str = "clean_loc") -> DataFrame:
    """AGG-16: the distinct non-empty cleaned locations."""
    return cleaned.select(F.col(loc).alias("city")).where(F.col("city").isNotNull() & (F.col("city") != "")).distinct()


def exact_tier(cities: DataFrame, gaz: DataFrame) -> DataFrame:
    """JOIN-1: equal key."""
    return cities.join(gaz.select("key", "ord"), F.col("city") == F.col("key")).select("city", "key")


def substring_tier(cities: DataFrame, gaz: DataFrame, word_boundary: bool = False) -> DataFrame:
    """JOIN-3: the first key (in gazetteer order) contained in the city.

    By default any substring counts (so 'lima' hits 'limassol', as in the
    reference); ``word_boundary=True`` only accepts whole words. Keys are found
    by their rarest three characters (``similarity.contained_keys``)."""
    pad = (lambda c: F.concat(F.lit(" "), c, F.lit(" "))) if word_boundary else (lambda c: c)
    keys = gaz.where(F.length("key") > 0).select(pad(F.col("key")).alias("part"), "key", "ord")
    texts = cities.select(pad(F.col("city")).alias("text"), "city").distinct()
    found = contained_keys(texts.select("text"), keys).groupBy("text").agg(F.min_by("key", "ord").alias("key"))
    return texts.join(found, "text").select("city", "key")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence. For up to 60 characters of ``b``
    the table's row is kept as bits of one number (bit-parallel recurrence of
    Hyyro, 2004), for longer texts as an array."""
    chars, n = F.split(b, ""), F.length(b)
    all_ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(60))) - 1

    def places(x):  # bits of the places in b that hold x
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(
            F.when(F.get(chars, i) == x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    letters = F.array_distinct(F.split(a, ""))
    masks = F.map_from_arrays(letters, F.transform(letters, places))

    def bits(m):
        def step(v, x):
            u = v.bitwiseAND(m[x])
            return (v + u).bitwiseOR(v - u).bitwiseAND(all_ones)
        return n - F.bit_count(F.aggregate(F.split(a, ""), all_ones, step))
    short = F.get(F.transform(F.array(masks), bits), F.lit(0))

    def row(old, x):
        step = lambda acc, y: F.concat(acc, F.array(
            F.when(x == y, F.get(old, F.size(acc) - 1) + 1)
             .otherwise(F.greatest(F.get(old, F.size(acc)), F.get(acc, F.size(acc) - 1)))))
        return F.aggregate(chars, F.array(F.lit(0)), step)
    long = F.element_at(F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), n + 1), row), -1)
    return F.when((F.length(a) == 0) | (n == 0), 0).when(n <= 60, short).otherwise(long)


def sequence_similarity(a: Column, b: Column) -> Column:
    """2 x longest common subsequence / total length: never below the reference's
    sequence-matcher ratio, whose matched blocks are one common subsequence."""
    return F.lit(2.0) * common_subsequence(a, b) / (F.length(a) + F.length(b))


def _best(scored: DataFrame, cutoff: float) -> DataFrame:
    # the cutoff applies to the best score, so that each pair is scored once
    best = scored.groupBy("city").agg(F.max(F.struct("score", "key")).alias("b")).where(F.col("b.score") >= cutoff)
    return best.select("city", F.col("b.key").alias("key"), F.col("b.score").alias("score"))


def fuzzy_tier(cities: DataFrame, gaz: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """JOIN-4 (edit distance): the best key with 1 - lev/max(len) >= cutoff; on
    equal scores the larger key wins."""
    pairs = candidate_pairs(cities, gaz, cutoff)
    return _best(pairs.withColumn("score", levenshtein_similarity(F.col("city"), F.col("key"))), cutoff)


def fuzzy_tier_ratio(cities: DataFrame, gaz: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """JOIN-4 (matching blocks, the default of the cascade): the best key by the reference's own measure,
    the sequence-matcher ratio with the key as first and the city as second text; on equal scores the
    larger key wins. Only pairs whose longest common subsequence, which no ratio exceeds, reaches the
    cutoff are measured."""
    pairs = candidate_pairs(cities, gaz, cutoff).where(sequence_similarity(F.col("city"), F.col("key")) >= cutoff - 1e-9)
    return _best(pairs.withColumn("score", matching_ratio(F.col("key"), F.col("city"))), cutoff)


def resolve_locations(cities: DataFrame, gaz: DataFrame, fuzzy=fuzzy_tier_ratio, word_boundary: bool = False) -> DataFrame:
    """JOIN-5: exact -> substring -> fuzzy; (city, key, match_tier, lat, lon, iso3)."""
    t1 = exact_tier(cities, gaz).withColumn("match_tier", F.lit("exact"))
    rest1 = cities.join(t1.select("city"), "city", "left_anti")
    t2 = substring_tier(rest1, gaz, word_boundary).withColumn("match_tier", F.lit("substring"))
    rest2 = rest1.join(t2.select("city"), "city", "left_anti")
    t3 = fuzzy(rest2, gaz).select("city", "key").withColumn("match_tier", F.lit("fuzzy"))
    hits = t1.unionByName(t2).unionByName(t3)
    return hits.join(gaz.select("key", "lat", "lon", "iso3"), "key")


def _spread_missing(loc: str) -> Column:
    """The location, or for rows without one of 1,024 keys that are no location."""
    key = F.concat(F.lit("\x00"), (F.monotonically_increasing_id() % 1024).cast("string"))
    return F.when(F.col(loc) != "", F.col(loc)).otherwise(key)


def analyze_locations(df: DataFrame, col: str, gaz: DataFrame, iata: DataFrame, fuzzy=fuzzy_tier_ratio,
                      word_boundary: bool = False) -> DataFrame:
    """Rows + lat, lon, iso3, match_tier ('none' when not found) and
    Mapped_Location (title case of the cleaned text).

    The per-location table has one row per distinct location. It grows with the
    data, so it gets no hint (AQE broadcasts it when its measured size allows,
    and splits a location that holds a large share of the rows). Rows without a
    location get keys of their own, spread evenly, that match nothing.
    """
    cleaned = clean_location(df, col, iata)
    # the distinct locations feed every tier and the anti-joins between them:
    # computed once, so the source is read twice in all (here and for the rows)
    res = resolve_locations(materialize(distinct_locations(cleaned)), gaz, fuzzy, word_boundary)
    res = res.select(F.col("city").alias("__city"), "lat", "lon", "iso3", "match_tier")
    out = cleaned.withColumn("__k", _spread_missing("clean_loc")).join(res, F.col("__k") == F.col("__city"), "left").drop("__k", "__city")
    tier = F.when(F.col("match_tier").isNotNull(), F.col("match_tier")) \
            .when(F.col("clean_loc").isNotNull() & (F.col("clean_loc") != ""), "none")
    return out.withColumns({"match_tier": tier, "Mapped_Location": F.initcap("clean_loc")})


def unmatched_locations(geo: DataFrame) -> DataFrame:
    """JOIN-6: unmatched non-empty locations with their row counts, most first."""
    bad = geo.where(F.col("lat").isNull() & (F.length("Mapped_Location") > 0))
    return bad.groupBy("Mapped_Location").agg(F.count(F.lit(1)).alias("Count")) \
              .orderBy(F.desc("Count"), F.asc("Mapped_Location"))


def location_frequency(geo: DataFrame, loc: str = "Mapped_Location") -> DataFrame:
    """JOIN-9: each row's location frequency, by a grouped count joined back
    (no window holding a whole hot location in one task)."""
    freq = geo.where(F.col(loc).isNotNull()).groupBy(F.col(loc).alias("__l")).agg(F.count(F.lit(1)).alias("Frequency"))
    keyed = geo.withColumn("__k", F.when(F.col(loc) == "", "").otherwise(_spread_missing(loc)))
    return keyed.join(freq, F.col("__k") == F.col("__l"), "left").drop("__k", "__l")


def geo_quality(raw: DataFrame, geo: DataFrame, col: str) -> DataFrame:
    """AGG-15: total rows, mapped rows, unmatched (never below 0) and empty rows."""
    r = raw.agg(F.count(F.lit(1)).alias("total_rows"),
                F.count_if(F.col(col).isNull() | (strip(F.col(col).cast("string")) == "")
                           | (strip(F.col(col).cast("string")) == "nan")).alias("empty"))
    g = geo.agg(F.count_if(F.col("lat").isNotNull()).alias("mapped"),
                F.count_if(F.col("lat").isNull()).alias("no_coords"))
    gv = row_values(g)
    mapped, no_coords = gv["mapped"], gv["no_coords"]
    return r.select("total_rows", mapped.alias("mapped"),
                    F.greatest(no_coords - F.col("empty"), F.lit(0)).alias("unmatched"), "empty")


def top_locations(geo: DataFrame, metric: str, n: int = 10, loc: str = "Mapped_Location") -> DataFrame:
    """AGG-14: mean metric per mapped location, the ``n`` largest."""
    m = geo.where(F.col("lat").isNotNull()).groupBy(loc).agg(F.avg(metric).alias("avg_" + metric))
    return m.orderBy(F.desc_nulls_last("avg_" + metric), F.asc(loc)).limit(n)
