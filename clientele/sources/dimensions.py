"""Reference dimension tables shipped with the package (gazetteer, airport codes).

They are small, fixed tables (about a hundred rows each), built on the driver
and broadcast to every join that uses them.
"""

from __future__ import annotations

import csv
import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

DATA_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data")


@lru_cache(maxsize=None)
def _rows(name: str) -> tuple:
    with open(os.path.join(DATA_DIR, name), newline="", encoding="utf-8") as f:
        return tuple(csv.DictReader(f))


def gazetteer_rows() -> list[tuple]:
    return [(int(r["ord"]), r["key"], float(r["lat"]), float(r["lon"]), r["iso3"]) for r in _rows("gazetteer.csv")]


def iata_rows() -> list[tuple]:
    return [(r["code"], r["city"]) for r in _rows("iata.csv")]


def gazetteer(spark: SparkSession) -> DataFrame:
    """(ord int, key string, lat double, lon double, iso3 string); ``ord`` is lookup order."""
    return spark.createDataFrame(gazetteer_rows(), "ord int, key string, lat double, lon double, iso3 string")


def iata(spark: SparkSession) -> DataFrame:
    """(code string, city string): three-letter airport code -> city name."""
    return spark.createDataFrame(iata_rows(), "code string, city string")
