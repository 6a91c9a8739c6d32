"""Summary and event tables from CSV, and what their headers must hold."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.functions import exprs as X
from nightframe.sources import files

# Required headers.
SUMMARY = ("Date", "Total Time", "AHI", "Median EPAP")
DETAILS = ("Event", "DateTime", "Data/Duration")


class MissingColumns(ValueError):
    """Names the required columns that a table lacks."""

    def __init__(self, kind: str, missing: list[str]):
        super().__init__(f"the {kind} table lacks {', '.join(missing)}")
        self.missing = missing


def validate_headers(columns: list[str], kind: str) -> None:
    """``kind`` is summary or details; names have to match exactly."""
    missing = [c for c in (SUMMARY if kind == "summary" else DETAILS) if c not in columns]
    if missing:
        raise MissingColumns(kind, missing)


def classify(spark: SparkSession, path: str) -> str:
    """session for JSON, details where the first line speaks of events, else summary."""
    if path.lower().endswith(".json"):
        return "session"
    first = spark.read.text(path).limit(1).collect()
    return "details" if first and re.search("event", first[0][0], re.IGNORECASE) else "summary"


def read_csv(spark: SparkSession, path: str | list[str], typed: bool = False) -> DataFrame:
    """All columns as text, or ``typed`` by their values; every file by its own header. See ``files.read_csv``."""
    return files.read_csv(spark, path, typed).drop("_file")


def read_summary(spark: SparkSession, path: str | list[str], compat_usage: bool = False) -> DataFrame:
    """Nights with typed ``day, usage_hours, ahi, median_epap`` next to all columns of the file.

    ``compat_usage`` reads ``7:30:00`` as 7, as some exports are read elsewhere; the default is 7.5.
    """
    raw = read_csv(spark, path)
    validate_headers(raw.columns, "summary")
    text = F.col("`Total Time`")
    usage = X.leading_number(text) if compat_usage else F.coalesce(X.hours(text), F.lit(None))
    return raw.withColumns({"day": F.try_to_date(F.substring("Date", 1, 10)), "usage_hours": usage, "ahi": X.leading_number("AHI"), "median_epap": X.leading_number("`Median EPAP`")})


#: Further numeric fields of a summary row, where the file has them.
OPTIONAL = {
    "Central AHI": "central_ahi", "Obstructive AHI": "obstructive_ahi", "Hypopnea AHI": "hypopnea_ahi", "Median IPAP": "median_ipap",
    "Mean Pressure": "mean_pressure", "Max Pressure": "max_pressure", "Leak Rate Median": "leak_median",
}


def summary_fields(summary: DataFrame) -> DataFrame:
    extra = [(X.leading_number(f"`{c}`") if c in summary.columns else F.lit(None).cast("double")).alias(n) for c, n in OPTIONAL.items()]
    return summary.select("day", "usage_hours", "ahi", "median_epap", *extra)


def read_details(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``event, ts, value``; rows without a readable time drop out."""
    raw = read_csv(spark, path)
    validate_headers(raw.columns, "details")
    ts = F.coalesce(X.iso_instant("DateTime"), F.col("DateTime").try_cast("timestamp"))
    return raw.select(F.col("Event").alias("event"), ts.alias("ts"), X.number("`Data/Duration`").alias("value")).filter("ts is not null")
