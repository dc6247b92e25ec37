"""Entries as a reader sees them: labels, details of error lines, and defaults for what a row lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errorlog import error_entry
from ..functions.geo import location_label

# Columns that an entry of each kind shows, numbers as 0 and texts as empty where it has none.
ACCESS_TEXTS = ("ip", "method", "region_code", "province", "city", "sub1", "path", "protocol", "referer", "user_agent", "browser", "browser_version", "os", "os_version", "device_type", "raw")
ACCESS_NUMBERS = ("timestamp", "city_id", "status", "bytes_sent")
ERROR_TEXTS = ("level", "message", "ip", "server", "request", "method", "path", "upstream", "host", "referer", "raw")
ERROR_NUMBERS = ("timestamp", "pid", "connection")
DETAILS = ("message", "server", "request", "upstream", "host", "pid", "connection")


def error_details(entries: DataFrame) -> DataFrame:
    """Error entries with the fields of their lines; access entries have null there."""
    read = entries.withColumn("_e", F.when(F.col("level").isNotNull(), error_entry(F.col("raw"))))
    return read.select("*", *(F.col(f"_e.{c}").alias(c) for c in DETAILS)).drop("_e")


def completed(entries: DataFrame) -> DataFrame:
    """Entries with defaults instead of nulls, in the columns of their kind; a row is of an error log if it has a level."""
    is_error = F.coalesce(F.col("level"), F.lit("")) != ""
    kinds = {}
    for own, names, empty in ((~is_error, ACCESS_TEXTS, ""), (~is_error, ACCESS_NUMBERS, 0), (is_error, ERROR_TEXTS, ""), (is_error, ERROR_NUMBERS, 0)):
        for c in names:
            if c in entries.columns:
                kinds.setdefault(c, []).append((own, empty))
    return entries.withColumns({c: F.coalesce(F.col(c), *(F.when(own, F.lit(empty)) for own, empty in rules)) for c, rules in kinds.items()})


def labelled(entries: DataFrame, chinese: bool = False) -> DataFrame:
    """Entries with ``ip_location_label``."""
    custom = [F.col(c) for c in ("c1", "c2", "c3", "c4") if c in entries.columns]
    return entries.withColumn("ip_location_label", location_label(F.col("region_code"), F.col("province"), F.col("city"), *custom, chinese=chinese))
