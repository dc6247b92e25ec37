"""Sums of entries that are stored with each file of the table, for figures that need not read entries again.

A file has, for each of its hours, the views of each visitor and of each listed value; the views of each minute; and, for counts of
distinct values, a sketch of each column.  They are as many as there are visitors and values in an hour, however many views there
are.  Files never change and their sums go with them, so the sums of the table's files are always those of its rows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import hour_of, local_date, minute_of
from .dashboard import BUFFER, FEW, Cells, cells, check_window, listed

#: Columns with a sketch of their distinct values, and the binary logarithm of a sketch's registers.
SKETCHED = ("ip", "path_exact", "user_agent", "referer")
REGISTERS = 12
#: Of the estimate, the standard error of a sketch: the square root of the natural logarithm of 2, over that of its registers.
STANDARD_ERROR = 0.8326 / 2 ** (REGISTERS / 2)
_SUMS = "file string, kind string, hour long, term string, os string, device_type string, n long, bytes long, sketch binary"
_NAMES = [c.split()[0] for c in _SUMS.split(", ")]


def _as_sums(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    types = dict(c.split() for c in _SUMS.split(", "))
    given = {"file": F.col("_file"), "kind": F.lit(kind)} | columns
    return rows.select(*((given[c] if c in given else F.lit(None)).cast(types[c]).alias(c) for c in _NAMES))


def write(rows: DataFrame, folder: str) -> None:
    """The sums of the files that ``rows`` (with their ``_file``) lie in."""
    has, count, hour = set(rows.columns), F.count(F.lit(1)).alias("n"), hour_of(F.col("timestamp")).alias("hour")
    time, n = F.col("hour"), F.col("n")
    parts = [_as_sums(rows.groupBy("_file", minute_of(F.col("timestamp")).alias("hour")).agg(count), "minute", hour=time, n=n)]
    if {"ip", "bytes_sent"} <= has:
        visits = rows.groupBy("_file", hour, F.nullif("ip", F.lit("")).alias("ip")).agg(count, F.sum("bytes_sent").alias("bytes"))
        parts.append(_as_sums(visits, "visit", hour=time, term=F.col("ip"), n=n, bytes=F.col("bytes")))
    if set(FEW) <= has:
        parts.append(_as_sums(rows.groupBy("_file", hour, *FEW).agg(count), "few", hour=time, term=F.col("browser"), os=F.col("os"), device_type=F.col("device_type"), n=n))
    if "path_exact" in has:
        parts.append(_as_sums(rows.groupBy("_file", hour, "path_exact").agg(count), "path", hour=time, term=F.col("path_exact"), n=n))
    sketched = [c for c in SKETCHED if c in has]
    if sketched:
        held = rows.groupBy("_file").agg(*(F.hll_sketch_agg(F.nullif(c, F.lit("")), REGISTERS).alias(c) for c in sketched))
        parts += [_as_sums(held, "sketch", term=F.lit(c), sketch=F.col(c)) for c in sketched]
    reduce(DataFrame.union, parts).sortWithinPartitions("kind", "hour").write.parquet(folder)


def stored(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The sums of these files (manifest rows)."""
    changes = sorted(r["change"] for r in files.select("change").distinct().collect())
    if not changes:
        return spark.createDataFrame([], _SUMS)
    return spark.read.schema(_SUMS).parquet(*(f"{folder}/{c}" for c in changes)).join(files.select("file"), "file", "left_semi")


def whole_hours(spark: SparkSession, start: int, end: int) -> bool:
    """Whether the hours of the session's zone begin with those of UTC, so that an hour has one date."""
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    return all(datetime.fromtimestamp(t, zone).utcoffset().total_seconds() % 3600 == 0 for t in (start - BUFFER, start, end, end + BUFFER))


def cut_hours(start: int, end: int) -> list[int]:
    """The hours that the window, or what is read around it, begins or ends in."""
    return sorted({t - t % 3600 for t in (start - BUFFER, start, end, end + BUFFER) if t % 3600})


def window_cells(sums: DataFrame, entries: DataFrame, start: int, end: int) -> Cells:
    """A dashboard's counts from stored sums; hours that are counted in part only are read from the entries."""
    check_window(start, end)
    cut = cut_hours(start, end)
    near = sums.where((F.col("hour") >= start - BUFFER) & (F.col("hour") < end + BUFFER))
    hour = F.when(F.col("kind") == "minute", hour_of(F.col("hour"))).otherwise(F.col("hour"))
    near = near.where(~hour.isin(cut)) if cut else near
    inside = (F.col("hour") >= start) & (F.col("hour") < end)
    visits = near.where("kind = 'visit'").select(
        "hour", local_date(F.col("hour")).alias("date"), F.col("term").alias("ip"), "n", F.when(inside, F.col("n")).otherwise(0).alias("inside"), F.when(inside, F.coalesce("bytes", F.lit(0))).otherwise(0).alias("bytes")
    )
    own = near.where(inside)
    minutes = own.where("kind = 'minute'").select(F.col("hour").alias("minute"), "n")
    few = own.where("kind = 'few'").groupBy(F.col("term").alias("browser"), "os", "device_type").agg(F.sum("n").alias("n"))
    paths = own.where("kind = 'path'").groupBy(F.col("term").alias("path_exact")).agg(F.sum("n").alias("n"))
    counted = Cells(visits, minutes, listed(few, paths))
    return counted.with_(cells(entries.where(hour_of(F.col("timestamp")).isin(cut)), start, end)) if cut else counted


def distinct(sums: DataFrame, column: str) -> DataFrame:
    """One row, ``n``: about how many distinct values the files' rows have.  The error is of ``STANDARD_ERROR``, whatever the number
    of sketches that are merged: the union of sketches is the sketch of the union."""
    merged = F.hll_union_agg("sketch", True)
    return sums.where((F.col("kind") == "sketch") & (F.col("term") == column)).agg(F.coalesce(F.hll_sketch_estimate(merged), F.lit(0)).alias("n"))
