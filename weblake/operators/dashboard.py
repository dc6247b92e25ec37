"""The traffic dashboard of a window [start, end): buckets, totals, peaks and lists.

Entries are counted in three small ways, each in one grouped pass over the columns it needs: visitors by hour, views by minute, and
views by listed value.  All figures are sums over these and are computed in one job; they are as many as the window has hours and days,
and 250 listed values at most, so they are held by the driver, and the parts of a dashboard are local tables.  The counts can also
come from sums that were stored when entries were written (see ``rollup``)."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.params import hour_of, local_date, minute_of
from .search import RequestError

BUFFER = 12 * 3600
#: Listed columns, and how many of their values are listed.
LISTS = {"browsers": ("browser", 50), "systems": ("os", 50), "devices": ("device_type", 50), "urls": ("path_exact", 100)}
#: Columns with few values, which are counted together.
FEW = ("browser", "os", "device_type")


@dataclass(frozen=True)
class Cells:
    """``visits`` (hour, date, ip, n, inside, bytes): views by visitor, all and those inside the window, whose bytes are added up;
    ``minutes`` (minute, n) and ``terms`` (kind, term, n) of the window."""

    visits: DataFrame
    minutes: DataFrame
    terms: DataFrame

    def with_(self, other: Cells) -> Cells:
        """The counts of both; the same cell may be in either."""
        return Cells(*(getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(Cells)))


def check_window(start: int, end: int) -> None:
    if start < 0 or end <= start:
        raise RequestError("the start is before the end")


def base(entries: DataFrame, start: int, end: int) -> DataFrame:
    """The window with twelve hours at either side, only the columns the dashboard reads."""
    check_window(start, end)
    near = (F.col("timestamp") >= start - BUFFER) & (F.col("timestamp") < end + BUFFER)
    return entries.where(near).select("timestamp", "ip", "path_exact", *FEW, "bytes_sent")


def cells(entries: DataFrame, start: int, end: int) -> Cells:
    """The counts of entries."""
    rows, time = base(entries, start, end), F.col("timestamp")
    inside = (time >= start) & (time < end)
    visits = rows.groupBy(hour_of(time).alias("hour"), local_date(time).alias("date"), F.nullif("ip", F.lit("")).alias("ip")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"), F.coalesce(F.sum(F.when(inside, F.col("bytes_sent"))), F.lit(0)).alias("bytes")
    )
    own = rows.where(inside)
    minutes = own.groupBy(minute_of(time).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return Cells(visits, minutes, listed(own.groupBy(*FEW).agg(F.count(F.lit(1)).alias("n")), own.groupBy("path_exact").agg(F.count(F.lit(1)).alias("n"))))


def listed(few: DataFrame, paths: DataFrame) -> DataFrame:
    """(kind, term, n) from counts by ``FEW`` together, and by path."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("term")) for c in FEW)))
    return few.select("n", each.alias("e")).select("e.kind", "e.term", "n").union(paths.select(F.lit("path_exact"), F.col("path_exact"), "n"))


@dataclass(frozen=True)
class Figures:
    """A dashboard's numbers: (uv, pv) by hour and by date, the window's totals, the busiest minute's views, and listed values."""

    hours: dict[int, tuple[int, int]]
    dates: dict[object, tuple[int, int]]
    uv: int
    pv: int
    traffic: int
    peak: int
    lists: dict[str, list[tuple[str, int]]]


def figures(counted: Cells) -> Figures:
    """All figures, in one job."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)

    def part(rows: DataFrame, kind: str, hour: Column | None = None, date: Column | None = None, uv=None, pv=None, size=None) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("part"), none("hour", "long") if hour is None else hour.alias("hour"), none("date", "date") if date is None else date.alias("date"), none("term", "string"),
            none("uv", "long") if uv is None else uv.alias("uv"), none("pv", "long") if pv is None else pv.alias("pv"), none("size", "long") if size is None else size.alias("size"),
        )

    sums = F.count_distinct("ip").alias("uv"), F.sum("n").alias("pv")
    uv, pv = F.col("uv"), F.col("pv")
    whole = counted.visits.where("inside > 0").agg(F.count_distinct("ip").alias("uv"), F.coalesce(F.sum("inside"), F.lit(0)).alias("pv"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "term"))
    top = counted.terms.where("term <> ''").groupBy("kind", "term").agg(F.sum("n").alias("n")).withColumn("_rank", rank).where(F.col("_rank") <= max(n for _, n in LISTS.values()))
    rows = (
        part(counted.visits.groupBy("hour").agg(*sums), "hour", hour=F.col("hour"), uv=uv, pv=pv)
        .union(part(counted.visits.groupBy("date").agg(*sums), "date", date=F.col("date"), uv=uv, pv=pv))
        .union(part(whole, "total", uv=uv, pv=pv, size=F.col("size")))
        .union(part(counted.minutes.groupBy("minute").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("pv")), "peak", pv=pv))
        .union(top.select("kind", none("hour", "long"), none("date", "date"), "term", none("uv", "long"), "n", F.col("_rank").cast("long")))
        .collect()
    )
    by = lambda kind: [r for r in rows if r["part"] == kind]
    total = by("total")[0]
    return Figures(
        {r["hour"]: (r["uv"], r["pv"]) for r in by("hour")},
        {r["date"]: (r["uv"], r["pv"]) for r in by("date")},
        total["uv"],
        total["pv"],
        total["size"],
        by("peak")[0]["pv"],
        {c: [(r["term"], r["pv"]) for r in sorted(by(c), key=lambda r: r["size"])] for c, _ in LISTS.values()},
    )


def _hourly(found: Figures, start: int, end: int, aligned: bool = False) -> list[tuple]:
    first = start - BUFFER
    first -= first % 3600 if aligned else 0
    times = range(first, first + 3600 * -(-(end - start + 24 * 3600) // 3600), 3600)
    return [(t % 86400 // 3600, t, *found.hours.get(t, (0, 0))) for t in times]


def _daily(spark: SparkSession, found: Figures, start: int, end: int) -> list[tuple]:
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    moment, days = datetime.fromtimestamp(start, zone), {}
    while moment.timestamp() < end:
        midnight = datetime(moment.year, moment.month, moment.day, tzinfo=zone)
        days[midnight.date()] = int(midnight.timestamp())
        moment += timedelta(days=1)
    return [(d, t, *found.dates.get(d, (0, 0))) for d, t in days.items()]


def hourly(spark: SparkSession, found: Figures, start: int, end: int, aligned: bool = False) -> DataFrame:
    """(hour, timestamp, uv, pv): buckets of an hour from ``start`` - 12 h; those that no row falls in have 0.  Buckets that do
    not begin on a full hour stay empty unless ``aligned``."""
    return spark.createDataFrame(_hourly(found, start, end, aligned), "hour int, timestamp long, uv long, pv long")


def daily(spark: SparkSession, found: Figures, start: int, end: int) -> DataFrame:
    """(date, timestamp, uv, pv): the days, in the session's zone, of start, start + 1 day and so on before ``end``; each counts
    all rows of its date."""
    return spark.createDataFrame(_daily(spark, found, start, end), "date date, timestamp long, uv long, pv long")


def totals(spark: SparkSession, found: Figures) -> DataFrame:
    """(pv, uv, traffic) of the window."""
    return spark.createDataFrame([(found.pv, found.uv, found.traffic)], "pv long, uv long, traffic long")


def peak_minute(spark: SparkSession, found: Figures) -> DataFrame:
    """The most views of a minute."""
    return spark.createDataFrame([(found.peak,)], "peak long")


def top(spark: SparkSession, found: Figures, column: str, size: int = 50) -> DataFrame:
    """(term, count, percent): the most frequent values of a listed column, ties by value; percentages are of all views."""
    rows = [(term, n, 100.0 * n / found.pv) for term, n in found.lists[column][:size]]
    return spark.createDataFrame(rows, "term string, count long, percent double")


def summary(spark: SparkSession, found: Figures, start: int, end: int) -> DataFrame:
    """One row: totals, daily averages, the peak hour (the earliest of the busiest, of the buckets), average and peak rate."""
    hours, days = _hourly(found, start, end), _daily(spark, found, start, end)
    busiest = max(hours, key=lambda h: (h[3], -h[1]))
    row = (
        found.uv, found.pv, found.traffic, found.uv / len(days) if days else 0.0, sum(d[3] for d in days) / len(days) if days else 0.0,
        busiest[0] if busiest[3] else 0, busiest[3], found.pv / float(end - start), found.peak / 60.0,
    )
    return spark.createDataFrame([row], "total_uv long, total_pv long, total_traffic long, avg_daily_uv double, avg_daily_pv double, peak_hour int, peak_hour_traffic long, avg_qps double, peak_qps double")


def parts(spark: SparkSession, found: Figures, start: int, end: int) -> dict[str, DataFrame]:
    """The parts of a dashboard by name; lists and buckets are empty when the window has no views."""
    out = {"hourly": hourly(spark, found, start, end), "daily": daily(spark, found, start, end)}
    out |= {name: top(spark, found, column, size) for name, (column, size) in LISTS.items()}
    return {k: v if found.pv else v.limit(0) for k, v in out.items()} | {"summary": summary(spark, found, start, end)}


def dashboard(spark: SparkSession, entries: DataFrame, start: int, end: int) -> dict[str, DataFrame]:
    """All parts, from the entries themselves."""
    return parts(spark, figures(cells(entries, start, end)), start, end)


def day_hours(spark: SparkSession, entries: DataFrame, last_day_start: int) -> DataFrame:
    """The 48 hours from twelve before a day to twelve after it."""
    end = last_day_start + 86400
    return hourly(spark, figures(cells(entries, last_day_start, end)), last_day_start, end)


def daily_hits(spark: SparkSession, hits: DataFrame, start: int, end: int) -> DataFrame:
    """Days of hits that are at hand already: (date, timestamp, uv, pv), hits outside the window left out."""
    inside = hits.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return daily(spark, figures(cells(inside, start, end)), start, end)
