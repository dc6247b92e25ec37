"""``entries`` from the driver's ``events`` table: a deterministic web log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions.useragent import with_user_agent
from .operators.geography import locate

#: Agents by a rule: what they say of their system and their browser, and what they are: browser, system, its version, device.
_KINDS = (
    ("Windows NT 6.3", "Chrome", "Chrome", "Windows", "6.3", "Desktop"),
    ("X11; Fedora; Linux", "Firefox", "Firefox", "Fedora", None, "Desktop"),
    ("iPhone OS 16_3", "UCBrowser", "UC Browser", "iOS", "16.3", "iPhone"),
    ("iPad; OS 15_7", "YaBrowser", "Yandex", "iOS", "15.7", "iPad"),
    ("Android 12; Slate", "Vivaldi", "Vivaldi", "Android", "12", "Tablet"),
    ("Windows NT 10.0", "Edg", "Edge", "Windows", "10", "Desktop"),
)
AGENTS = (*(f"Sample/{i}.0 ({system}) {name}/{20 + i}.{i}.7" for i, (system, name, *_) in enumerate(_KINDS)), "ExampleCrawler/4.2 (+https://crawl.example/about)", "-")
#: What each agent is: browser, its version, system, its version, device.
KNOWN = (*((browser, f"{20 + i}.{i}", *rest) for i, (_, _, browser, *rest) in enumerate(_KINDS)), ("Bot", None, None, None, "Bot"), (None, None, None, None, "Desktop"))
#: Ranges of user numbers with a place: country, province, city, id, latitude, longitude, first and second subdivision.
PLACES = (
    (0, 19, "US", "California", "San Jose", 5392171, 37.34, -121.89, "CA", None),
    (20, 39, "FR", "Ile-de-France", "Paris", 2988507, 48.86, 2.35, "IDF", "75"),
    (40, 59, "FR", "Auvergne-Rhone-Alpes", "Lyon", 2996944, 45.75, 4.85, "ARA", "69"),
    (60, 79, "DE", "Berlin", "Berlin", 2950159, 52.52, 13.41, "BE", None),
    (80, 99, "HK", "Hong Kong", "Hong Kong", 1819729, 22.28, 114.17, None, None),
    (100, 119, "CN", "Guangdong", "Shenzhen", 1795565, 22.55, 114.07, "GD", "4403"),
)


def geo_ranges(spark: SparkSession) -> DataFrame:
    """The places as ranges of addresses; users from 120 on have none."""
    rows = [(geo.address_key(f"10.0.0.{lo}"), geo.address_key(f"10.0.0.{hi}"), *rest) for lo, hi, *rest in PLACES]
    return spark.createDataFrame(rows, "lo string, hi string, region_code string, province string, city string, city_id long, latitude double, longitude double, sub1_iso string, sub2_iso string")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the fields that a server would log."""
    agents = F.array(*map(F.lit, AGENTS))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")).withColumn("timestamp", F.unix_timestamp("ts"))
    kind, k, site = F.col("event_type"), F.col("k"), F.when(F.col("user_id") % 2 == 0, "shop").otherwise("blog")
    main = F.concat(F.lit("/var/log/web/"), site, F.lit(".access.log"))
    day = F.dayofmonth("ts")
    return e.select(
        F.concat(F.lit("e-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        "timestamp",
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip"),
        F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), kind, F.lit("/"), k.cast("string")).alias("path"),
        F.lit("HTTP/1.1").alias("protocol"),
        F.when(kind == "error", F.when(k % 2 == 0, 500).otherwise(404)).when(kind == "signup", 201).when(kind == "click", 302).otherwise(200).alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("bytes_sent"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("https://example.com/from/"), kind)).alias("referer"),
        F.element_at(agents, (F.col("user_id") % len(AGENTS) + 1).cast("int")).alias("user_agent"),
        F.when(k % 3 == 0, F.nullif(k / 1000.0, F.lit(0.0))).alias("request_time"),
        main.alias("main_log_path"),
        F.when(day >= 29, main).when(day >= 27, F.concat(main, F.lit(".1"))).otherwise(F.concat(main, F.lit("-"), F.date_format("ts", "yyyyMMdd"), F.lit(".gz"))).alias("file_path"),
    )


def raw_line() -> F.Column:
    """The combined log line of an event."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("-")), F.lit('"'))
    return F.concat_ws(
        " ",
        "ip",
        F.lit("- -"),
        F.concat(F.lit("["), F.date_format(F.timestamp_seconds("timestamp"), "dd/MMM/yyyy:HH:mm:ss Z"), F.lit("]")),
        F.concat(F.lit('"'), F.concat_ws(" ", "method", "path", "protocol"), F.lit('"')),
        F.col("status").cast("string"),
        F.col("bytes_sent").cast("string"),
        quoted("referer"),
        quoted("user_agent"),
        F.format_string("%.3f", "request_time"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``entries`` table; error events have a level."""
    e = events(spark, sf_dir).withColumn("raw", raw_line()).withColumn("path_exact", F.col("path")).withColumn("level", F.when(F.col("path").startswith("/error/"), F.when(F.col("status") == 500, "error").otherwise("warn"))).withColumn("upstream_time", F.lit(None).cast("double"))
    return locate(with_user_agent(e), geo_ranges(spark))


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error events as lines of an error log."""
    e = events(spark, sf_dir).where("path like '/error/%'")
    level = F.when(F.col("status") == 500, "error").otherwise("warn")
    number = F.substring("id", 3, 12).cast("long")
    raw = F.concat(
        F.date_format(F.timestamp_seconds("timestamp"), "yyyy/MM/dd HH:mm:ss"), F.lit(" ["), level, F.lit("] 12#"), (number % 7).cast("string"), F.lit(": *"), number.cast("string"), F.lit(" no handler for "), F.col("path"),
        F.lit(", client: "), F.col("ip"), F.lit(', server: example.com, request: "'), F.concat_ws(" ", "method", "path", "protocol"), F.lit('", host: "example.com"'), F.when(F.col("referer").isNotNull(), F.concat(F.lit(', referrer: "'), "referer", F.lit(', x"'))).otherwise(""),
    )
    return e.select("id", raw.alias("raw"), "main_log_path")


# --- the same in DuckDB -------------------------------------------------------------------------------------------


def _values(rows: tuple) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _places() -> tuple:
    rows = []
    for lo, hi, country, province, city, number, lat, lon, one, two in PLACES:
        code = "CN" if country in geo.CHINESE else country
        sub1 = f"CN-{country}" if country in geo.CHINESE else one and f"{country}-{one}"
        sub2 = None if country in geo.CHINESE else two and f"{country}-{two}"
        rows.append((lo, hi, code, province, city, number, sub1, sub2, f"{code}|{city}|{lat:.2f}|{lon:.2f}|{number}"))
    return tuple(rows)


ENTRIES_SQL = rf"""agents(n, user_agent, browser, browser_version, os, os_version, device_type) AS (VALUES {_values(tuple((i, a, *k) for i, (a, k) in enumerate(zip(AGENTS, KNOWN))))}),
places(lo, hi, region_code, province, city, city_id, sub1, sub2, city_point) AS (VALUES {_values(_places())}),
logged AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CASE WHEN user_id % 2 = 0 THEN '/var/log/web/shop.access.log' ELSE '/var/log/web/blog.access.log' END AS main_log_path FROM events
),
entries AS (
  SELECT 'e-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, timestamp, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method, '/' || event_type || '/' || k AS path, '/' || event_type || '/' || k AS path_exact, 'HTTP/1.1' AS protocol,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 404 END WHEN event_type = 'signup' THEN 201 WHEN event_type = 'click' THEN 302 ELSE 200 END AS status,
    CAST(round(value * 100) AS BIGINT) AS bytes_sent, CASE WHEN user_id % 3 = 0 THEN 'https://example.com/from/' || event_type END AS referer, a.user_agent, a.browser, a.browser_version, a.os, a.os_version, a.device_type,
    CASE WHEN k % 3 = 0 AND k > 0 THEN k / 1000.0::DOUBLE END AS request_time, NULL::DOUBLE AS upstream_time, main_log_path,
    CASE WHEN day(ts) >= 29 THEN main_log_path WHEN day(ts) >= 27 THEN main_log_path || '.1' ELSE main_log_path || '-' || strftime(ts, '%Y%m%d') || '.gz' END AS file_path,
    p.region_code, p.province, p.city, p.city_id, p.sub1, p.sub2, p.city_point, CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'warn' END END AS level
  FROM logged JOIN agents a ON user_id % {len(AGENTS)} = a.n LEFT JOIN places p ON user_id BETWEEN p.lo AND p.hi
)"""
