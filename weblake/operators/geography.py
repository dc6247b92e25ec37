"""Places of addresses, and distributions over countries, regions and cities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shipping import ship

# Networks kept for documentation.
DOCUMENTATION = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32")
#: A range is found by the blocks it lies in, of three sizes: the first digits of an address's key that a block has, for IPv4 and
#: other addresses.
_SIZES = ((28, 26, 24), (8, 4, 0))
#: Ranges of more blocks go to the next size.
_MOST_BLOCKS = 256


def blocks_of(lo: str, hi: str) -> list[str]:
    """The blocks of a range."""
    four = lo.startswith(geo.MAPPED)
    base = len(geo.MAPPED) if four else 0
    for digits in _SIZES[0 if four else 1]:
        a, b = (int(key[base:digits] or "0", 16) for key in (lo, hi))
        if b - a < _MOST_BLOCKS:
            break
    width = digits - base
    return [f"{digits}/{lo[:base]}{i:0{width}x}" if width else f"{digits}/{lo[:base]}" for i in range(a, b + 1)]


def blocks_at(key: str) -> list[str]:
    """The blocks that an address lies in."""
    return [f"{digits}/{key[:digits]}" for digits in _SIZES[0 if key.startswith(geo.MAPPED) else 1]]


def _addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(a, k) for a in batch.column(0).to_pylist() if (k := geo.address_key(a))]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([k for _, k in found], pa.string()), pa.array([blocks_at(k) for _, k in found], pa.list_(pa.string()))], ["_ip", "_key", "_blocks"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [blocks_of(lo, hi) for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist())]
        yield batch.append_column("_blocks", pa.array(at, pa.list_(pa.string())))


def _networks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [geo.network_keys(c) or (None, None) for c in batch.column("cidr").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(c for c, n in zip(batch.columns, batch.schema.names) if n != "cidr")], ["lo", "hi", *(n for n in batch.schema.names if n != "cidr")])


def ranges_of(networks: DataFrame) -> DataFrame:
    """Ranges (lo, hi and the other columns) of networks named by ``cidr``; what is no network is left out."""
    ship(networks.sparkSession)
    rest = [f for f in networks.schema if f.name != "cidr"]
    schema = ", ".join(["lo string", "hi string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)])
    return networks.mapInArrow(_networks, schema).where("lo is not null")


def lookup(addresses: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """(_ip, _place) of distinct addresses (_ip): the columns of the narrowest range (``lo``, ``hi``: keys of addresses) that has
    the address; networks lie inside each other or apart, so it is the one with the longest prefix.  An equality of blocks finds
    the ranges, so Spark may pick any join."""
    ship(addresses.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ip_ranges.schema)
    asked = addresses.select("_ip").mapInArrow(_addressed, "_ip string, _key string, _blocks array<string>").select("_ip", "_key", F.explode("_blocks").alias("_block"))
    ranges = ip_ranges.mapInArrow(_spread, f"{fields}, _blocks array<string>").select("lo", "hi", F.struct(*(c for c in ip_ranges.columns if c not in ("lo", "hi"))).alias("_row"), F.explode("_blocks").alias("_block"))
    found = asked.join(ranges, "_block").where(F.col("_key").between(F.col("lo"), F.col("hi")))
    narrowest = F.struct(F.translate("lo", "0123456789abcdef", "fedcba9876543210"), "hi")
    return found.groupBy("_ip").agg(F.min_by("_row", narrowest).alias("_place"))


def locate(df: DataFrame, ip_ranges: DataFrame, country_ranges: DataFrame | None = None, ip_col: str = "ip") -> DataFrame:
    """``df`` with the place of its address, null where no range has it.  A row of ``country_ranges`` (lo, hi, region_code)
    names the country before that of ``ip_ranges`` does.  Distinct addresses are looked up by block, then joined back: Spark picks
    the joins by size."""
    addresses = df.select(F.col(ip_col).alias("_ip")).distinct()
    found = lookup(addresses, ip_ranges)
    own = F.col("_place.region_code")
    code = own
    if country_ranges is not None:
        countries = lookup(addresses, country_ranges).select(F.col("_ip").alias("_of"), F.col("_place.region_code").alias("_country"))
        found = found.join(countries, found["_ip"] == countries["_of"], "full").withColumn("_ip", F.coalesce("_ip", "_of"))
        code = F.coalesce(F.nullif(F.col("_country"), F.lit("")), own)
    base = F.coalesce(F.nullif(own, F.lit("")), code)
    country = geo.collapse(code, F.lit(None), F.lit(None))[0]
    _, sub1, sub2 = geo.collapse(base, geo.subdivision_code(base, F.col("_place.sub1_iso")), geo.subdivision_code(base, F.col("_place.sub2_iso")))
    point = geo.city_point(country, F.nullif(F.col("_place.city"), F.lit("")), F.col("_place.latitude"), F.col("_place.longitude"), F.col("_place.city_id"))
    placed = found.select("_ip", country.alias("region_code"), "_place.province", "_place.city", "_place.city_id", sub1.alias("sub1"), sub2.alias("sub2"), point.alias("city_point"))
    return df.join(placed, df[ip_col] == placed["_ip"], "left").drop("_ip")


def documentation_places(spark: SparkSession, places: list[tuple], networks: tuple[str, ...] = DOCUMENTATION) -> DataFrame:
    """Ranges for a demonstration: each block of 16 (IPv6: 2**16 times as many as a group has) addresses of the documentation
    networks gets one of the ``places`` (region_code, province, city, city_id, latitude, longitude, sub1_iso, sub2_iso) by a hash of the
    block.  Other addresses have none."""
    rows = []
    for network in networks:
        lo, _ = geo.network_keys(network)
        # A block is a network's first digits and one more: the last but one of an IPv4 address, the ninth of another.
        first = lo[: 30 if lo.startswith(geo.MAPPED) else 8]
        for digit in "0123456789abcdef":
            block = first + digit
            rows.append((block.ljust(32, "0"), block.ljust(32, "f"), *places[zlib.crc32(block.encode()) % len(places)]))
    return spark.createDataFrame(rows, "lo string, hi string, region_code string, province string, city string, city_id long, latitude double, longitude double, sub1_iso string, sub2_iso string")


def _groups(entries: DataFrame, column: str) -> DataFrame:
    return entries.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("value"))


def _first(groups: DataFrame, limit: int) -> DataFrame:
    return groups.orderBy(F.desc("value"), "code").limit(limit)


def _counted(entries: DataFrame, column: str, limit: int) -> DataFrame:
    return _first(_groups(entries, column), limit)


def _shared(groups: DataFrame, limit: int) -> DataFrame:
    """The first groups with their percentage of all: the total is one row, so it is broadcast, and Spark counts once for both."""
    total = groups.agg(F.sum("value").alias("total"))
    return _first(groups, limit).crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("value") / F.col("total")).drop("total")


def countries(entries: DataFrame, limit: int = 300) -> DataFrame:
    """(code, value): countries by count."""
    return _counted(entries, "region_code", limit)


def world_map(entries: DataFrame) -> DataFrame:
    """Countries with their percentage of what is listed."""
    return countries(entries).withColumn("percent", 100.0 * F.col("value") / F.sum("value").over(Window.partitionBy()))


def provinces(entries: DataFrame, country: str, limit: int = 100) -> DataFrame:
    return _counted(entries.where(F.col("region_code") == country), "province", limit)


def cities(entries: DataFrame, province: str, limit: int = 100) -> DataFrame:
    return _counted(entries.where(F.col("province") == province), "city", limit)


def top_countries(entries: DataFrame, limit: int = 20) -> DataFrame:
    """Countries with their percentage of all located entries."""
    return _shared(_groups(entries, "region_code"), limit).orderBy(F.desc("value"), "code")


def region_shares(entries: DataFrame, country: str) -> DataFrame:
    """(code, level, value, percent) of a country's first and second subdivisions; percentages are of all its entries."""
    own = entries.where(F.col("region_code") == country)
    levels = own.select(F.explode(F.array(F.struct(F.col("sub1").alias("code"), F.lit(1).alias("level")), F.struct(F.col("sub2").alias("code"), F.lit(2).alias("level")))).alias("s")).select("s.*").where("code is not null")
    counted = levels.groupBy("code").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("value"))
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("code", "level", "value", (100.0 * F.col("value") / F.col("total")).alias("percent")).orderBy(F.desc("value"), "code")


def city_hotspots(entries: DataFrame, limit: int = 500, country: str | None = None) -> DataFrame:
    """The most frequent cities with their place; percentages are of all placed entries, and keys that cannot be read take a
    place in the list but are not returned."""
    own = entries if country is None else entries.where(F.col("region_code") == country)
    read = _shared(_groups(own, "city_point"), min(limit, 2000)).withColumn("p", geo.parse_city_point(F.col("code"))).where("p is not null")
    return read.select("p.country", "p.city", "p.latitude", "p.longitude", "p.city_id", "value", "percent")
