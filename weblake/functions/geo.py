"""Places: city keys, subdivision codes, labels, and keys of addresses and networks."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regions that count as one country.
CHINESE = ("HK", "MO", "TW")


#: What the keys of IPv4 addresses begin with.
MAPPED = "0" * 20 + "ffff"


def ip_number(ip: Column) -> Column:
    """The number of an IPv4 address, null for anything else."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long")
    return F.when(ip.rlike(r"^(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def address_key(address: str | None) -> str | None:
    """32 hexadecimal digits of an address, IPv4 ones as mapped into IPv6, so that all sort by their number; None for anything
    that is no address."""
    try:
        found = ipaddress.ip_address(address or "")
    except ValueError:
        return None
    return f"{int(found):032x}" if found.version == 6 else f"{MAPPED}{int(found):08x}"


def network_keys(cidr: str | None) -> tuple[str, str] | None:
    """The keys of the first and last address of a network such as 10.0.0.0/8 or 2001:db8::/32; None for anything else."""
    try:
        found = ipaddress.ip_network(cidr or "", strict=False)
    except ValueError:
        return None
    return (address_key(str(found[0])), address_key(str(found[-1]))) if "/" in (cidr or "") else None


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def city_point(country: Column, city: Column, latitude: Column, longitude: Column, city_id: Column | None = None) -> Column:
    """``country|city|lat|lon[|id]`` with two decimals; null without a city or a place."""
    clean = F.translate(city, "|", "/")
    parts = [country, clean, F.format_string("%.2f", latitude), F.format_string("%.2f", longitude)]
    key = F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2], F.lit("|"), parts[3])
    return key if city_id is None else F.when(F.coalesce(city_id, F.lit(0)) > 0, F.concat(key, F.lit("|"), city_id.cast("string"))).otherwise(key)


def parse_city_point(key: Column) -> Column:
    """A struct of country, city, latitude, longitude and city_id, null where the key is no city key."""
    p = F.split(key, r"\|")
    lat, lon, number = F.get(p, 2).try_cast("double"), F.get(p, 3).try_cast("double"), F.get(p, 4).try_cast("long")
    good = F.size(p).isin(4, 5) & lat.isNotNull() & lon.isNotNull() & ((F.size(p) == 4) | (number >= 0))
    return F.when(good, F.struct(F.get(p, 0).alias("country"), F.get(p, 1).alias("city"), lat.alias("latitude"), lon.alias("longitude"), F.coalesce(number, F.lit(0)).alias("city_id")))


def subdivision_code(country: Column, code: Column) -> Column:
    """``CC-SUB``, null if either part is missing."""
    return F.concat(F.nullif(country, F.lit("")), F.lit("-"), F.nullif(code, F.lit("")))


def collapse(country: Column, sub1: Column, sub2: Column) -> tuple[Column, Column, Column]:
    """Country, first and second subdivision with the Chinese regions put under one country."""
    inside = country.isin(*CHINESE)
    return F.when(inside, F.lit("CN")).otherwise(country), F.when(inside, F.concat(F.lit("CN-"), country)).otherwise(sub1), F.when(~F.coalesce(inside, F.lit(False)), sub2)


def is_chinese_region(country: Column) -> Column:
    return country.isin("CN", *CHINESE)


def location_label(country: Column, province: Column, city: Column, *custom: Column, chinese: bool = False, country_zh: Column | None = None) -> Column:
    """Country, province, city and custom fields as one label."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = clean(country)
    if chinese:
        first = F.coalesce(clean(country_zh) if country_zh is not None else F.lit(None), F.when(first == "CN", F.lit("中国")), first)
    return F.concat_ws(" " if chinese else ", ", first, clean(province), clean(city), *map(clean, custom))
