"""User agents: browser, operating system and device from ordered patterns, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first pattern that matches names the browser; the second one's first group is its version.
BROWSERS = (
    ("Bot", "bot|crawler|spider|crawl|slurp|sohu-search|lycos|robozilla|googlebot|bingbot|facebookexternalhit|twitterbot|whatsapp|telegrambot|applebot|linkedinbot|pinterest|yandexbot|baiduspider|360spider|sogou|bytedance|tiktok", None),
    ("WeChat", "micromessenger", r"micromessenger/(\d+\.\d+)"),
    ("QQ", r"qq/(\d+\.\d+)", r"qq/(\d+\.\d+)"),
    ("DingTalk", "dingtalk", r"dingtalk/(\d+\.\d+)"),
    ("Alipay", "alipayclient", r"alipayclient/(\d+\.\d+)"),
    ("TikTok", "musically_", r"musically_(\d+\.\d+)"),
    ("360 Browser", "360se|qihoobrowser", r"360se/(\d+\.\d+)|qihoobrowser/(\d+\.\d+)"),
    ("QQ Browser", "qqbrowser", r"qqbrowser/(\d+\.\d+)"),
    ("UC Browser", "ucbrowser|uc browser", r"ucbrowser/(\d+\.\d+)"),
    ("Sogou Explorer", "se |metasr", r"se (\d+\.\d+)|metasr (\d+\.\d+)"),
    ("Baidu Browser", "baidubrowser|bidubrowser", r"baidubrowser/(\d+\.\d+)|bidubrowser/(\d+\.\d+)"),
    ("Maxthon", "maxthon", r"maxthon/(\d+\.\d+)"),
    ("Samsung Browser", "samsungbrowser", r"samsungbrowser/(\d+\.\d+)"),
    ("Huawei Browser", "huaweibrowser", r"huaweibrowser/(\d+\.\d+)"),
    ("Xiaomi Browser", "mibrowser", r"mibrowser/(\d+\.\d+)"),
    ("Oppo Browser", "oppobrowser", r"oppobrowser/(\d+\.\d+)"),
    ("Vivo Browser", "vivobrowser", r"vivobrowser/(\d+\.\d+)"),
    ("Yandex", "yabrowser", r"yabrowser/(\d+\.\d+)"),
    ("Brave", "brave", r"brave/(\d+\.\d+)"),
    ("Vivaldi", "vivaldi", r"vivaldi/(\d+\.\d+)"),
    ("Edge", "edg/|edge/", r"edg?[e]?/(\d+\.\d+)"),
    ("Internet Explorer", "msie |trident.*rv:", r"msie (\d+\.\d+)|rv:(\d+\.\d+)"),
    ("Opera", "opr/|opera/", r"opr/(\d+\.\d+)|version/(\d+\.\d+)"),
    ("Chrome", "chrome/", r"chrome/(\d+\.\d+)"),
    ("Firefox", "firefox/", r"firefox/(\d+\.\d+)"),
    ("Safari", "safari/", r"version/(\d+\.\d+)"),
    ("NetFront", "netfront", r"netfront/(\d+\.\d+)"),
    ("Konqueror", "konqueror", r"konqueror/(\d+\.\d+)"),
)
# Operating systems, likewise.
SYSTEMS = (
    ("iOS", r"iPhone OS|OS (\d+_\d+)|iPad; OS|iPod.*OS|iPhone.*OS", r"OS (\d+[_\d]*)"),
    ("Android", "android", r"android (\d+\.?\d*\.?\d*)"),
    ("Windows", "windows", r"windows nt (\d+\.?\d*)"),
    ("macOS", "mac os x|macintosh|intel mac", r"mac os x (\d+[_\d]*)"),
    ("Ubuntu", "ubuntu", r"ubuntu[/\s]*(\d+\.?\d*\.?\d*)"),
    ("CentOS", "centos", r"centos[/\s]*(\d+\.?\d*\.?\d*)"),
    ("Red Hat", "red.*hat|rhel", r"red.*hat[/\s]*(\d+\.?\d*\.?\d*)|rhel[/\s]*(\d+\.?\d*\.?\d*)"),
    ("Debian", "debian", r"debian[/\s]*(\d+\.?\d*\.?\d*)"),
    ("Fedora", "fedora", r"fedora[/\s]*(\d+\.?\d*\.?\d*)"),
    ("SUSE", "suse|opensuse", r"suse[/\s]*(\d+\.?\d*\.?\d*)|opensuse[/\s]*(\d+\.?\d*\.?\d*)"),
    ("FreeBSD", "freebsd", r"freebsd (\d+\.?\d*\.?\d*)"),
    ("OpenBSD", "openbsd", r"openbsd (\d+\.?\d*\.?\d*)"),
    ("NetBSD", "netbsd", r"netbsd (\d+\.?\d*\.?\d*)"),
    ("Linux", "linux|x11", None),
    ("Chrome OS", "cros", r"cros (\d+\.?\d*\.?\d*)"),
    ("Windows Phone", "windows phone", r"windows phone (\d+\.?\d*\.?\d*)"),
    ("BlackBerry", "blackberry|bb10", r"blackberry[/\s]*(\d+\.?\d*\.?\d*)|bb10[/\s]*(\d+\.?\d*\.?\d*)"),
    ("Symbian", "symbian|s60", r"symbian[/\s]*(\d+\.?\d*\.?\d*)|s60[/\s]*(\d+\.?\d*\.?\d*)"),
)
# Devices; Desktop where none matches.
DEVICES = (
    ("Bot", "bot|crawler|spider|crawl|slurp|sohu-search|lycos|robozilla|googlebot|bingbot|facebookexternalhit|twitterbot|whatsapp|telegrambot|applebot|linkedinbot|pinterest|yandexbot|baiduspider|360spider|sogou|bytedance|scraper"),
    ("iPhone", "iphone"),
    ("iPad", "ipad"),
    ("iPod", "ipod"),
    ("Apple Watch", "watch.*os"),
    ("Apple TV", "apple.*tv"),
    ("PlayStation", "playstation|ps[345]|psvita"),
    ("Xbox", "xbox"),
    ("Nintendo", "nintendo|wii|3ds|switch"),
    ("Smart TV", "smart.*tv|smarttv|hbbtv|netcast|roku|webos|tizen|android.*tv"),
    ("Chromecast", "chromecast"),
    ("Tablet", "tablet|ipad|kindle|nook|playbook|touchpad|xoom|sch-i800|gt-p1000|sgh-t849|shw-m180s|a1_07|bntv250a|mid7015|mid7012"),
    ("Mobile", "mobile|phone|iphone|android.*mobile|blackberry|bb10|windows phone|iemobile|palm|webos|symbian|maemo|fennec|minimo|pda|pocket|psp|smartphone|mobileexplorer|htc|samsung|lg|motorola|sony|nokia|huawei|xiaomi|oppo|vivo|oneplus"),
    ("Wearable", "watch|wearable|fitbit|gear"),
    ("IoT Device", "alexa|echo|iot|raspberry|arduino"),
    ("E-Reader", "kindle|nook|kobo|pocketbook"),
)
# Browsers that get a three-part version where no two-part one was found.
LONG_VERSIONS = {"WeChat": r"micromessenger/(\d+\.\d+\.\d+)", "QQ": r"qq/(\d+\.\d+\.\d+)", "Alipay": r"alipayclient/(\d+\.\d+\.\d+)"}


def _any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def _first(agent: Column, table: tuple, default: str) -> Column:
    hits = [(row[0], agent.rlike(_any_case(row[1]))) for row in table]
    return reduce(lambda chain, hit: chain.when(hit[1], F.lit(hit[0])), hits[1:], F.when(hits[0][1], F.lit(hits[0][0]))).otherwise(F.lit(default))


def _version(agent: Column, name: Column, table: tuple) -> Column:
    chain = F
    for label, _, pattern in table:
        if pattern:
            chain = chain.when(name == label, F.regexp_extract(agent, _any_case(pattern), 1))
    return chain.otherwise(F.lit(""))


def user_agent(agent: Column) -> Column:
    """A struct of browser, browser_version, os, os_version and device_type; Unknown, Unknown and Desktop for no agent."""
    absent = agent.isNull() | agent.isin("", "-")
    low = F.lower(agent)
    browser, system, device = _first(agent, BROWSERS, "Unknown"), _first(agent, SYSTEMS, "Unknown"), _first(agent, DEVICES, "Desktop")
    version = _version(agent, browser, BROWSERS)
    chain = F
    for label, pattern in LONG_VERSIONS.items():
        chain = chain.when(browser == label, F.regexp_extract(agent, _any_case(pattern), 1))
    version = F.when(version != "", version).otherwise(chain.otherwise(F.lit("")))
    android_only = low.contains("android") & ~low.contains("mobile")
    device = (
        F.when((device == "Mobile") & (low.contains("ipad") | low.contains("tablet") | android_only), F.lit("Tablet"))
        .when((device == "Desktop") & android_only, F.lit("Tablet"))
        .otherwise(device)
    )
    renamed = F.when(low.contains("edg/"), "Edge").when(low.contains("opr/"), "Opera").when(low.contains("samsungbrowser"), "Samsung Browser").otherwise("Chrome")
    browser_name = F.when(browser == "Chrome", renamed).otherwise(browser)
    system_version = F.regexp_replace(F.translate(_version(agent, system, SYSTEMS), "_", "."), r"(\.0)+$", "")
    known = lambda value, none: F.when(absent, F.lit(none)).otherwise(value)
    return F.struct(
        known(browser_name, "Unknown").alias("browser"), known(version, "").alias("browser_version"), known(system, "Unknown").alias("os"), known(system_version, "").alias("os_version"), known(device, "Desktop").alias("device_type")
    )


def is_bot(agent: Column) -> Column:
    info = user_agent(agent)
    return (info["browser"] == "Bot") | (info["device_type"] == "Bot")


def is_mobile(agent: Column) -> Column:
    return user_agent(agent)["device_type"].isin("Mobile", "iPhone")


def is_tablet(agent: Column) -> Column:
    return user_agent(agent)["device_type"].isin("Tablet", "iPad")


def simple_device(agent: Column) -> Column:
    """Mobile, Tablet, Bot or Desktop."""
    device = user_agent(agent)["device_type"]
    return F.when(device.isin("iPhone", "Mobile"), "Mobile").when(device.isin("iPad", "Tablet"), "Tablet").when(device == "Bot", "Bot").otherwise("Desktop")


def with_user_agent(df, agent_col: str = "user_agent", parser=user_agent):
    """``df`` with the five columns, classified once for each distinct agent and joined back; ``parser`` gives the struct of
    ``user_agent`` from a column."""
    agents = df.select(agent_col).where(F.col(agent_col).isNotNull()).distinct().withColumn("_ua", parser(F.col(agent_col))).select(agent_col, "_ua.*")
    unknown = lambda c: F.when(F.col(c) != "Unknown", F.col(c))
    agents = agents.withColumns({"browser": unknown("browser"), "os": unknown("os")} | {c: F.nullif(F.col(c), F.lit("")) for c in ("browser_version", "os_version")})
    return df.join(agents, agent_col, "left")
