from __future__ import annotations

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from weblake.fixtures import AGENTS, KNOWN
from weblake.functions import access, errorlog, geo, params, rotation, text, useragent
from weblake.operators import geography

PHONE = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Mobile/21B74"
DROID = "Mozilla/5.0 (Linux; Android 13; Pixel 7a) AppleWebKit/537.36 (KHTML, like Gecko)"
CASES = [
    *((agent, tuple("Unknown" if v is None and i in (0, 2) else v or "" for i, v in enumerate(known))) for agent, known in zip(AGENTS, KNOWN)),
    (f"{PHONE} MicroMessenger/8.0.43(0x18002b2f) Language/en", ("WeChat", "8.0", "iOS", "17.1", "iPhone")),
    (f"{PHONE} AlipayClient/10.5.20.6000", ("Alipay", "10.5", "iOS", "17.1", "iPhone")),
    (f"{DROID} Chrome/119.0.6045.66 Mobile Safari/537.36", ("Chrome", "119.0", "Android", "13", "Mobile")),
    (f"{DROID} Version/4.0 Chrome/100.0.4896.127 UCBrowser/13.4.2.1307 Mobile Safari/537.36", ("UC Browser", "13.4", "Android", "13", "Mobile")),
    (f"{DROID} SamsungBrowser/22.0 Chrome/111.0.5563.116 Mobile Safari/537.36", ("Samsung Browser", "22.0", "Android", "13", "Mobile")),
    ("Opera/9.80 (Windows NT 5.1; U; en) Presto/2.10.289 Version/12.02", ("Opera", "", "Windows", "5.1", "Desktop")),
    ("Mozilla/5.0 (Windows NT 6.2; WOW64; Trident/6.0; rv:10.0) like Gecko", ("Internet Explorer", "", "Windows", "6.2", "Desktop")),
    ("Mozilla/5.0 (PlayStation; PlayStation 5/6.02) AppleWebKit/605.1.15 (KHTML, like Gecko)", ("Unknown", "", "Unknown", "", "PlayStation")),
    ("", ("Unknown", "", "Unknown", "", "Desktop")),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_user_agents(spark):
    frame = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string")
    for r in frame.select("i", useragent.user_agent(F.col("a")).alias("u")).collect():
        assert tuple(r["u"]) == CASES[r["i"]][1]


@pytest.mark.parametrize(
    "line,want",
    [
        ('198.51.100.8 - - [03/Mar/2024:08:15:30 +0200] "GET /shop/cart?item=7 HTTP/2.0" 200 4711 "https://shop.example/" "Tester one"', ("198.51.100.8", 1709446530, "GET", "/shop/cart?item=7", "HTTP/2.0", 200, 4711, "https://shop.example/", "Tester one", None, None)),
        ('2001:db8::9 - ann [03/Mar/2024:08:15:30 +0000] "POST /api HTTP/1.0" 503 88 "-" "T" 1.250 .75', ("2001:db8::9", 1709453730, "POST", "/api", "HTTP/1.0", 503, 88, "-", "T", 1.25, 0.75)),
        ('198.51.100.8 - - [03/Mar/2024:08:15:30 -0130] "MKCOL /dav HTTP/1.1" 207 -', ("198.51.100.8", 1709459130, "MKCOL", "/dav", "HTTP/1.1", 207, 0, None, None, None, None)),
        ('198.51.100.8 - - [2024-03-03 08:15:30] "SING /song HTTP/1.1" 777 12 "r" "u" 0 -', ("198.51.100.8", 1709453730, "", "/song", "HTTP/1.1", 0, 12, "r", "u", None, None)),
        ('198.51.100.8 - - [2024-03-03T08:15:30+01:00] "GET /t HTTP/1.1" 301 12', ("198.51.100.8", 1709450130, "GET", "/t", "HTTP/1.1", 301, 12, None, None, None, None)),
        ('198.51.100.8 - - [03/Mar/2024:08:15:30] "  GET   /gap  " 404 1 "a\x1fb" "u"', ("198.51.100.8", 1709453730, "GET", "/gap", "", 404, 1, "a b", "u", None, None)),
        ('198.51.100.8 - - [yesterday] "GET /d HTTP/1.1" 200 1', ("198.51.100.8", 0, "GET", "/d", "HTTP/1.1", 200, 1, None, None, None, None)),
    ],
)
def test_access_lines(spark, line, want):
    e = one(spark, line, access.access_entry)
    assert (e["ip"], e["timestamp"], e["method"], e["path"], e["protocol"], e["status"], e["bytes_sent"], e["referer"], e["user_agent"], e["request_time"], e["upstream_time"]) == want


def odd_lines(seed: int, n: int):
    """Lines of the common form with a few characters changed, added or left out, many of them at the edges of its fields."""
    rng = random.Random(seed)
    good = lambda: (f'{rng.choice(["10.1.2.3", "::1", "h"])} {rng.choice("-a")} {rng.choice(["-", "b"])} [{rng.randint(1, 31):02d}/{rng.choice(["Jan", "Feb", "Jun", "Dec"])}/{rng.choice([2024, 2023, 1900, 2000, 1969, 9999])}:{rng.randint(0, 23):02d}:{rng.randint(0, 60):02d}:{rng.randint(0, 60):02d} {rng.choice(["+0000", "-0730", "+1400", "+1500", "+0560"])}] '  # noqa: E731
        f'"{rng.choice(["GET", "HEAD", "get", "MKCOL"])} /{rng.choice(["", "a?b=c", "x%20y"])} HTTP/1.1" {rng.choice([200, 404, 600, 99, 100])} {rng.choice(["-", "0", "12", "9" * 18, "9" * 20])} "{rng.choice(["-", "", "http://r/"])}" "{rng.choice(["-", "", "A (b; c) d/1.0", "ü"])}"{rng.choice(["", " null", ' "-"', ' 0.2 "-" "x"', " 0.001", " 1.5 0.25", " - -", " .5", " 1. 2", " 0.000 -", " 1 2 3", " x"])}')
    signs = ' "[]:/-+0123456789.\t\r\x0b\x1faJ'
    for _ in range(n):
        line = list(good())
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(signs), rng.choice(signs)])
        yield "".join(line)


def test_the_common_form_is_read_as_the_pattern_reads_it(spark):
    lines = [*odd_lines(3, 6000), *(f'h - - [{d:02d}/{m}/{y}:00:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "-"' for y in (1600, 1900, 1999, 2000, 2024, 2100) for m in ("Jan", "Feb", "Mar", "Dec") for d in (1, 28, 29, 31))]
    lines += ["", None, "x" * (access.MAX_LINE + 1), " " * 30]
    frame = spark.createDataFrame([(x, 1) for x in lines], "raw string, `odd.name` int")
    rows = access.with_entry(frame, F.lit(7)).select("*", access.access_entry(F.col("raw"), F.lit(7)).alias("b")).collect()
    assert len(rows) == len(lines) and [r["raw"] for r in rows if r["_e"] != r["b"]] == []


def test_bad_access_lines(spark):
    for gone in (None, "", "y" * (access.MAX_LINE + 1)):
        assert one(spark, gone, access.access_entry) is None
    assert one(spark, "no log line has such words in it", access.access_entry)["timestamp"] == 0
    assert one(spark, ' 198.51.100.8 - - [03/Mar/2024:08:15:30 +0000] "GET / HTTP/1.1" 200 1', access.access_entry)["ip"] == ""
    short = one(spark, "198.51.100.8 -", lambda c: access.access_entry(c, F.lit(41)))
    assert (short["ip"], short["timestamp"]) == ("198.51.100.8", 41)


def error_cases(seed: int = 5):
    """Lines built from the grammar, with what they hold: every level, with and without process and connection, every set of context
    keys, values that hold separators or quotes, and values that are empty."""
    rng = random.Random(seed)
    values = {"client": ["192.0.2.4", "fe80::7", "unix:"], "server": ["_", "a.example"], "request": ["GET /p HTTP/1.1", "nonsense", "LOCK /d", ""], "upstream": ["fastcgi://x:9", "http://[::2]/u, v"], "host": ["a.example:81", ""], "referrer": ["https://b.example/?q=1, 2", "x, client: y"]}
    words = ["open()", "failed", "(2:", "gone)", '"quoted, text"', "client:", "a,b", "ünï"]
    for n in range(1, 65):
        keys = [k for i, (k, _) in enumerate(errorlog.CONTEXT) if n % 64 >> i & 1]
        level = errorlog.LEVELS[n % len(errorlog.LEVELS)]
        process, connection = (rng.randint(1, 9999), rng.randint(0, 99)) if n % 3 else None, rng.randint(1, 10**6) if n % 4 else None
        message = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        held = {k: rng.choice(values[k]) for k in keys}
        line = f"2023/{n % 12 + 1:02d}/{n % 28 + 1:02d} {n % 24:02d}:{n % 60:02d}:59 [{level}] " + (f"{process[0]}#{process[1]}: " if process else "") + (f"*{connection} " if connection else "") + message
        line += "".join(f', {k}: "{held[k]}"' if quoted else f", {k}: {held[k]}" for k, quoted in errorlog.CONTEXT if k in held)
        moment = datetime.datetime(2023, n % 12 + 1, n % 28 + 1, n % 24, n % 60, 59, tzinfo=datetime.timezone.utc)
        words_of = held.get("request", "").split()
        method, path = (words_of[0], words_of[1]) if len(words_of) > 1 and words_of[0] in access.METHODS else (None, None)
        want = {"timestamp": int(moment.timestamp()), "level": level, "pid": process[0] if process else 0, "connection": connection or 0, "message": message, "method": method, "path": path}
        yield line, want | {k: held.get(k) or None for k, _ in errorlog.CONTEXT}


def test_error_lines_of_the_grammar(spark):
    cases = list(error_cases())
    frame = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "i int, v string")
    for r in frame.select("i", errorlog.error_entry(F.col("v")).alias("e")).collect():
        line, want = cases[r["i"]]
        assert {k: r["e"][k] for k in want} == want, line


def test_lines_that_are_no_error_lines(spark):
    """Each break of the grammar alone: the time's form and range, the brackets, the level, the length."""
    good = "2023/02/28 23:59:59 [error] 7#8: *9 text"
    broken = [good.replace("/02/28", "/02/30"), good.replace("23:59:59", "24:00:00"), good.replace("/", "-"), good.replace("[error]", "error"), good.replace("error", "fatal"), " " + good, good[:24], "", good + "x" * errorlog.MAX_LINE]
    assert all(one(spark, line, errorlog.error_entry) is None for line in broken) and one(spark, good, errorlog.error_entry)["pid"] == 7
    longest = good + "x" * (errorlog.MAX_LINE - len(good))
    assert len(one(spark, longest, errorlog.error_entry)["message"]) == len(longest) - len(good) + 4


def test_context_keys_out_of_order_belong_to_the_one_before(spark):
    """Keys are read in the order they are written in; one that comes late is left out."""
    e = one(spark, '2023/02/28 23:59:59 [info] text, server: s, client: 192.0.2.4, host: "h"', errorlog.error_entry)
    assert (e["message"], e["server"], e["client"], e["host"]) == ("text", "s", None, None)


def test_levels(spark):
    named = {n: n for n in errorlog.LEVELS} | dict(errorlog.ALIASES)
    for value, want in ({f" {n.upper()} ": v for n, v in named.items()} | {"loud": None, "": None, "error!": None}).items():
        assert one(spark, value, errorlog.level_of) == want == errorlog.level_name(value)


@pytest.mark.parametrize(
    "name,want",
    [("shop.log", "shop.log"), ("shop.log.7", "shop.log"), ("shop.log.31.xz", "shop.log"), ("shop.log.20220317", "shop.log"), ("shop.log.2022-03-17.lz4", "shop.log"), ("shop.log.2022.03.17", "shop.log"), ("shop.12.log", "shop.log"), ("shop.log.220317", "shop.log"),
     ("shop.log-20220317.gz", "shop.log"), ("shop.log-2022-03-17", "shop.log"), ("shop-20220317", "shop-20220317"), ("shop.log-22", "shop.log-22"), ("shop.log.1234", "shop.log.1234"), ("2022-03-17.bz2", "access.log")],
)
def test_rotation_names(spark, name, want):
    assert one(spark, f"/srv/logs/{name}", rotation.main_log_path) == f"/srv/logs/{want}"


def test_dates(spark):
    for value, want in {"20220317": True, "2022-03-17": True, "2022.03.17": True, "220317": True, "shop": False, "2203": False, "202203170": False, "7": False}.items():
        assert one(spark, value, rotation.is_date) is want


def test_tokens_and_phrases(spark):
    assert one(spark, "/api/Login?x=1.5 don't", text.tokens) == ["api", "login", "x", "1.5", "don't"]
    assert one(spark, "/api/login", lambda c: text.has_phrase(c, "API login")) and not one(spark, "/api/login", lambda c: text.has_phrase(c, "login api"))
    assert not one(spark, "/apis/login", lambda c: text.has_phrase(c, "api"))
    assert one(spark, "GET login", lambda c: text.highlight(c, "login")) == "GET <mark>login</mark>"


def test_places(spark):
    frame = spark.createDataFrame([("FR", "a|b", 48.856, 2.352, 7)], "c string, n string, la double, lo double, i long")
    key = frame.select(geo.city_point(F.col("c"), F.col("n"), F.col("la"), F.col("lo"), F.col("i")).alias("k")).first()["k"]
    assert key == "FR|a/b|48.86|2.35|7"
    assert tuple(one(spark, key, geo.parse_city_point)) == ("FR", "a/b", 48.86, 2.35, 7)
    assert tuple(one(spark, "FR|x|1|2", geo.parse_city_point)) == ("FR", "x", 1.0, 2.0, 0)
    for bad in ("FR|x|1", "FR|x|a|2", "FR|x|1|2|z", "FR|x|1|2|-3", "a|b|1|2|3|4"):
        assert one(spark, bad, geo.parse_city_point) is None
    assert one(spark, "10.0.1.2", geo.ip_number) == 10 * 2**24 + 258
    assert one(spark, "10.0.1.256", geo.ip_number) is None and one(spark, "::1", geo.ip_number) is None


def test_addresses_and_networks(spark):
    number = lambda a: int(a) if a.version == 6 else int(a) + (0xFFFF << 32)
    for text in ("::", "::1", "2001:DB8:0:0:8:800:200C:417A", "::ffff:192.0.2.33", "64:ff9b::203.0.113.5", "192.0.2.33", "0.0.0.0"):
        assert geo.address_key(text) == f"{number(ipaddress.ip_address(text)):032x}"
    for bad in (None, "", "1.2.3", "256.1.1.1", ":::", "1:2:3:4:5:6:7", "1::2::3", "g::1", "example.com"):
        assert geo.address_key(bad) is None
    assert geo.network_keys("10.1.2.3/12") == (geo.MAPPED + "0a000000", geo.MAPPED + "0a0fffff") and geo.network_keys("2001:db8::/33")[1] == "20010db87" + "f" * 23
    assert all(geo.network_keys(bad) is None for bad in (None, "10.0.0.0", "10.0.0.0/33", "::/129", "10.0.0.0/-1", "x/8"))
    named = spark.createDataFrame([("10.0.0.0/8", 1), ("nothing", 2)], "cidr string, n int")
    assert [tuple(r) for r in geography.ranges_of(named).collect()] == [(*geo.network_keys("10.0.0.0/8"), 1)]


def test_longest_prefix(spark):
    rng = random.Random(9)
    nets = list({ipaddress.ip_network((rng.getrandbits(6) << 26 | rng.getrandbits(3) << 10, rng.choice([2, 5, 6, 9, 14, 17, 23, 31, 32])), strict=False) for _ in range(120)})
    nets += list({ipaddress.ip_network((rng.getrandbits(5) << 123 | rng.getrandbits(4) << 90, rng.choice([1, 3, 9, 17, 33, 48, 64, 127, 128])), strict=False) for _ in range(120)})
    asked = [n[rng.choice([0, -1])] for n in rng.sample(nets, 100)] + [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(50)]
    ranges = geography.ranges_of(spark.createDataFrame([(str(n), str(n)) for n in nets], "cidr string, net string"))
    addresses = spark.createDataFrame([(str(a),) for a in set(asked)], "_ip string")
    got = {r["_ip"]: r["_place"]["net"] for r in geography.lookup(addresses, ranges).collect()}
    for a in asked:
        inside = [n for n in nets if n.version == a.version and a in n]
        assert got.get(str(a)) == (str(max(inside, key=lambda n: n.prefixlen)) if inside else None)


def test_params():
    assert params.split_list(" a, ,b,") == ["a", "b"] and params.end_after(0) == 0 and params.end_after(5) == 6
    assert params.decode_path(params.encode_path("/var/log/ä.log")) == "/var/log/ä.log" and params.decode_path("b64_!") == "b64_!" and params.decode_path("/x") == "/x"
