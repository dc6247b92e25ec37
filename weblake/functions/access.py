"""Access lines: one anchored pattern, native columns for its groups; and lines of the common form without it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Methods that are kept.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT", "PROPFIND", "PROPPATCH", "MKCOL", "COPY", "MOVE", "LOCK", "UNLOCK")
#: Groups: what is whole up to the status, ip, time, method, path, protocol, status, size, referer, agent, request time, upstream
#: time.  A line that ends before the status is kept with what was read, stamped with the time of reading.
LINE = (
    r'(?s)^(?=((?=.{20})[^ ]+ +[^ ]* *[^ ]* *\[[^\]]*\] *"[^"]*" *[0-9]+.)?)'
    r'([^ ]+) *[^ ]* *[^ ]* *(?:\[([^\]]*)\]?)? *(?:"\s*([^"\s]*)\s*([^"\s]*)\s*([^"\s]*)[^"]*"?)? *([0-9]*) *([0-9-]*)(?: *"([^"]*)"?)?(?: *"([^"]*)"?)? *([0-9.-]*) *([0-9.-]*).*$'
)
_GROUPS = 12
_MARK = "\x1f"
MAX_LINE = 16 * 1024
_SECONDS = r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
TIMES = ("dd/MMM/yyyy:HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss")


def epoch(text: Column) -> Column:
    """Seconds of an access time, 0 if no layout fits; layouts without a zone are UTC whatever the session's zone is.  Only
    layouts whose shape fits are tried."""
    zoned = lambda layout: F.unix_timestamp(F.try_to_timestamp(text, F.lit(layout)))
    plain = lambda layout: F.unix_timestamp(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{layout} Z")))
    slashed, has_zone = F.substring(text, 3, 1) == "/", F.length(text) > 20
    return F.coalesce(F.when(slashed & has_zone, zoned(TIMES[0])).when(slashed, plain(TIMES[3])).when(F.substring(text, 11, 1) == "T", zoned(TIMES[1])).otherwise(plain(TIMES[2])), F.lit(0)).cast("long")


def _parts(raw: Column) -> Column:
    """The groups of a line, matched once.  A separator character in the line counts as a space."""
    groups = _MARK.join(f"${i}" for i in range(1, _GROUPS + 1))
    return F.split(F.regexp_replace(F.translate(raw, _MARK + "\n", "  "), LINE, groups), _MARK)


def access_entry(raw: Column, ingest_time: Column | None = None) -> Column:
    """A struct of the line's fields; null for an empty line or one above ``MAX_LINE``.  A line cut short before its size
    keeps its fields and gets ``ingest_time`` (null: 0) as its time."""
    inner = ingest_time if ingest_time is not None else F.lit(0)

    def fields(parts: Column) -> Column:
        # A line that the pattern does not fit (it begins with a space) has no groups.
        fits = F.size(parts) == _GROUPS
        group = lambda i: F.when(fits, F.get(parts, i)).otherwise("")
        number = lambda i, kind: group(i).try_cast(kind)
        # A cast of what is no number costs an exception, so the shape is looked at first.
        seconds = lambda i: F.when(group(i).rlike(_SECONDS), number(i, "double"))
        method, status = group(3), F.coalesce(number(6, "int"), F.lit(0))
        return F.struct(
            group(1).alias("ip"),
            F.when(group(0) != "", epoch(group(2))).otherwise(F.coalesce(inner, F.lit(0))).cast("long").alias("timestamp"),
            F.when(method.isin(*METHODS), method).otherwise("").alias("method"),
            group(4).alias("path"),
            group(5).alias("protocol"),
            F.when(status.between(100, 599), status).otherwise(0).alias("status"),
            F.coalesce(number(7, "long"), F.lit(0)).alias("bytes_sent"),
            F.nullif(group(8), F.lit("")).alias("referer"),
            F.nullif(group(9), F.lit("")).alias("user_agent"),
            F.nullif(seconds(10), F.lit(0.0)).alias("request_time"),
            seconds(11).alias("upstream_time"),
        )

    # A variable of ``transform`` stands for the groups, so that each line is matched once however often they are named.
    good = (F.length(raw) > 0) & (F.length(raw) <= MAX_LINE)
    return F.get(F.transform(F.array(_parts(F.when(good, raw))), lambda parts: F.when(parts.isNotNull(), fields(parts))), 0)


# --- the common form -----------------------------------------------------------------------------------------------------


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, by counting years from March."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    of_year = _div(153 * (month + F.when(month > 2, -3).otherwise(9)) + 2, 5) + day - 1
    return y * 365 + _div(y, 4) - _div(y, 100) + _div(y, 400) + of_year - 719468


#: A time and its zone, a status and a size.
_FORMS = r"^\[[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}\] [0-9]{3} (?:[0-9]{1,18}|-)\z"
_TAIL = "^ *([0-9.-]*) *([0-9.-]*)"


def with_entry(lines: DataFrame, ingest_time: Column | None = None, raw: str = "raw", name: str = "_e") -> DataFrame:
    """``lines`` with ``access_entry`` of a column.  A line that has the combined form and no odd character is split at quotes and
    spaces, and its time added up from its digits; any other is matched by the pattern.  Each step is a projection of its own, so
    that Spark computes what the next ones share once.  A function with a variable in each of them keeps Spark from fusing them to
    one method, which would be too long for Java to compile."""
    line, own = F.col(raw), [F.col(f"`{c}`") for c in lines.columns]
    get = lambda words, i: F.coalesce(F.get(F.col(words), F.lit(i)), F.lit(""))
    part = lambda c: F.col(f"_w.{c}")
    apart = lambda value: F.get(F.transform(F.array(value), lambda v: v), 0)
    quoted = lines.select(*own, apart(F.split(line, '"')).alias("_q"))
    split = quoted.select(*own, "_q", *(F.split(get("_q", i), " ").alias(n) for i, n in ((0, "_head"), (1, "_request"), (2, "_middle"))))
    form = F.concat_ws(" ", get("_head", 3), get("_head", 4), get("_middle", 1), get("_middle", 2))
    formed = split.select(*own, "_q", "_head", "_request", "_middle", F.when(apart(form.rlike(_FORMS)), form).alias("_form"))
    # A clock that fits stands in for one that does not, so that no cast fails.
    clock = F.coalesce("_form", F.lit("[01/Jan/1970:00:00:00 +0000] 200 -"))
    number = lambda begin, n: F.substring(clock, begin, n).cast("int")
    digits = {"day": number(2, 2), "year": number(9, 4), "hour": number(14, 2), "minute": number(17, 2), "second": number(20, 2), "off": number(24, 2), "late": number(26, 2)}
    month, away = F.instr(F.lit(_MONTHS), F.substring(clock, 5, 3)), F.when(F.substring(clock, 23, 1) == "-", -1).otherwise(1)
    timed = formed.select(*own, "_q", "_head", "_request", "_middle", "_form", F.struct(*(c.alias(n) for n, c in digits.items()), month.alias("month"), apart(away).alias("away")).alias("_w"))
    year, day, number_of = part("year"), part("day"), _div(part("month") + 2, 3)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = F.when(number_of.isin(4, 6, 9, 11), 30).when(number_of != 2, 31).when(leap, 29).otherwise(28)
    real = (part("month") % 3 == 1) & (year >= 1) & (day >= 1) & (day <= longest) & (part("hour") <= 23) & (part("minute") <= 59) & (part("second") <= 59) & (part("off") <= 14) & (part("late") <= 59)
    whole = (F.size("_q") >= 7) & (get("_q", 4) == " ") & (F.size("_head") == 6) & (F.size("_request") == 3) & (F.size("_middle") == 4)
    filled = reduce(Column.__and__, (get(w, i) != "" for w, i in (("_head", 0), ("_head", 1), ("_head", 2), ("_request", 0), ("_request", 1), ("_request", 2))))
    edges = (get("_head", 5) == "") & (get("_middle", 0) == "") & (get("_middle", 3) == "")
    even = reduce(Column.__and__, (~get("_q", 1).contains(c) for c in "\t\x0b\f\r")) & ~line.contains("\n") & ~line.contains(_MARK) & (F.length(line) <= MAX_LINE)
    seconds_of = _days(year, number_of, day).cast("long") * 86400 + part("hour") * 3600 + part("minute") * 60 + part("second") - part("away") * (part("off") * 3600 + part("late") * 60)
    fits = F.coalesce(F.col("_form").isNotNull() & whole & edges & filled & real & even, F.lit(False))
    judged = timed.select(*own, "_q", "_head", "_request", "_middle", apart(fits).alias("_fits"), seconds_of.cast("long").alias("_time"), *(F.regexp_extract(get("_q", 6), _TAIL, i).alias(n) for i, n in ((1, "_took"), (2, "_upstream"))))
    seconds = lambda c: F.when(F.col(c).rlike(_SECONDS), F.col(c).try_cast("double"))
    method, status, size = get("_request", 0), get("_middle", 1).try_cast("int"), get("_middle", 2)
    entry = F.struct(
        get("_head", 0).alias("ip"),
        F.col("_time").alias("timestamp"),
        F.when(method.isin(*METHODS), method).otherwise("").alias("method"),
        get("_request", 1).alias("path"),
        get("_request", 2).alias("protocol"),
        F.when(status.between(100, 599), status).otherwise(0).alias("status"),
        F.when(size == "-", F.lit(0).cast("long")).otherwise(F.coalesce(size.try_cast("long"), F.lit(0))).alias("bytes_sent"),
        F.nullif(get("_q", 3), F.lit("")).alias("referer"),
        F.nullif(get("_q", 5), F.lit("")).alias("user_agent"),
        F.nullif(seconds("_took"), F.lit(0.0)).alias("request_time"),
        seconds("_upstream").alias("upstream_time"),
    )
    return judged.select(*own, F.when(F.col("_fits"), entry).otherwise(access_entry(line, ingest_time)).alias(name))


def valid_entry(now: Column, ip="ip", timestamp="timestamp", method="method", status="status", path="path", raw="raw") -> Column:
    """Whether an entry's fields are plausible: the ip is no URL, path or escape, the time is after 0 and at most a day
    ahead of ``now``, method and status are known ones or absent, and there are no binary escapes."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    odd_ip = c(ip).contains("http") | c(ip).contains("/") | c(ip).contains("\\x") | c(ip).contains("%") | (F.length(c(ip)) > 45)
    return (
        (c(ip).isin("", "-") | ~odd_ip)
        & (F.col(timestamp) > 0)
        & (F.col(timestamp) <= now + 86400)
        & ((c(method) == "") | c(method).isin(*METHODS))
        & (F.coalesce(F.col(status), F.lit(0)).between(100, 599) | (F.coalesce(F.col(status), F.lit(0)) == 0))
        & ~c(path).contains("\\x")
        & ~c(raw).contains("\\x16\\x03")
        & ~c(raw).contains("\\xFF\\xD8")
    )
