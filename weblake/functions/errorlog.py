"""Error lines: time, level, process, connection, message and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .access import METHODS

# Levels, and other names of some.
LEVELS = ("debug", "info", "notice", "warn", "error", "crit", "alert", "emerg")
ALIASES = {"warning": "warn", "err": "error", "critical": "crit", "emergency": "emerg"}
# Context keys in the order they are written, and whether their values are quoted.
CONTEXT = (("client", False), ("server", False), ("request", True), ("upstream", True), ("host", True), ("referrer", True))
MAX_LINE = 64 * 1024

_HEAD = rf"^(\d{{4}}/\d{{2}}/\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}) \[({'|'.join(LEVELS)})\] *(?:(\d+)#(\d+): )?(?:\*(\d+) )?"
_MESSAGE = rf"((?:(?!, (?:{'|'.join(k for k, _ in CONTEXT)}): ).)*)"
_PAIRS = "".join(rf'(?:, {k}: "([^"]*)")?' if quoted else rf"(?:, {k}: ((?:(?!, ).)*))?" for k, quoted in CONTEXT)
#: Groups: time, level, process, thread, connection, message, and the values of the context.
LINE = rf"(?s){_HEAD}{_MESSAGE}{_PAIRS}.*$"
_GROUPS = 6 + len(CONTEXT)
_MARK = "\x1f"


def level_of(value: Column) -> Column:
    """The level's own name, null for an unknown one."""
    name = F.lower(F.trim(value))
    name = reduce(lambda c, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(c), ALIASES.items(), name)
    return F.when(name.isin(*LEVELS), name)


def level_name(value: str) -> str | None:
    """The same for a request's value."""
    name = value.strip().lower()
    name = ALIASES.get(name, name)
    return name if name in LEVELS else None


def error_entry(raw: Column) -> Column:
    """A struct of the line's fields, null where it does not start like an error line.  Times are in the session's zone.  A
    separator character in the line counts as a space."""
    marked = F.regexp_replace(F.translate(raw, _MARK, " "), LINE, _MARK.join(f"${i}" for i in range(1, _GROUPS + 1)))
    parts = F.split(F.when((F.length(raw) >= 25) & (F.length(raw) <= MAX_LINE), marked), _MARK)

    def fields(found: Column) -> Column:
        group = lambda i: F.get(found, i - 1)
        value = {key: F.nullif(group(7 + i), F.lit("")) for i, (key, _) in enumerate(CONTEXT)}
        time = F.try_to_timestamp(group(1), F.lit("yyyy/MM/dd HH:mm:ss"))
        request = F.split(F.trim(value["request"]), r"\s+")
        method = F.when((F.size(request) >= 2) & F.get(request, 0).isin(*METHODS), F.get(request, 0))
        entry = F.struct(
            F.unix_timestamp(time).alias("timestamp"),
            group(2).alias("level"),
            F.coalesce(group(3).try_cast("long"), F.lit(0)).alias("pid"),
            F.coalesce(group(5).try_cast("long"), F.lit(0)).alias("connection"),
            group(6).alias("message"),
            *(value[key].alias(key) for key, _ in CONTEXT),
            method.alias("method"),
            F.when(method.isNotNull(), F.get(request, 1)).alias("path"),
        )
        return F.when((F.size(found) == _GROUPS) & time.isNotNull(), entry)

    # A variable of ``transform`` stands for the groups, so that each line is matched once however often they are named.
    return F.get(F.transform(F.array(parts), fields), 0)
