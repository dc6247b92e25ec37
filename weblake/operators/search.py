"""Search: a request is compiled to filters, a total order, and a page of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Columns that a page returns unless it names others.
RETURNED = (
    "id", "timestamp", "ip", "region_code", "province", "city", "city_id", "method", "path", "protocol", "status", "bytes_sent", "referer", "user_agent", "browser", "browser_version", "os", "os_version", "device_type", "request_time",
    "upstream_time", "file_path", "main_log_path", "raw", "level", "sub1",
)
#: Lists of exact values, and lists of phrases; any value of a list matches, all lists must.
EXACT = ("ip", "status", "method", "region_code", "province", "browser", "os", "device_type", "level")
PHRASES = ("path", "user_agent", "referer")
#: What a request sorts by to have the most relevant first.
SCORE = "_score"
DEFAULT_LIMIT, MOST_HITS = 10, 1000


class RequestError(ValueError):
    """A request that cannot be run."""


@dataclass
class SearchRequest:
    query: str | None = None
    start: int | None = None
    end: int | None = None
    log_paths: list[str] = field(default_factory=list)
    by_main_path: bool = False
    exact: dict[str, list] = field(default_factory=dict)
    phrases: dict[str, list[str]] = field(default_factory=dict)
    min_bytes: int | None = None
    max_bytes: int | None = None
    min_request_time: float | None = None
    max_request_time: float | None = None
    limit: int = 0
    offset: int = 0
    sort_by: str = "timestamp"
    sort_order: str = "desc"
    search_after: tuple | None = None
    fields: list[str] = field(default_factory=list)

    def validate(self) -> None:
        if self.limit < -1 or self.offset < 0:
            raise RequestError("limit is -1 or more, offset 0 or more")
        if self.sort_order not in ("", "asc", "desc"):
            raise RequestError("the order is asc or desc")
        check_time_range(self.start or 0, self.end or 0)
        if self.sort_by == SCORE and not self.query:
            raise RequestError("relevance is of a free text")
        unknown = [*(set(self.exact) - set(EXACT)), *(set(self.phrases) - set(PHRASES))]
        if unknown:
            raise RequestError(f"no such filter: {unknown}")

    def normalised(self) -> SearchRequest:
        """With a limit of 10 where it has none, 1000 at most, and no negative offset."""
        return replace(self, limit=min(self.limit, MOST_HITS) if self.limit > 0 else DEFAULT_LIMIT, offset=max(0, self.offset))


def check_time_range(start: int, end: int) -> None:
    if start < 0 or end < 0 or (start and end and start >= end):
        raise RequestError("times are not negative, and the start is before the end")


def check_access_log(path: str, error_logs: set[str]) -> None:
    """Dashboards and maps are of access logs only."""
    if path in error_logs:
        raise RequestError("an error log has no such figures")


def country_code(value: str) -> str:
    code = value.strip().upper()
    if len(code) != 2 or not ("A" <= code[0] <= "Z" and "A" <= code[1] <= "Z"):
        raise RequestError("a country is two letters")
    return code


def conditions(request: SearchRequest) -> list[Column]:
    """The filters of a request."""
    request.validate()
    out = []
    if request.query:
        out.append(text.has_any_token(F.col("raw"), request.query))
    if request.start is not None:
        out.append(F.col("timestamp") >= request.start)
    if request.end is not None:
        out.append(F.col("timestamp") < request.end)
    if request.log_paths:
        out.append(F.col("main_log_path" if request.by_main_path else "file_path").isin(request.log_paths))
    out += [F.col(name).isin(values) for name, values in request.exact.items() if values]
    out += [reduce(Column.__or__, (text.has_phrase(F.col(name), v) for v in values)) for name, values in request.phrases.items() if values]
    for name, low, high in (("bytes_sent", request.min_bytes, request.max_bytes), ("request_time", request.min_request_time, request.max_request_time)):
        if low is not None:
            out.append(F.col(name) >= low)
        if high is not None:
            out.append(F.col(name) <= high)
    return out


def matching(entries: DataFrame, request: SearchRequest) -> DataFrame:
    """All entries that match."""
    return reduce(DataFrame.where, conditions(request), entries)


def hits(entries: DataFrame, request: SearchRequest) -> DataFrame:
    """One page of the matches: in the request's order, ties by id ascending, missing values last.  Scores are computed, and are
    a column of the page, only where the order is by them and the page is not empty."""
    found = matching(entries, request)
    scored = request.sort_by == SCORE and request.limit >= 0
    if scored:
        found = with_score(found, entries, request.query)
    elif request.sort_by == SCORE:
        found = found.withColumn(SCORE, F.lit(0.0))
    key, down = F.col(request.sort_by), request.sort_order != "asc"
    if request.search_after is not None:
        value, last_id = request.search_after
        same, null = F.col("id") > last_id, key.isNull()
        if value is None:
            found = found.where(null & same)
        else:
            found = found.where((key < value if down else key > value) | ((key == value) & same) | null)
    ordered = found.orderBy(key.desc_nulls_last() if down else key.asc_nulls_last(), F.col("id").asc())
    limit = 50 if request.limit == 0 else max(0, request.limit)
    if request.offset and request.search_after is None:
        ordered = ordered.offset(request.offset)
    names = request.fields or [c for c in RETURNED if c in entries.columns]
    return ordered.limit(limit).select(*names, *([SCORE] if scored and SCORE not in names else []))


def total(entries: DataFrame, request: SearchRequest) -> DataFrame:
    return matching(entries, request).agg(F.count(F.lit(1)).alias("total"))


def latest(entries: DataFrame, limit: int = 100, tail: bool = True) -> DataFrame:
    """The newest (``tail``) or oldest entries."""
    return hits(entries, SearchRequest(limit=limit, sort_order="desc" if tail else "asc"))


def _is(word: str):
    return lambda token: token == word


def with_score(rows: DataFrame, entries: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``rows`` with ``_score``, BM25 by the statistics of all ``entries``: one row for the few terms of a query."""
    wanted = sorted(set(text.literal_tokens(query)))
    tokens = entries.select(text.tokens(F.col("raw")).alias("t"))
    whole = tokens.agg(F.count(F.lit(1)).alias("_docs"), F.avg(F.size("t")).alias("_mean"), *(F.sum(F.array_contains("t", w).cast("int")).alias(f"_df{i}") for i, w in enumerate(wanted)))
    held = rows.withColumn("_t", text.tokens(F.col("raw"))).crossJoin(F.broadcast(whole))
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        tf = F.size(F.filter("_t", _is(w)))
        idf = F.log(1 + (F.col("_docs") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("_t") / F.col("_mean")))
    return held.withColumn(SCORE, F.coalesce(score, F.lit(0.0))).drop("_t", *whole.columns)


def by_relevance(entries: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, score): the matches of a free text, the most relevant first."""
    return hits(entries, SearchRequest(query=query, sort_by=SCORE, limit=limit, fields=["id"])).withColumnRenamed(SCORE, "score")


def highlighted(entries: DataFrame, request: SearchRequest, columns: tuple[str, ...] = ("raw",)) -> DataFrame:
    """The page with the query's tokens marked."""
    return hits(entries, request).withColumns({c: text.highlight(F.col(c), request.query or "") for c in columns})


def fragments(entries: DataFrame, request: SearchRequest, columns: tuple[str, ...] = ("*",), around: int = 100) -> DataFrame:
    """The page with ``fragments``: for each named column (``*``: all that were searched) that has hits, the parts of its text
    around them, marked.  The free text is looked for in ``raw``, phrases in their own columns."""
    asked = {"raw": [request.query] if request.query else [], **request.phrases}
    found = {c: " ".join(v) for c, v in asked.items() if v and (c in columns or "*" in columns)}
    page = hits(entries, replace(request, fields=[*dict.fromkeys([*(request.fields or [c for c in RETURNED if c in entries.columns]), *found])]))
    pairs = [F.struct(F.lit(c).alias("key"), text.fragments(F.col(c), v, around).alias("value")) for c, v in found.items()]
    if not pairs:
        return page.withColumn("fragments", F.lit(None).cast("map<string,array<string>>"))
    return page.withColumn("fragments", F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.size(p["value"]) > 0)))
