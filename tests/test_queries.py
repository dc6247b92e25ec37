from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weblake import queries
from weblake.operators import dashboard as dash
from weblake.operators import facets
from weblake.operators.search import RequestError, SearchRequest, check_access_log, country_code, fragments, hits, matching
from weblake.plans import catalog

NOON = 1735732800
FILTER_DOCS = [
    ("d1", NOON, "10.0.0.1", "GET", 200, "/api/login", 100, "Chrome", "Windows", "Desktop", "https://a.example/start", "Mozilla Chrome/91.0", "f1"),
    ("d2", NOON, "10.0.0.2", "POST", 404, "/api/users", 2000, "Firefox", "Ubuntu", "Desktop", "https://b.example/x", "Mozilla Firefox/89.0", "f1"),
    ("d3", NOON, "10.0.0.1", "GET", 500, "/login/api", 300, "Safari", "iOS", "iPhone", None, "Mozilla Safari", "f2"),
    ("d4", NOON, "10.0.0.3", "GET", 200, "/static/app.js", 50, "Chrome", "Android", "Mobile", "https://a.example/start", "Mozilla Chrome/90.0 Mobile", "f2"),
]
SCHEMA = "id string, timestamp long, ip string, method string, status int, path string, bytes_sent long, browser string, os string, device_type string, referer string, user_agent string, file_path string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(FILTER_DOCS, SCHEMA).withColumns({"path_exact": F.col("path"), "raw": F.concat_ws(" ", "ip", "method", "path"), "main_log_path": F.lit("m"), "request_time": F.when(F.col("status") == 200, 0.5)}).cache()


@pytest.mark.parametrize(
    "request_,want",
    [
        ({}, {"d1", "d2", "d3", "d4"}),
        ({"exact": {"ip": ["10.0.0.1"]}}, {"d1", "d3"}),
        ({"exact": {"status": [404, 500]}}, {"d2", "d3"}),
        ({"exact": {"method": ["POST"]}}, {"d2"}),
        ({"phrases": {"path": ["/api/login"]}}, {"d1"}),
        ({"phrases": {"path": ["api login", "app.js"]}}, {"d1", "d4"}),
        ({"phrases": {"user_agent": ["chrome"]}}, {"d1", "d4"}),
        ({"phrases": {"referer": ["a.example"]}}, {"d1", "d4"}),
        ({"exact": {"browser": ["Chrome"], "os": ["Android"]}}, {"d4"}),
        ({"exact": {"device_type": ["Desktop"]}}, {"d1", "d2"}),
        ({"min_bytes": 100, "max_bytes": 300}, {"d1", "d3"}),
        ({"max_request_time": 1.0}, {"d1", "d4"}),
        ({"log_paths": ["f2"]}, {"d3", "d4"}),
        ({"query": "users nothing"}, {"d2"}),
        ({"query": "..."}, {"d1", "d2", "d3", "d4"} - {"d1", "d2", "d3", "d4"}),
        ({"start": NOON, "end": NOON + 1}, {"d1", "d2", "d3", "d4"}),
        ({"end": NOON}, set()),
    ],
)
def test_filters(docs, request_, want):
    assert {r["id"] for r in matching(docs, SearchRequest(**request_)).collect()} == want


def test_status_facet_and_meta(docs):
    assert {r["status"]: r["count"] for r in facets.status_codes(docs).collect()} == {200: 2, 404: 1, 500: 1}
    assert facets.meta(docs, "browser", 1).first()[1:] == (1, 0, 2)
    assert facets.meta(docs, "referer", 2).first()["missing"] == 1


def test_bad_requests():
    for bad in ({"limit": -2}, {"offset": -1}, {"sort_order": "up"}, {"start": 5, "end": 5}, {"exact": {"colour": ["x"]}}):
        with pytest.raises(RequestError):
            SearchRequest(**bad).validate()
    with pytest.raises(RequestError):
        country_code("fra")
    assert country_code(" fr ") == "FR"


def test_cursor_pages_have_no_gaps(spark):
    rows = [(f"e{i:03d}", NOON + i % 3, "1.1.1.1") for i in range(25)]
    frame = spark.createDataFrame(rows, "id string, timestamp long, ip string")
    seen, cursor = [], None
    for size in (10, 10, 5):
        page = hits(frame, SearchRequest(limit=10, search_after=cursor)).collect()
        assert len(page) == size
        seen += [r["id"] for r in page]
        cursor = (page[-1]["timestamp"], page[-1]["id"])
    assert len(set(seen)) == 25 and seen == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_relevance_as_an_order(docs):
    rows = hits(docs, SearchRequest(query="get login users", sort_by="_score", fields=["id"])).collect()
    assert [r["id"] for r in rows] == sorted((r["id"] for r in rows), key=lambda i: -next(r["_score"] for r in rows if r["id"] == i)) and rows[-1]["_score"] > 0 and len(rows) == 4
    after = hits(docs, SearchRequest(query="get login users", sort_by="_score", search_after=(rows[0]["_score"], rows[0]["id"]), fields=["id"], exact={"status": [200, 500, 404]})).collect()
    assert after == rows[1:]
    assert hits(docs, SearchRequest(query="get", sort_by="_score", limit=-1)).count() == 0 and "_score" not in hits(docs, SearchRequest(query="get")).columns
    with pytest.raises(RequestError):
        hits(docs, SearchRequest(sort_by="_score"))


def test_limits_and_error_logs():
    assert (SearchRequest(limit=0, offset=-5).normalised().limit, SearchRequest(limit=5000).normalised().limit, SearchRequest(offset=-5).normalised().offset) == (10, 1000, 0)
    check_access_log("/a.log", {"/b.log"})
    with pytest.raises(RequestError):
        check_access_log("/b.log", {"/b.log"})


def test_fragments(docs):
    rows = {r["id"]: r["fragments"] for r in fragments(docs, SearchRequest(query="api post", phrases={"path": ["api"]}, fields=["id"]), around=3).collect()}
    assert rows["d1"] == {"raw": ["T /<mark>api</mark>/lo"], "path": ["/<mark>api</mark>/lo"]}
    assert rows["d2"]["raw"][0].startswith(".2 <mark>POST</mark>")
    assert list(fragments(docs, SearchRequest(query="api", phrases={"path": ["api"]}, fields=["id"]), ("raw",)).first()["fragments"]) == ["raw"]
    assert fragments(docs, SearchRequest(fields=["id"])).first()["fragments"] is None


def test_scan_and_widen(spark, docs):
    import pyarrow as pa

    def longest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max(map(len, b.column(0).to_pylist()), default=0)])], ["n"])

    assert max(r["n"] for r in facets.scan(docs, ["path"], longest, "n long").collect()) == 14
    states = spark.createDataFrame([("/a", 3, 50, 90), ("/b", 1, 5, 6)], "path string, document_count long, s long, e long").select("path", "document_count", F.timestamp_seconds("s").alias("timerange_start"), F.timestamp_seconds("e").alias("timerange_end"))
    rows = catalog.widen(states, "/a", 9, F.timestamp_seconds(F.lit(60)), F.timestamp_seconds(F.lit(99))).select("path", "document_count", F.unix_timestamp("timerange_start"), F.unix_timestamp("timerange_end")).collect()
    assert sorted(map(tuple, rows)) == [("/a", 9, 50, 99), ("/b", 1, 5, 6)]


def test_stats(spark):
    frame = spark.createDataFrame([(f"{i}", NOON + i, 100 * i, i / 10 if i else None) for i in range(10)], "id string, timestamp long, bytes_sent long, request_time double")
    s = facets.stats(matching(frame, SearchRequest(start=NOON + 1, end=NOON + 5))).first()
    assert (s["docs"], s["total_bytes"], s["avg_bytes"], s["min_bytes"], s["max_bytes"]) == (4, 1000, 250.0, 100, 400)
    empty = facets.stats(frame.where("false")).first()
    assert set(empty.asDict().values()) == {0}
    capped = facets.stats_of_first(frame, 5).first()
    assert capped["approximate"] and capped["total_bytes"] == 2 * 1000


def test_dashboard_equals_a_plain_count(spark):
    rng = random.Random(7)
    start = 1640995200
    end = start + 2 * 86400
    rows = [(start + rng.randint(-36000, 2 * 86400 + 36000), f"10.0.{rng.randint(0, 3)}.{rng.randint(0, 29)}", f"/p{rng.randint(0, 24)}", rng.choice(["A", "B", "C", None]), "os", "d", rng.randint(1, 900)) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "timestamp long, ip string, path_exact string, browser string, os string, device_type string, bytes_sent long")
    parts = dash.dashboard(spark, frame, start, end)
    hours = defaultdict(list)
    for r in rows:
        hours[r[0] - r[0] % 3600].append(r[1])
    got = parts["hourly"].collect()
    assert len(got) == 72 and all((r["pv"], r["uv"]) == (len(hours[r["timestamp"]]), len(set(hours[r["timestamp"]]))) for r in got)
    inside = [r for r in rows if start <= r[0] < end]
    s = parts["summary"].first()
    assert (s["total_pv"], s["total_uv"], s["total_traffic"]) == (len(inside), len({r[1] for r in inside}), sum(r[6] for r in inside))
    assert s["peak_qps"] == max(Counter(r[0] // 60 for r in inside).values()) / 60
    best = max(got, key=lambda r: (r["pv"], -r["timestamp"]))
    assert (s["peak_hour"], s["peak_hour_traffic"]) == (best["hour"], best["pv"])
    assert {r["term"]: r["count"] for r in parts["browsers"].collect()} == Counter(r[3] for r in inside if r[3])
    assert len(parts["daily"].collect()) == 2
    later = dash.dashboard(spark, frame, end + 40 * 86400, end + 41 * 86400)
    assert all(later[k].isEmpty() for k in ("hourly", "daily", "browsers", "urls"))


def test_every_query_has_its_sql():
    missing = set(queries.QUERIES) - set(queries.ORACLES)
    assert not missing


def test_nested_networks_of_visitors_beyond_65535(spark, tmp_path):
    """Their addresses are 10.0.256.x and on, which lie in the widest network by their numbers."""
    rows = [(0, 65538, "view"), (1, 99976, "view"), (2, 513, "view"), (3, 2**24 + 513, "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(1704672000) ts", "user_id", "event_type", "1.0D value", "'{\"k\": 3}' props").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["ip"]: (r["region_code"], r["city"]) for r in queries.QUERIES["geo_longest_prefix"](spark, str(tmp_path)).collect()}
    assert got == {"10.0.256.2": ("CC", "all"), "10.0.390.136": ("CC", "all"), "10.0.2.1": ("ZZ", "all"), "10.0.65538.1": ("CC", "all")}
