"""The entries table: snapshots, changes made at once, files that are not read, stored sums."""

from __future__ import annotations

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from weblake.operators import dashboard as dash
from weblake.operators import rollup, skipping
from weblake.operators.search import SearchRequest, hits
from weblake.operators.table import ConflictError, EntryTable

DAY, START = 86400, 1735689600
SCHEMA = "id string, timestamp long, ip string, path string, path_exact string, user_agent string, browser string, os string, device_type string, bytes_sent long, file_path string, main_log_path string, raw string"
AGENTS = (("Ein Browser/1.0", "A", "x"), ("Ander's Bröwser/2.0.1", "B", "y"), (None, None, "x"))


def entries(spark, n, seed=0, days=4, prefix="aaaabbbbccccdddd", groups=("/g", "/h")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = START + days * DAY * i // n + rng.randint(0, 50)
        ip = f"10.{t // DAY % 7}.{rng.randint(0, 3)}.{rng.randint(0, 60)}" if i % 50 else ""
        path = f"/p{rng.randint(0, 20)}/Item.{i}" if i % 31 else None
        agent, browser, system = AGENTS[i % 3]
        group = groups[i % len(groups)]
        raw = f'{ip} - - [t] "GET {path} HTTP/1.1" 200 {i} "-" "{agent}"' if i % 7 else f"other{i} words"
        rows.append((f"{prefix}-{i}", t, ip, path, path, agent, browser, system, "d", rng.randint(0, 999), f"{group}.{i % 3}", group, raw))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    # A root whose own path looks like that of a change.
    return EntryTable(spark, str(tmp_path / uuid.uuid4().hex / "t"))


def ids(rows):
    return sorted((r["main_log_path"], r["id"], r["bytes_sent"]) for r in rows.select("main_log_path", "id", "bytes_sent").collect())


def files_of(table):
    return {r["file"] for r in table.snapshot().manifest.collect()}


def test_new_ids_are_added_without_reading(spark, table, monkeypatch):
    table.upsert(entries(spark, 400))
    before = files_of(table)
    read = []
    monkeypatch.setattr(EntryTable, "load", lambda self, snapshot, files, own=EntryTable.load: read.append(files.count()) or own(self, snapshot, files))
    table.upsert(entries(spark, 40, seed=1, days=1, prefix="ffffbbbbccccdddd"))
    # Ids of a file that goes on where it was left come after those that are there.
    more = entries(spark, 400).where("false").unionByName(entries(spark, 500).where("cast(substring_index(id, '-', -1) as int) >= 400"))
    table.upsert(more)
    assert not sum(read) and before < files_of(table) and table.count() == 540


def test_rows_replace_those_with_their_ids_on_any_day(spark, table):
    table.upsert(entries(spark, 300))
    before = files_of(table)
    moved = entries(spark, 300).where("id in ('aaaabbbbccccdddd-3', 'aaaabbbbccccdddd-8')").withColumns({"timestamp": F.lit(START + 3 * DAY + 5).cast("long"), "bytes_sent": F.lit(-1).cast("long")})
    table.upsert(moved)
    want = {(r["main_log_path"], r["id"]): r["bytes_sent"] for r in entries(spark, 300).collect()} | {("/h", "aaaabbbbccccdddd-3"): -1, ("/g", "aaaabbbbccccdddd-8"): -1}
    assert ids(table.read()) == sorted((*k, v) for k, v in want.items())
    # Only the two files that held the ids were written anew; files of other days are what they were.
    assert len(before - files_of(table)) == 2
    assert table.read(start=START + 3 * DAY).where("bytes_sent = -1").count() == 2


def test_a_reader_sees_a_change_whole_or_not_at_all(spark, table, monkeypatch):
    table.upsert(entries(spark, 200))
    old, then = table.read(), table.snapshot()
    want = ids(old)
    seen = []
    put = type(table.folder).put

    def slow(self, name, text):
        # All files of the change are there, the version is not.
        seen.append(ids(table.read()))
        return put(self, name, text)

    monkeypatch.setattr(type(table.folder), "put", slow)
    table.upsert(entries(spark, 200).withColumn("bytes_sent", F.lit(-5).cast("long")))
    table.purge_file("/g", "/g.0")
    table.drop_group("/h")
    assert seen[0] == want and {b for _, _, b in seen[1]} == {-5} and len(seen[1]) == 200
    # The first reader still has its files, and so has its version.
    assert ids(old) == want and ids(table.read(version=then.version)) == want
    assert {r["main_log_path"] for r in table.read().collect()} == {"/g"} and table.read().where("file_path = '/g.0'").isEmpty()


def test_a_change_that_is_cut_short_changes_nothing(spark, table, monkeypatch):
    table.upsert(entries(spark, 100))
    want, versions = ids(table.read()), table.versions()

    def lost(*_):
        raise RuntimeError("lost")

    for owner, name in ((skipping, "write"), (rollup, "write"), (type(table.folder), "put"), (EntryTable, "_overlapping")):
        with monkeypatch.context() as m:
            m.setattr(owner, name, lost)
            with pytest.raises(RuntimeError):
                table.upsert(entries(spark, 120).withColumn("bytes_sent", F.lit(7).cast("long")))
        assert ids(table.read()) == want and table.versions() == versions
    left = len(os.listdir(f"{table.root}/data"))
    table.vacuum()
    assert len(os.listdir(f"{table.root}/data")) == left > 1  # young: a change that is under way may own them
    table.vacuum(hours=0)
    assert len(os.listdir(f"{table.root}/data")) == 1 and ids(table.read()) == want


def test_changes_made_at_once_lose_and_double_nothing(spark, table, monkeypatch):
    table.upsert(entries(spark, 60))
    other = EntryTable(spark, table.root)
    put, raced = type(table.folder).put, []

    def race(self, name, text):
        # Between the plan and the switch of the first change, another one is made: twice, so it is derived three times.
        if len(raced) < 2 and name.startswith("versions/"):
            raced.append(name)
            monkeypatch.setattr(type(table.folder), "put", put)
            other.upsert(entries(spark, 60, prefix=f"{len(raced):016d}").withColumn("bytes_sent", F.lit(len(raced)).cast("long")))
            if len(raced) == 2:
                other.upsert(entries(spark, 60).where("id like '%-1_'").withColumn("bytes_sent", F.lit(-9).cast("long")))
            monkeypatch.setattr(type(table.folder), "put", race)
        return put(self, name, text)

    monkeypatch.setattr(type(table.folder), "put", race)
    table.upsert(entries(spark, 60).where("id like '%-2_'").withColumn("bytes_sent", F.lit(-1).cast("long")))
    monkeypatch.setattr(type(table.folder), "put", put)
    want = {(r["main_log_path"], r["id"]): r["bytes_sent"] for r in entries(spark, 60).collect()}
    want = {k: -9 if k[1][-3:-1] == "-1" else -1 if k[1][-3:-1] == "-2" else v for k, v in want.items()}
    want |= {(r["main_log_path"], f"{n:016d}-{r['id'].rsplit('-', 1)[1]}"): n for n in (1, 2) for r in entries(spark, 60).collect()}
    assert ids(table.read()) == sorted((*k, v) for k, v in want.items())
    monkeypatch.setattr(type(table.folder), "put", lambda *_: False)
    with pytest.raises(ConflictError):
        table.drop_group("/g")


def test_ids_of_any_form(spark, table):
    rows = entries(spark, 90)
    odd = lambda n: rows.withColumns({"id": F.expr(f"case when timestamp % 3 = 0 then concat('x', id) when timestamp % 3 = 1 then uuid() else concat(substring(md5(id), 1, {n}), '-', bytes_sent) end"), "main_log_path": F.lit("/g")})
    first = odd(9).dropDuplicates(["id"]).cache()
    table.upsert(first)
    table.upsert(first.withColumn("bytes_sent", F.col("bytes_sent") + 1000))
    assert ids(table.read()) == sorted((m, i, b + 1000) for m, i, b in ids(first))
    first.unpersist()


def test_deletions_read_only_files_that_hold_other_rows(spark, table, monkeypatch):
    rows = entries(spark, 240, groups=("/g",))
    table.upsert(rows.withColumn("file_path", F.when(F.col("timestamp") < START + DAY, "/only").otherwise(F.col("file_path"))))
    read = []
    monkeypatch.setattr(EntryTable, "load", lambda self, snapshot, files, own=EntryTable.load: read.append(files.count()) or own(self, snapshot, files))
    table.purge_file("/g", "/only")
    table.purge_file("/g", "/nothing")
    assert not read and table.count() == 180 and table.count("/g", "/g.1") == table.read("/g").where("file_path = '/g.1'").count()
    table.purge_files("/g", ["/g.1", "/g.2"])
    assert sum(read) and {r["file_path"] for r in table.read().collect()} == {"/g.0"}


def test_compaction_sorts_by_time_and_vacuum_drops_old_versions(spark, table):
    for k in range(4):
        table.upsert(entries(spark, 100, days=2, prefix=f"{k:016d}"))
    want = ids(table.read())
    table.compact("/g")
    table.compact("/h")
    assert ids(table.read()) == want and len(files_of(table)) == 4 == table.snapshot().manifest.select("grp", "dt").distinct().count()
    for f in files_of(table):
        times = [r["timestamp"] for r in spark.read.parquet(f"{table.root}/data/{f}").collect()]
        assert times == sorted(times)
    assert len(table.versions()) == 6
    table.vacuum(keep=1)
    assert len(table.versions()) == 1 and ids(table.read()) == want
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(f"{table.root}/data") for f in fs) == 4
    table.truncate()
    assert table.count() == 0 and not table.exists() and table.read().count() == 0


def test_another_format_is_dropped(spark, table, tmp_path):
    assert not table.prepare()
    os.makedirs(f"{table.root}/data/grp=g1/dt=2024-01-01")
    with open(f"{table.root}/version", "w") as f:
        f.write("2")
    assert table.prepare() and table.folder.names() == [] and not table.prepare()
    table.upsert(entries(spark, 5))
    assert not table.prepare() and table.count() == 5


# --- token filters -----------------------------------------------------------------------------------------------------

REQUESTS = (
    SearchRequest(query="item.17"), SearchRequest(query="other7 nonesuch"), SearchRequest(phrases={"path": ["p3/item.5", "Item.77"]}), SearchRequest(phrases={"user_agent": ["ander's BRÖWSER"], "path": ["p1"]}), SearchRequest(exact={"ip": ["10.3.1.7", "10.3.1.8"]}),
    SearchRequest(exact={"ip": [""]}), SearchRequest(query="!?"), SearchRequest(phrases={"path": ["/"]}), SearchRequest(query="words", start=START + DAY, end=START + 2 * DAY), SearchRequest(query="get", log_paths=["/g.1"]), SearchRequest(query="get", log_paths=["/h"], by_main_path=True),
    SearchRequest(query="nonesuch"), SearchRequest(exact={"browser": ["B"]}), SearchRequest(query="item.17", sort_by="_score"),
)


def test_searches_of_the_table_equal_those_of_its_rows(spark, table):
    for k in range(3):
        table.upsert(entries(spark, 260, seed=k, prefix=f"{k:016d}"))
    rows = table.read().cache()
    for request in REQUESTS:
        request.limit = 1000
        assert table.search(request).collect() == hits(rows, request).collect(), request
    rows.unpersist()


def test_searches_read_only_files_that_can_match(spark, table):
    table.upsert(entries(spark, 1200, days=6))
    every = table.snapshot().manifest.count()
    few = lambda **r: table.candidates(SearchRequest(**r)).count()
    # Eight of nine files have no such token; one in a thousand may be taken for one that has.
    assert every == 12 and few(query="item.601") <= 2 and few(phrases={"path": ["item.601"]}) <= 2 and few(query="nonesuch") == 0
    assert few(exact={"ip": ["10.3.1.7"]}) <= 3 and few(query="get") == every
    assert few(query="get", start=START, end=START + 1000) == 2 and few(query="get", log_paths=["/g"], by_main_path=True) == 6


def test_filters_lose_no_token_and_let_few_others_through(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 60_000, numPartitions=3).select(F.concat(F.lit("f"), F.spark_partition_id()).alias("_file"), F.concat_ws(" ", F.concat(F.lit("tok"), "id"), F.lit("common")).alias("raw"))
    for most in (skipping.MOST_TOKENS, 9_000):
        monkeypatch.setattr(skipping, "MOST_TOKENS", most)
        folder = str(tmp_path / f"tokens-{most}")
        skipping.write(rows, f"{folder}/c")
        files = spark.createDataFrame([(f"f{i}", "c") for i in range(3)], "file string, change string")
        own = lambda *tokens: {r["file"] for r in skipping.able(spark, folder, files, [[frozenset(tokens)]]).collect()}
        any_of = lambda *tokens: {r["file"] for r in skipping.able(spark, folder, files, [[frozenset([t]) for t in tokens]]).collect()}
        for i in (0, 19_999, 20_000, 59_999):
            assert f"f{i // 20_000}" in own(f"tok{i}", "common")
        assert own("common") == {"f0", "f1", "f2"} == any_of(*(f"tok{i}" for i in (3, 20_001, 40_007)))
        assert sum(len(any_of(*(f"no{k}-{i}" for i in range(8)))) for k in range(3)) <= 2


# --- stored sums -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_dashboards_from_sums_equal_those_from_rows(spark, table, zone):
    table.upsert(entries(spark, 900, days=4))
    table.upsert(entries(spark, 900, days=4).where("timestamp % 5 = 0").withColumn("ip", F.lit("10.0.0.9")))
    table.purge_file("/h", "/h.2")
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = table.read()
        for start, end, group in ((START + DAY, START + 3 * DAY, None), (START + DAY + 1234, START + 2 * DAY + 777, "/g"), (START + 5000, START + 5100, None), (START + 90 * DAY, START + 91 * DAY, None)):
            want = dash.dashboard(spark, rows if group is None else rows.where(F.col("main_log_path") == group), start, end)
            got = table.dashboard(start, end, group)
            assert {k: v.collect() for k, v in got.items()} == {k: v.collect() for k, v in want.items()}, (start, end, group)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_sums_do_not_grow_with_the_views(spark, tmp_path):
    sizes = []
    for times in (1, 8):
        table = EntryTable(spark, str(tmp_path / f"t{times}"))
        rows = entries(spark, 300, days=1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("id", F.concat("id", F.col("copy").cast("string"))).drop("copy")
        table.upsert(rows)
        assert table.count() == 300 * times
        sizes.append(table.sums().count())
    assert sizes[0] == sizes[1]


def test_merged_sketches_equal_one_of_all_rows(spark, table):
    for k in range(5):
        table.upsert(spark.range(k * 3000, k * 3000 + 5000).select(F.concat(F.lit(f"{k:016d}-"), "id").alias("id"), (F.lit(START) + F.col("id") * 20).alias("timestamp"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("ip"), F.lit("/g").alias("main_log_path"), F.lit(1).cast("long").alias("bytes_sent")))
    rows = table.read()
    exact, whole = rows.agg(F.count_distinct("ip"), F.hll_sketch_estimate(F.hll_sketch_agg("ip", rollup.REGISTERS))).first()
    got = table.distinct("ip").first()["n"]
    # Four times the standard error of so many registers; the union over days is the sketch of all rows, but for rounding.
    assert exact == 17_000 and abs(got - exact) <= 4 * rollup.STANDARD_ERROR * exact and abs(got - whole) <= 0.01 * exact
    first = rows.where(F.col("timestamp") < START + DAY).select("ip").distinct().count()
    day = table.distinct("ip", start_day="2025-01-01", end_day="2025-01-01").first()["n"]
    assert abs(day - first) <= 4 * rollup.STANDARD_ERROR * first and table.distinct("ip", "/none").first()["n"] == 0


def test_figures_of_groups(spark, table):
    table.upsert(entries(spark, 200))
    got = {r["main_log_path"]: (r["document_count"], r["first"], r["last"]) for r in table.groups().collect()}
    want = {r["main_log_path"]: tuple(r)[1:] for r in entries(spark, 200).groupBy("main_log_path").agg(F.count(F.lit(1)), F.min("timestamp"), F.max("timestamp")).collect()}
    assert got == want
    assert EntryTable(spark, f"{table.root}-{uuid.uuid4().hex}").groups().count() == 0
