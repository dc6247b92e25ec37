from __future__ import annotations

import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from weblake.operators.detail import completed, error_details
from weblake.operators.table import EntryTable, group_digest
from weblake.plans import catalog
from weblake.sources import files
from weblake.streaming.ingest import Ingestion

NOW = 1735740000


def line(i: int) -> str:
    return f'10.0.0.{i % 9} - - [01/Jan/2025:12:{i // 60 % 60:02d}:{i % 60:02d} +0000] "GET /id/{i:06d} HTTP/1.1" 200 {i} "-" "UA"\n'


def put(path, numbers, mode="w", end=""):
    with open(path, mode) as f:
        f.write("".join(map(line, numbers)) + end)


@pytest.fixture
def log(tmp_path):
    (tmp_path / "logs").mkdir()
    return str(tmp_path / "logs" / "access.log")


@pytest.fixture
def work(spark, tmp_path, log):
    return Ingestion(spark, str(tmp_path / "table"), [log])


def numbers(work):
    return sorted(int(r["path"].rsplit("/", 1)[1]) for r in work.table.read().select("path").collect())


def test_append_partial_line_and_repeat(work, log):
    put(log, range(5), end=line(5)[:30])
    assert work.round(NOW) == 1
    assert numbers(work) == [0, 1, 2, 3, 4]
    put(log, range(5))
    put(log, range(5, 9), "a")
    work.round(NOW)
    assert work.round(NOW) == 0
    assert numbers(work) == list(range(9))


def test_rename_rotation_with_unread_tail(work, log):
    put(log, range(4))
    work.round(NOW)
    put(log, range(4, 6), "a")
    os.rename(log, log + ".1")
    put(log, range(10, 13))
    work.round(NOW)
    assert numbers(work) == [0, 1, 2, 3, 4, 5, 10, 11, 12]


def test_copy_truncate_and_gzip(work, log):
    put(log, range(6))
    work.round(NOW)
    shutil.copy(log, log + ".1")
    with open(log + ".1", "rb") as f, gzip.open(log + ".1.gz", "wb") as g:
        g.write(f.read() + line(6).rstrip("\n").encode())
    os.remove(log + ".1")
    put(log, range(20, 22))
    work.round(NOW)
    assert numbers(work) == [0, 1, 2, 3, 4, 5, 6, 20, 21]


def test_gzip_of_several_members_and_names_in_capitals(work, log):
    put(log, [0])
    with open(log + ".2.GZ", "wb") as f:
        f.write(gzip.compress("".join(map(line, range(100, 200))).encode()) + gzip.compress("".join(map(line, range(200, 210))).encode()) + gzip.compress(b""))
    piece = next(p for p in files.plan(log, {}) if p.compressed)
    assert piece.end == sum(len(line(i)) for i in range(100, 210)) and files.trailer_size(piece.path) == 0
    work.round(NOW)
    assert numbers(work) == [0, *range(100, 210)] and work.states()[piece.path].position == piece.end
    assert work.round(NOW) == 0


def test_forged_trailer(work, log):
    """A trailer says the size modulo 2**32 only: a small one must not cut a file, nor make it void."""
    with open(log + ".1.gz", "wb") as f:
        data = bytearray(gzip.compress("".join(map(line, range(50))).encode()))
        f.write(bytes(data))
    work.round(NOW)
    whole = work.states()[log + ".1.gz"]
    with open(log + ".1.gz", "ab") as f:
        f.write(gzip.compress("".join(map(line, range(50, 60))).encode()))
    assert files.trailer_size(log + ".1.gz") < whole.position
    piece = files.plan(log, work.states())[0]
    assert (piece.start, piece.purge) == (whole.position, False) and piece.end > piece.start
    work.round(NOW)
    assert numbers(work) == list(range(60))


def test_unreadable_files_are_left_for_later(work, log):
    put(log, range(3))
    with open(log + ".1.gz", "wb") as f:
        f.write(gzip.compress("".join(map(line, range(10, 400))).encode())[:-300])
    assert work.round(NOW) == 1 and numbers(work) == [0, 1, 2] and log + ".1.gz" not in work.states()
    with open(log + ".1.gz", "wb") as f:
        f.write(gzip.compress("".join(map(line, range(10, 12))).encode()))
    work.round(NOW)
    assert numbers(work) == [0, 1, 2, 10, 11]


def test_parts_of_a_file_have_each_line_once(log):
    with open(log, "wb") as f:
        f.write(b"first\r\n\n" + b"z" * (files.LONGEST_LINE + 5) + b"\nb\xff\n  \n" + b"".join(b"line %d\n" % i for i in range(300)) + b"cut sho")
    piece = files.plan(log, {})[0]
    whole = [x for texts, offsets in files.lines(piece) for x in zip(texts, offsets)]
    assert whole[0] == (b"first", 0) and whole[1][0] == b"b\xff" and len(whole) == 302 and whole[-1][0] == b"line 299"
    for step in (1, 3, 7, 50, 4096, 10**6):
        parts = files.parts(piece, 997 if step < 50 else 5000 + step)
        assert len(parts) > 1 or step == 10**6
        got = [x for p in parts for texts, offsets in files.lines(p, step if step > 3 else 64) for x in zip(texts, offsets)]
        assert got == whole


def test_file_that_rotates_while_it_is_read(work, log):
    put(log, range(4))
    piece = files.plan(log, {})[0]
    os.rename(log, log + ".1")
    put(log, range(20, 40))
    assert not files.still_there(piece) and [t for texts, _ in files.lines(piece) for t in texts] == [line(i).rstrip().encode() for i in range(4)]
    work.round(NOW)
    assert numbers(work) == [0, 1, 2, 3, *range(20, 40)]


def test_round_that_fails_is_repeated_without_loss(work, log, monkeypatch):
    put(log, range(6))
    work.round(NOW)
    put(log, [0, 50])  # shorter: what was read is void
    for owner, broken in ((EntryTable, "upsert"), (EntryTable, "_commit"), (Ingestion, "_save")):
        with monkeypatch.context() as m:
            m.setattr(owner, broken, lambda *_, **__: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                work.round(NOW)
    work.round(NOW)
    assert numbers(work) == [0, 50]
    # A deletion that is cut short has deleted nothing.
    put(log, range(51, 60), "a")
    work.round(NOW)
    with monkeypatch.context() as m:
        m.setattr(EntryTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            work.table.purge_file(log, log)
    assert numbers(work) == [0, 50, *range(51, 60)]
    work.table.purge_file(log, log)
    assert work.table.count() == 0


def test_state_of_a_round_that_is_cut_short(work, log):
    put(log, range(3))
    work.round(NOW)
    os.makedirs(f"{work.state_path}/v{9:010d}")  # of an earlier format
    with open(f"{work.state_path}/.part", "w") as f:
        f.write('[{"path": ')  # a version that was not written to its end has no name yet
    assert work.states()[log].position == sum(len(line(i)) for i in range(3))


def test_rounds_made_at_once(spark, work, log, tmp_path, monkeypatch):
    """A second round between another's reading and saving: both read the same lines, none is lost or there twice."""
    other_log = log.replace("access", "other")
    put(log, range(5))
    put(other_log, range(100, 103))
    second, save = Ingestion(spark, work.table.root, [log, other_log]), Ingestion._save

    def late(self, *changed):
        monkeypatch.setattr(Ingestion, "_save", save)
        put(log, range(5, 8), "a")
        second.round(NOW)
        return save(self, *changed)

    monkeypatch.setattr(Ingestion, "_save", late)
    work.round(NOW)
    assert numbers(work) == [*range(8), 100, 101, 102] and set(work.states()) == {log, other_log}
    second.round(NOW)
    assert numbers(work) == [*range(8), 100, 101, 102]


def test_report_and_rejected_lines(work, log):
    put(log, range(6), end="a/b - - - x\n" + line(6).replace("/Jan/2025", "/Jan/2055"))
    work.round(NOW)
    assert (work.report.slices, work.report.processed, work.report.succeeded, work.report.failed) == (1, 8, 6, 2)
    assert work.report.lines_per_second > 0 and work.report.error_rate == 0.25 and work.report.bytes == os.path.getsize(log) - 8
    kept = work.rejected().collect()
    assert {r["raw"] for r in kept} == {"a/b - - - x", line(6).replace("/Jan/2025", "/Jan/2055").rstrip()} and {r["round"] for r in kept} == {NOW}
    group = work.group_states().first()
    assert (group["main_log_path"], group["files"], group["document_count"]) == (log, 1, 6) and group["last"] - group["first"] == 5
    work.round(NOW)
    assert work.report.processed == 0


def test_rebuild_of_all_groups(spark, tmp_path, log):
    other = log.replace("access", "other")
    put(log, range(3))
    put(other, range(10, 12))
    work = Ingestion(spark, str(tmp_path / "table"), [log, other])
    work.round(NOW)
    before = work.round
    work.round = lambda now, force=False: before(now, force) if work.groups != [other] else (_ for _ in ()).throw(OSError("unreadable"))
    assert work.rebuild(NOW) == {log: "indexed", other: "error: unreadable"}
    assert numbers(work) == [0, 1, 2, 10, 11] and work.groups == [log, other]


def test_entries_that_change_their_day(spark, tmp_path):
    table = EntryTable(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "id string, timestamp long, main_log_path string, file_path string, bytes_sent long")
    table.upsert(make([("a", NOW, "g", "f", 1), ("b", NOW - 3 * 86400, "g", "f", 2), ("c", NOW - 5 * 86400, "g", "f", 3)]))
    table.upsert(make([("b", NOW, "g", "f", 20)]))
    assert sorted((r["id"], r["bytes_sent"]) for r in table.read().collect()) == [("a", 1), ("b", 20), ("c", 3)]
    assert table.snapshot().manifest.select("dt").distinct().count() == 2


def test_groups_whose_digests_look_like_numbers(spark, tmp_path):
    table = EntryTable(spark, str(tmp_path / "t"))
    names, i = [], 0
    while len(names) < 2:
        if group_digest(f"/log/{i}")[1:].replace("e", "1", 1).isdigit():
            names.append(f"/log/{i}")
        i += 1
    make = lambda v: spark.createDataFrame([("a", NOW, n, "f", v) for n in names], "id string, timestamp long, main_log_path string, file_path string, bytes_sent long")
    table.upsert(make(1))
    table.upsert(make(2))
    table.drop_group(names[0])
    assert [(r["main_log_path"], r["bytes_sent"]) for r in table.read().collect()] == [(names[1], 2)] and table.count(names[1]) == 1


def test_stream_of_error_logs_and_rewritten_files(spark, tmp_path, log):
    other = log.replace("access", "error")
    work = Ingestion(spark, str(tmp_path / "table"), [log, other], {other})
    put(log, range(5))
    with open(other, "w") as f:
        f.write('2025/01/01 12:00:01 [error] 1#1: *1 bad, client: 1.2.3.4, server: s, request: "GET /x HTTP/1.1", host: "h"\n')
    work.stream(str(tmp_path / "ck"), NOW).awaitTermination(60)
    assert {r["level"]: r["count"] for r in work.table.read().groupBy("level").count().collect()} == {None: 5, "error": 1}
    put(log, [0, 70])
    work.stream(str(tmp_path / "ck"), NOW).awaitTermination(60)
    assert sorted(r["path"] for r in work.table.read(log).select("path").collect()) == ["/id/000000", "/id/000070"]


def test_parsers_of_ones_own(spark, tmp_path, log):
    put(log, range(2))
    agent = lambda c: F.struct(F.lit("Mine").alias("browser"), F.length(c).cast("string").alias("browser_version"), *(F.lit("").alias(n) for n in ("os", "os_version", "device_type")))
    place = lambda df, ranges: df.withColumns({c: F.lit("here" if c == "city" else None).cast("string") for c in ("region_code", "province", "city", "sub1", "sub2", "city_point")} | {"city_id": F.lit(7).cast("long")})
    work = Ingestion(spark, str(tmp_path / "table"), [log], ranges=spark.range(0), agent=agent, place=place)
    work.round(NOW)
    assert {(r["browser"], r["browser_version"], r["city"], r["city_id"]) for r in work.table.read().collect()} == {("Mine", "2", "here", 7)}


def test_rewrite_with_the_same_first_line_is_read_again(work, log):
    put(log, range(8))
    work.round(NOW)
    put(log, [0, 50])
    work.round(NOW)
    assert numbers(work) == [0, 50]


def test_blank_and_oversized_lines(work, log):
    put(log, range(2), end="\n\n" + "x" * 300_000 + "\n")
    put(log, [2], "a")
    work.round(NOW)
    assert numbers(work) == [0, 1, 2]


def test_forced_rebuild_and_table_upkeep(work, log):
    put(log, range(7))
    work.round(NOW)
    work.round(NOW, force=True)
    assert numbers(work) == list(range(7))
    work.table.compact(log)
    assert work.table.count(log, log) == 7
    work.table.purge_file(log, "/other", legacy_only=True)
    work.table.purge_file(log, log)
    assert work.table.count() == 0


def test_error_log(spark, tmp_path, log):
    entry = '2025/01/01 12:00:0{} [{}] 1#1: *{} bad, client: 1.2.3.4, server: s, request: "GET /x HTTP/1.1", host: "h"\n'
    with open(log, "w") as f:
        f.write("".join(entry.format(i, level, i + 1) for i, level in enumerate(("error", "warn", "crit", "info"))) + "   continued\n")
    work = Ingestion(spark, str(tmp_path / "table"), [log], {log})
    work.round(NOW)
    rows = error_details(work.table.read()).collect()
    assert completed(error_details(work.table.read())).where("upstream <> '' or protocol is not null or pid <> 1").count() == 0
    assert sorted(r["level"] for r in rows) == ["crit", "error", "info", "warn"] and {(r["ip"], r["path"], r["message"], r["host"]) for r in rows} == {("1.2.3.4", "/x", "bad", "h")}


def test_stale_groups_go_in_the_second_round(work, log):
    put(log, range(3))
    work.round(NOW)
    assert work.prune({log}) == set() and work.prune({"/other"}) == set()
    os.remove(log)
    assert work.prune(set()) == set()
    first = work.prune({"/other"})
    assert first == {log} and work.table.count() == 3
    work.prune({"/other"}, first)
    assert work.table.count() == 0 and work.states() == {}


def test_stream(spark, tmp_path, log):
    work = Ingestion(spark, str(tmp_path / "table"), [log])
    put(log, range(3))
    work.stream(str(tmp_path / "ck"), NOW).awaitTermination(60)
    put(log, range(3, 6), "a")
    work.stream(str(tmp_path / "ck"), NOW).awaitTermination(60)
    assert numbers(work) == list(range(6))


def test_planning_helpers(tmp_path, log):
    put(log, range(3))
    state = files.state_after(files.plan(log, {})[0], NOW)
    assert not files.plan(log, {log: state})
    assert files.throttled(state, log, files.BUSY_BYTES + 1, NOW + 60) and not files.throttled(state, log, files.BUSY_BYTES + 1, NOW + 3600)
    with open(log + ".2.gz", "w") as f:
        f.write("not gzip at all\n")
    assert not files.is_gzip(log + ".2.gz") and len(files.group_files(log)) == 2


def test_large_files_wait_only_while_no_other_file_changed(log, monkeypatch):
    monkeypatch.setattr(files, "BUSY_BYTES", 100)
    put(log, range(3))
    states = {log: files.state_after(files.plan(log, {})[0], NOW)}
    put(log, range(3, 6), "a")
    assert not files.plan(log, states, now=NOW + 60) and len(files.plan(log, states, now=NOW + 3600)) == 1
    os.rename(log, log + ".1")
    put(log, range(10, 13))
    assert [(p.path, p.start > 0) for p in files.plan(log, states, now=NOW + 60)] == [(log, False), (log + ".1", True)]


def test_upsert_keeps_the_last_of_an_id(spark, tmp_path):
    table = EntryTable(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "id string, timestamp long, main_log_path string, file_path string, bytes_sent long")
    assert not table.prepare()
    table.upsert(make([("a", NOW, "g", "f", 1), ("b", NOW, "g", "f", 2), ("a", NOW, "h", "f", 3), (None, NOW, "g", "f", 4)]))
    table.upsert(make([("a", NOW, "g", "f", 10)]))
    assert sorted((r["main_log_path"], r["id"], r["bytes_sent"]) for r in table.read().collect()) == [("g", "a", 10), ("g", "b", 2), ("h", "a", 3)]
    assert table.read("g", NOW, NOW + 1).count() == 2 and table.read("g", NOW + 1).count() == 0 and table.read(end=NOW).count() == 0
    table.drop_group("g")
    assert table.count() == 1


def test_catalogue_rollup(spark):
    ts = F.timestamp_seconds
    rows = [("/a.log", "/a.log", 9, 5, 1, 10, "indexed", 100), ("/a.log.1", "/a.log", 4, 5, 0, 8, "error", 50), ("/b.log.1", "/b.log", 1, 2, 3, 4, "queued", 7), ("/b.log.2", "/b.log", 2, 3, 2, 6, "indexed", 9)]
    states = spark.createDataFrame(rows, "path string, main_log_path string, document_count long, last_size long, s long, e long, index_status string, li long").select("*", ts("s").alias("timerange_start"), ts("e").alias("timerange_end"), ts("li").alias("last_indexed"), ts("li").alias("last_modified"), F.lit(1).alias("index_duration"))
    hosts = spark.createDataFrame([("/a.log", "access", "", ""), ("/new.log", "access", "", "")], "path string, type string, source string, config_file string")
    got = {r["path"]: (r["document_count"], r["last_size"], r["index_status"]) for r in catalog.groups(states, hosts).collect()}
    assert got == {"/a.log": (9, 5, "indexed"), "/b.log": (3, 5, "queued"), "/new.log": (0, 0, "not_indexed")}
    assert [r["main_log_path"] for r in catalog.stale(states, hosts).collect()] == ["/b.log"]


def test_large_compressed_content_is_dealt_to_tasks(work, log, monkeypatch):
    with gzip.open(log + ".1.gz", "wt") as f:
        f.write("".join(map(line, range(500))))
    put(log, range(500, 503))
    monkeypatch.setattr(files, "PART_BYTES", 4096)
    slices = work.plan({}, NOW)
    (packed,) = [s for s in slices if s.compressed]
    monkeypatch.setattr(files, "parts", lambda s, n=4096, parts=files.parts: parts(s, n))
    lines = work.lines(slices)
    want = -(-packed.end // 4096)
    assert want > 5 and lines.where("file_path like '%.gz'").select(F.spark_partition_id().alias("p")).distinct().count() > want // 2
    work.round(NOW)
    assert numbers(work) == list(range(503)) and work.report.processed == 503


def test_ids_that_come_twice_at_once(spark, tmp_path):
    table = EntryTable(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "id string, timestamp long, main_log_path string, file_path string, bytes_sent long")
    once, twice = make([("a", NOW, "g", "f", 1), ("a", NOW, "h", "f", 2)]), make([("a", NOW, "g", "f", 1), ("a", NOW - 3 * 86400, "g", "f", 1), ("b", NOW, "g", "f", 5)])
    assert table._write_unique(once, "one") == "one" and table._write_unique(twice, "two") != "two" and not table.folder.has("data/two")
    table.upsert(twice)
    assert sorted((r["id"], r["bytes_sent"]) for r in table.read().collect()) == [("a", 1), ("b", 5)] and table.count() == 2
