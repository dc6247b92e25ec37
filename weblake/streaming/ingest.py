"""Incremental ingestion: rounds over log groups, and the same as a stream."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.access import access_entry, valid_entry, with_entry
from ..functions.errorlog import error_entry
from ..functions.useragent import user_agent, with_user_agent
from ..operators.geography import locate
from ..operators.table import ConflictError, EntryTable, Folder, document_id
from ..shipping import ship
from ..sources import files
from ..sources.rotated_log import RotatedLogSource

_REJECTED_SCHEMA = "raw string, offset long, file_path string, main_log_path string, fingerprint string"
_REJECTED = [c.split()[0] for c in _REJECTED_SCHEMA.split(", ")]
_PLACES = ("region_code", "province", "city", "sub1", "sub2", "city_point")


def parsed_access(lines: DataFrame, now: int, split: bool = False) -> DataFrame:
    """Lines with their fields, ``_e``: null where a line is none, and ``_ok``: whether they are plausible at ``now``.  ``split`` reads
    lines of the common form without the pattern; its result is to be persisted before it is filtered, since Spark would move a
    filter below each of its steps and write them all into it."""
    rows = with_entry(lines, F.lit(now)) if split else lines.withColumn("_e", access_entry(F.col("raw"), F.lit(now)))
    named = rows.select("*", *(F.col(f"_e.{c}").alias(c) for c in ("ip", "timestamp", "method", "path", "status")))
    return named.select(*lines.columns, "_e", F.coalesce(F.col("_e").isNotNull() & valid_entry(F.lit(now)), F.lit(False)).alias("_ok"))


def enriched(parsed: DataFrame, ranges: DataFrame | None = None, agent: Callable[[Column], Column] = user_agent, place: Callable[[DataFrame, DataFrame], DataFrame] = locate) -> DataFrame:
    """Entries of parsed lines.  Agents and addresses are classified once for each of their values, so ``parsed`` is read for each of
    them and should be persisted."""
    rows = parsed.where("_ok").select(
        document_id(F.col("fingerprint"), F.col("offset")).alias("id"), "_e.*", F.col("_e.path").alias("path_exact"), "file_path", "main_log_path", "raw", F.lit(None).cast("string").alias("level")
    )
    entries = with_user_agent(rows, parser=agent)
    if ranges is not None:
        return place(entries, ranges)
    return entries.withColumns({c: F.lit(None).cast("string") for c in _PLACES} | {"city_id": F.lit(None).cast("long")})


def access_entries(lines: DataFrame, now: int, ranges: DataFrame | None = None, agent: Callable[[Column], Column] = user_agent, place: Callable[[DataFrame, DataFrame], DataFrame] = locate) -> DataFrame:
    """Entries of access lines that are plausible at ``now``; ``agent`` and ``place`` may be parsers of one's own."""
    return enriched(parsed_access(lines, now), ranges, agent, place)


def parsed_errors(lines: DataFrame) -> DataFrame:
    """Lines with their fields, ``_e``, and ``_ok``: whether they are error lines."""
    rows = lines.withColumn("_e", error_entry(F.col("raw")))
    return rows.withColumn("_ok", F.col("_e").isNotNull())


def error_entries(lines: DataFrame) -> DataFrame:
    """Entries of error lines; what else they hold is read from ``raw`` when asked for."""
    return errors_of(parsed_errors(lines))


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("_ok").select(
        document_id(F.col("fingerprint"), F.col("offset")).alias("id"), "_e.timestamp", F.coalesce("_e.client", F.lit("")).alias("ip"), F.coalesce("_e.method", F.lit("")).alias("method"), F.coalesce("_e.path", F.lit("")).alias("path"), F.coalesce("_e.path", F.lit("")).alias("path_exact"),
        F.lit(0).alias("status"), F.lit(0).cast("long").alias("bytes_sent"), F.col("_e.referrer").alias("referer"), "_e.level", "file_path", "main_log_path", "raw",
    )


def counted(lines: DataFrame) -> DataFrame:
    """One row: lines read, parsed, not parsed, and the share of those."""
    ok = access_entry(F.col("raw")).isNotNull().cast("int")
    return lines.agg(F.count(F.lit(1)).alias("processed"), F.sum(ok).alias("succeeded")).select("processed", "succeeded", (F.col("processed") - F.col("succeeded")).alias("failed"), ((F.col("processed") - F.col("succeeded")) / F.col("processed")).alias("error_rate"))


@dataclass(frozen=True)
class Report:
    """What a round did: slices and lines read, lines that are entries and lines that are not, bytes of lines, and seconds."""

    slices: int = 0
    processed: int = 0
    succeeded: int = 0
    failed: int = 0
    bytes: int = 0
    seconds: float = 0.0

    @property
    def error_rate(self) -> float:
        return self.failed / self.processed if self.processed else 0.0

    @property
    def lines_per_second(self) -> float:
        return self.processed / self.seconds if self.seconds else 0.0


def content_sizes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """The sizes of compressed files' contents, read on the executors; files that cannot be read have none."""

    def sizes(batches):
        for batch in batches:
            out = {}
            for path in batch.column(0).to_pylist():
                try:
                    out[path] = files.content_size(path)
                except files.UNREADABLE:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(out.values(), pa.int64())], ["path", "size"])

    if not paths:
        return {}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return {r["path"]: r["size"] for r in rows.mapInArrow(sizes, "path string, size long").collect()}


class Ingestion:
    """Rounds that bring a table up to date with its log groups.  States are kept beside the table, a new version each round,
    and ids are made of content and place, so a round that is repeated after a failure changes nothing.  A file that cannot be
    read, or is replaced while it is read, keeps its old state and is tried again in the next round."""

    def __init__(self, spark: SparkSession, root: str, groups: list[str], error_logs: set[str] = frozenset(), ranges: DataFrame | None = None, agent: Callable[[Column], Column] = user_agent, place: Callable[[DataFrame, DataFrame], DataFrame] = locate):
        self.spark, self.table, self.groups, self.error_logs, self.ranges = spark, EntryTable(spark, root), groups, set(error_logs), ranges
        self.agent, self.place = agent, place
        self.state_path = f"{root.rstrip('/')}/file_state"
        self.folder = Folder(spark, self.state_path)
        self.rejected_path = f"{root.rstrip('/')}/rejected"
        self.report = Report()
        ship(spark)
        spark.dataSource.register(RotatedLogSource)

    def _versions(self) -> list[str]:
        """Versions of the states, oldest first; each is a file that is there whole or not at all."""
        return [n for n in self.folder.names() if n.startswith("s")]

    def states(self) -> dict[str, files.FileState]:
        versions = self._versions()
        rows = json.loads(self.folder.read(versions[-1])) if versions else []
        return {r["path"]: files.FileState(**r) for r in rows}

    def _save(self, changed: dict[str, files.FileState], gone: Callable[[files.FileState], bool] = lambda _: False) -> None:
        """The states as they are now, with what this round changed, as a version of its own; the last two stay.  Of two rounds at
        once the second takes what the first has saved."""
        for _ in range(100):
            versions = self._versions()
            states = {p: s for p, s in self.states().items() if not gone(s)} | changed
            name = f"s{int(versions[-1][1:]) + 1 if versions else 1:010d}"
            if self.folder.put(name, json.dumps([s.json() for s in states.values()])):
                for old in versions[:-1]:
                    self.folder.delete(old)
                return
        raise ConflictError("the states were changed by others again and again")

    def plan(self, states: dict[str, files.FileState], now: int, force: bool = False) -> list[files.Slice]:
        """What is to be read; compressed contents are measured on the executors."""
        own = {g: {p: s for p, s in states.items() if s.main_log_path == g} for g in self.groups}
        asked: list[str] = []

        def ask(path: str) -> int:
            asked.append(path)
            return 0

        for group in self.groups:
            files.plan(group, own[group], force, now=now, measure=ask)
        sizes = content_sizes(self.spark, list(dict.fromkeys(asked)))

        def known(path: str) -> int:
            if path not in sizes:
                raise OSError(path)
            return sizes[path]

        return [piece for group in self.groups for piece in files.plan(group, own[group], force, now=now, measure=known)]

    def _load(self, lines: DataFrame, now: int) -> Report:
        """Parses lines once: their entries are upserted, the others kept in ``rejected``, and both are counted."""
        began = time.perf_counter()
        is_error = F.col("main_log_path").isin(sorted(self.error_logs)) if self.error_logs else F.lit(False)
        kinds = [(parsed_access(lines.where(~is_error) if self.error_logs else lines, now, split=True), lambda rows: enriched(rows, self.ranges, self.agent, self.place))]
        if self.error_logs:
            kinds.append((parsed_errors(lines.where(is_error)), errors_of))
        held = [(parsed.persist(StorageLevel.MEMORY_AND_DISK), entries) for parsed, entries in kinds]
        try:
            # Counting comes first: it is one stage, so each line is parsed by one task; the stages of an upsert begin together and
            # would each parse what the others have not kept yet.
            count = lambda rows: rows.agg(F.count(F.lit(1)), F.count_if("_ok"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
            processed, succeeded, size = map(sum, zip(*(count(parsed) for parsed, _ in held)))
            # Entries of both kinds in one change, so that a round is there whole or not at all.
            self.table.upsert(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (entries(parsed) for parsed, entries in held)))
            if processed > succeeded:
                rejected = reduce(DataFrame.union, (parsed.where("not _ok").select(*_REJECTED) for parsed, _ in held))
                rejected.withColumn("round", F.lit(int(now))).write.mode("append").parquet(self.rejected_path)
        finally:
            for parsed, _ in held:
                parsed.unpersist()
        return Report(0, processed, succeeded, processed - succeeded, size, time.perf_counter() - began)

    def rejected(self) -> DataFrame:
        """(raw, offset, file_path, main_log_path, fingerprint, round): lines that are no entries; a line that was read in several
        rounds is there once for each of them."""
        if not self.table.folder.has("rejected"):
            return self.spark.createDataFrame([], f"{_REJECTED_SCHEMA}, round long")
        return self.spark.read.schema(f"{_REJECTED_SCHEMA}, round long").parquet(self.rejected_path)

    def lines(self, slices: list[files.Slice]) -> DataFrame:
        """The lines of slices.  One task reads a compressed file, so what a large one holds is dealt to as many tasks as a plain file of its
        content would have; parsing a line takes far longer than reading it."""
        read = lambda some: self.spark.read.format("rotated_log").option("slices", json.dumps([asdict(s) for s in some])).load()
        tasks = {s.path: len(files.parts(replace(s, compressed=False))) for s in slices if s.compressed}
        large = [s for s in slices if tasks.get(s.path, 0) > 1]
        if not large:
            return read(slices)
        dealt = read(large).repartition(sum(tasks[s.path] for s in large), "file_path", "offset")
        rest = [s for s in slices if tasks.get(s.path, 0) <= 1]
        return read(rest).union(dealt) if rest else dealt

    def round(self, now: int, force: bool = False) -> int:
        """Reads what is new; how many slices there were.  ``report`` tells more of the last round."""
        self.report = Report()
        states = self.states()
        slices = self.plan(states, now, force)
        if not slices:
            return 0
        void: dict[str, list[str]] = {}
        for piece in slices:
            if piece.purge or force:
                void.setdefault(piece.main_log_path, []).append(piece.path)
        for group, paths in void.items():
            self.table.purge_files(group, paths)
        self.report = replace(self._load(self.lines(slices), now), slices=len(slices))
        self._save({s.path: files.state_after(s, now) for s in slices if files.still_there(s)})
        return len(slices)

    def group_states(self) -> DataFrame:
        """(main_log_path, files, last_indexed, document_count, first, last) of each group that was read or has rows: the counts and
        the range of times are those of the table, so they are exact after every round."""
        schema = "main_log_path string, files long, last_indexed double"
        by: dict[str, list[float]] = {}
        for s in self.states().values():
            by.setdefault(s.main_log_path, []).append(s.indexed)
        read = self.spark.createDataFrame([(g, len(times), max(times)) for g, times in by.items()], schema)
        counts = read.join(self.table.groups(), "main_log_path", "full")
        return counts.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "document_count")})

    def rebuild(self, now: int, groups: list[str] | None = None) -> dict[str, str]:
        """Reads groups (all) anew, one after the other in the order they are listed in, and what became of each: ``indexed``, or
        ``error`` and why.  A group that fails keeps its rows and states, and the others go on."""
        out, every = {}, self.groups
        try:
            for group in every if groups is None else groups:
                self.groups = [group]
                try:
                    self.round(now, force=True)
                    out[group] = "indexed"
                except Exception as e:  # noqa: BLE001  whatever a group's files raise is that group's result
                    out[group] = f"error: {e}".splitlines()[0]
        finally:
            self.groups = every
        return out

    def prune(self, listed: set[str], before: set[str] = frozenset()) -> set[str]:
        """Removes groups that the host does not list, whose file is gone, and that the round ``before`` found stale too; the
        groups found stale now.  With nothing listed nothing is stale."""
        states = self.states()
        stale = {s.main_log_path for s in states.values() if listed and s.main_log_path not in listed and not os.path.exists(s.main_log_path)}
        gone = stale & before
        for group in sorted(gone):
            self.table.drop_group(group)
        if gone:
            self._save({}, lambda s: s.main_log_path in gone)
        return stale - gone

    def stream(self, checkpoint: str, now: int, every: str | None = None):
        """The same as a streaming query: all that is there (default), or rounds ``every`` interval."""
        lines = self.spark.readStream.format("rotated_log").option("groups", json.dumps(self.groups)).load()

        def write(batch: DataFrame, _: int) -> None:
            for r in batch.where("rewritten").select("main_log_path", "file_path").distinct().collect():
                self.table.purge_files(r["main_log_path"], [r["file_path"]])
            self.report = self._load(batch, now)

        writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
