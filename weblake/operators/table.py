"""The ``entries`` table on Parquet: snapshots of immutable files, upserts by id, deletions, compaction and counts.

A change writes new files (by log group and day, sorted by time) and then a manifest: a row for each live file with its rows, times,
log files and ranges of ids.  The manifest becomes the table's next version in one step, so a reader sees a change whole or not at
all, a change that is cut short leaves the table as it was, and of two changes made at once the second finds its version taken
and is worked out again on the first.  A table read once keeps its files until ``vacuum`` drops its version.

Manifests choose the files that a read, an upsert, a deletion or a count touches.  An upsert of ids that lie outside the ranges of
all files adds files and reads none; otherwise the ids of the files at hand are read, and only files that hold one of the new ids are
written anew.  Beside each change lie the token filters of its files (see ``skipping``) and their sums (see ``rollup``)."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENTRIES
from . import dashboard, rollup, skipping
from .search import SCORE, SearchRequest, hits

FORMAT = 3
_PARTS = ("grp", "dt")
#: A file with more pairs of a log file and a beginning of ids than this counts as having rows of any log and any id.
MOST_PAIRS = 256
MANIFEST = (
    "file string, change string, grp string, dt date, main_log_path string, rows long, bytes long, low long, high long, "
    "origins map<string,bigint>, stems map<string,struct<low:bigint,high:bigint>>"
)
_FIELDS = ("file", "change", "grp", "dt", "main_log_path", "rows", "bytes", "low", "high", "origins", "stems")


def document_id(fingerprint, offset):
    """``<16 digits>-<offset>``, unique in a group."""
    return F.concat(F.substring(fingerprint, 1, 16), F.lit("-"), offset.cast("string"))


def is_document_id(column):
    return column.rlike("^[0-9a-f]{16}-[0-9]+$")


def compact_nulls(rows: DataFrame) -> DataFrame:
    """Empty strings of optional columns and request times of 0 become null."""
    optional = ("region_code", "province", "city", "c1", "c2", "c3", "c4", "protocol", "referer", "user_agent", "browser", "browser_version", "os", "os_version", "device_type", "level", "sub1", "sub2", "city_point")
    out = {c: F.nullif(F.col(c), F.lit("")) for c in optional if c in rows.columns}
    if "request_time" in rows.columns:
        out["request_time"] = F.when(F.col("request_time") > 0, F.col("request_time"))
    return rows.withColumns(out)


def acceptable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a group."""
    return rows.where("id is not null and id <> '' and main_log_path is not null and main_log_path <> ''")


def keep_last(rows: DataFrame, order: str = "_seq") -> DataFrame:
    """One row of each (group, id): the one written last."""
    latest = Window.partitionBy("main_log_path", "id").orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def group_digest(log_group: str) -> str:
    """The name of a group's partition; its first letter keeps Spark from reading digits as a number."""
    return "g" + hashlib.md5(log_group.encode()).hexdigest()[:12]


class Folder:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._jvm = spark._jvm
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._new(f"{self.path}/{name}" if name else self.path)

    def names(self, inner: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(inner))) if self._fs.exists(self._at(inner)) else []

    def ages(self, inner: str) -> dict[str, float]:
        """Seconds since each entry was changed."""
        found = self._fs.listStatus(self._at(inner)) if self._fs.exists(self._at(inner)) else []
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in found}

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """A small file that is there whole or not at all; False if the name is taken."""
        partial = self._at(f".{uuid.uuid4().hex}")
        out = self._fs.create(partial, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        done = not self._fs.exists(self._at(name)) and self._fs.rename(partial, self._at(name))
        if not done:
            self._fs.delete(partial, False)
        return done


class ConflictError(RuntimeError):
    """A change that lost against others again and again."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a table: its manifest, and the schema of its rows."""

    version: int
    manifest: DataFrame
    schema: T.StructType
    name: str = ""


class EntryTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    # --- versions ------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in self.folder.names("versions") if n.startswith("v")]

    def _meta(self, version: int) -> dict:
        return json.loads(self.folder.read(f"versions/v{version:010d}"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The table as it is now, or as it was at a version that is still kept."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Snapshot(0, self.spark.createDataFrame([], MANIFEST), ENTRIES)
        meta = self._meta(version)
        manifest = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{meta['manifest']}")
        return Snapshot(version, manifest, T.StructType.fromJson(meta["schema"]), meta["manifest"])

    def exists(self) -> bool:
        return bool(self.versions()) and not self.snapshot().manifest.isEmpty()

    def _commit(self, change: Callable[[Snapshot, str], tuple[DataFrame, T.StructType] | None], attempts: int = 10) -> bool:
        """Makes the manifest that ``change`` derives from the current snapshot the next version.  Where another change took that
        version, it is derived again; None leaves the table as it is."""
        for _ in range(attempts):
            before, name = self.snapshot(), uuid.uuid4().hex
            derived = change(before, name)
            if derived is None:
                return False
            manifest, schema = derived
            manifest.select(*_FIELDS).coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
            meta = {"format": FORMAT, "manifest": name, "schema": json.loads(schema.json())}
            if self.folder.put(f"versions/v{before.version + 1:010d}", json.dumps(meta)):
                return True
        raise ConflictError(f"{attempts} versions were taken by other changes")

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> None:
        """Drops all but the last versions, the files that only they had, and what changes that were cut short left more than
        ``hours`` ago."""
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        manifest = lambda v: self.snapshot(v).manifest.select("file", "change")
        live = {r["change"] for v in kept for r in manifest(v).select("change").distinct().collect()}
        names = {self._meta(v)["manifest"] for v in kept}
        for v in old:
            gone = manifest(v)
            for k in kept:
                gone = gone.join(manifest(k).select("file"), "file", "left_anti")
            for r in gone.collect():
                # A change of which no file is left goes whole, with what lies beside it.
                for kind in ("data", "tokens", "sums") if r["change"] not in live else ():
                    self.folder.delete(f"{kind}/{r['change']}")
                self.folder.delete(f"data/{r['file']}")
            self.folder.delete(f"manifests/{self._meta(v)['manifest']}")
            self.folder.delete(f"versions/v{v:010d}")
        for kind, used in (("data", live), ("tokens", live), ("sums", live), ("manifests", names)):
            for name, age in self.folder.ages(kind).items():
                if name not in used and age > hours * 3600:
                    self.folder.delete(f"{kind}/{name}")

    # --- reading -------------------------------------------------------------------------------------------------------

    def load(self, snapshot: Snapshot, files: DataFrame) -> DataFrame:
        """The rows of some files of a snapshot."""
        paths = [f"{self.root}/data/{r['file']}" for r in files.select("file").collect()]
        if not paths:
            return self.spark.createDataFrame([], snapshot.schema)
        return self.spark.read.schema(snapshot.schema).parquet(*sorted(paths))

    @staticmethod
    def _chosen(manifest: DataFrame, log_group: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        if log_group is not None:
            mine = F.coalesce(F.col("main_log_path") == log_group, F.lit(True))
            manifest = manifest.where((F.col("grp") == group_digest(log_group)) & mine)
        if start is not None:
            manifest = manifest.where(F.col("high") >= start)
        return manifest if end is None else manifest.where(F.col("low") < end)

    def read(self, log_group: str | None = None, start: int | None = None, end: int | None = None, version: int | None = None) -> DataFrame:
        """The rows of a group and of [start, end): only files that can hold such rows are read."""
        snapshot = self.snapshot(version)
        rows = self.load(snapshot, self._chosen(snapshot.manifest, log_group, start, end))
        if log_group is not None:
            rows = rows.where(F.col("main_log_path") == log_group)
        if start is not None:
            rows = rows.where(F.col("timestamp") >= start)
        return rows if end is None else rows.where(F.col("timestamp") < end)

    def candidates(self, request: SearchRequest, snapshot: Snapshot | None = None) -> DataFrame:
        """The manifest's rows of the files that can hold a match: by time, log and the tokens of the request."""
        snapshot = snapshot or self.snapshot()
        files = self._chosen(snapshot.manifest, None, request.start, request.end)
        if request.log_paths and request.by_main_path:
            files = files.where(F.col("main_log_path").isNull() | F.col("main_log_path").isin(request.log_paths))
        elif request.log_paths:
            listed = F.arrays_overlap(F.map_keys("origins"), F.array(*map(F.lit, request.log_paths)))
            files = files.where(F.coalesce(listed, F.lit(True)))
        return skipping.able(self.spark, f"{self.root}/tokens", files, skipping.needed(request))

    def search(self, request: SearchRequest) -> DataFrame:
        """``search.hits`` on the files that can hold a match.  Scores need the statistics of all entries, so an order by them
        reads all files."""
        request.validate()
        snapshot = self.snapshot()
        files = snapshot.manifest if request.sort_by == SCORE else self.candidates(request, snapshot)
        return hits(self.load(snapshot, files), request)

    def sums(self, log_group: str | None = None, start: int | None = None, end: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The stored sums of the files that can hold rows of a group and of [start, end); a file that holds several groups counts
        for each of them."""
        return rollup.stored(self.spark, f"{self.root}/sums", self._chosen((snapshot or self.snapshot()).manifest, log_group, start, end))

    def dashboard(self, start: int, end: int, log_group: str | None = None) -> dict[str, DataFrame]:
        """``dashboard.dashboard`` from stored sums.  Only hours that the window cuts are read, or, where the days of the session's zone
        do not begin with an hour, all of its rows."""
        dashboard.check_window(start, end)
        snapshot, near = self.snapshot(), (start - dashboard.BUFFER, end + dashboard.BUFFER)
        several = not self._chosen(snapshot.manifest, log_group, *near).where("main_log_path is null").isEmpty() if log_group is not None else False
        rows = self.read(log_group, *near, version=snapshot.version or None)
        if several or not rollup.whole_hours(self.spark, start, end):
            return dashboard.dashboard(self.spark, rows, start, end)
        counted = rollup.window_cells(self.sums(log_group, *near, snapshot=snapshot), rows, start, end)
        return dashboard.parts(self.spark, dashboard.figures(counted), start, end)

    def distinct(self, column: str, log_group: str | None = None, start_day: str | None = None, end_day: str | None = None) -> DataFrame:
        """One row, ``n``: about how many distinct values a column has in a group and from one day to another, both included, from
        the files' sketches alone."""
        files = self._chosen(self.snapshot().manifest, log_group)
        for day, compare in ((start_day, "dt >= '{}'"), (end_day, "dt <= '{}'")):
            files = files.where(compare.format(day)) if day else files
        return rollup.distinct(rollup.stored(self.spark, f"{self.root}/sums", files), column)

    # --- changes -------------------------------------------------------------------------------------------------------

    def _placed(self, rows: DataFrame) -> DataFrame:
        digest = F.concat(F.lit("g"), F.substring(F.md5(F.col("main_log_path").cast("binary")), 1, 12))
        return rows.withColumns({"grp": digest, "dt": F.to_date(F.timestamp_seconds("timestamp"))})

    def _write_data(self, rows: DataFrame, change: str) -> None:
        # Spark splits large days and joins small ones, so files have an even size; in each of them time goes up.
        even = self._placed(rows).hint("rebalance", *_PARTS)
        even.sortWithinPartitions(*_PARTS, "timestamp", "id").write.partitionBy(*_PARTS).parquet(f"{self.root}/data/{change}")

    def _write_unique(self, rows: DataFrame, change: str) -> str:
        """Writes rows, one of each (group, id), and the change that they are in.  Ids rarely come twice, so rows are written as they are and
        only their ids are compared; where some do, the rows are written once more without the others."""
        self._write_data(rows, change)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{change}")
        if written.groupBy("main_log_path", "id").count().where("count > 1").isEmpty():
            return change
        again = uuid.uuid4().hex
        self._write_data(keep_last(written.withColumn("_seq", F.lit(0))).drop("_seq"), again)
        self.folder.delete(f"data/{change}")
        return again

    def _described(self, of: T.StructType, change: str) -> DataFrame:
        """Writes the token filters and sums of a change's files; the manifest's rows of the files."""
        data = f"{self.root}/data/{change}"
        schema = T.StructType([*of, T.StructField("grp", T.StringType()), T.StructField("dt", T.DateType())])
        path = F.substring_index("_metadata.file_path", "/data/", -1)
        written = self.spark.read.schema(schema).parquet(data).withColumns({"_file": path, "_bytes": F.col("_metadata.file_size")})
        skipping.write(written, f"{self.root}/tokens/{change}")
        rollup.write(written, f"{self.root}/sums/{change}")
        # One pass: rows by file, log and origin of ids are few where a file has few of both; of others only the count is kept.
        few = written.groupBy("_file", F.coalesce(_column(written, "file_path"), F.lit("")).alias("origin"), _stem().alias("stem")).agg(
            F.first("grp").alias("grp"), F.first("dt").alias("dt"), F.first("_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"),
            F.min("main_log_path").alias("m0"), F.max("main_log_path").alias("m1"), F.min(_number()).alias("i0"), F.max(_number()).alias("i1"),
        )
        place = F.row_number().over(Window.partitionBy("_file").orderBy("stem", "origin"))
        listed = F.collect_list(F.when(F.col("_n") <= MOST_PAIRS, F.struct("origin", "stem", "n", "i0", "i1")))
        every = few.withColumn("_n", place).groupBy("_file").agg(
            F.first("grp").alias("grp"), F.first("dt").alias("dt"), F.first("bytes").alias("bytes"), F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.min("m0").alias("m0"), F.max("m1").alias("m1"), F.when(F.max("_n") <= MOST_PAIRS, listed).alias("pairs"),
        )
        return self.spark.createDataFrame([_manifest_row(r, change) for r in every.toLocalIterator()], MANIFEST)

    def _write(self, rows: DataFrame, change: str) -> DataFrame:
        """Writes rows to files of a change, with their token filters and sums; the manifest's rows of the files."""
        self._write_data(rows, change)
        return self._described(rows.schema, change)

    def _overlapping(self, live: DataFrame, fresh: DataFrame) -> DataFrame:
        """The live files whose ranges of ids meet those of fresh ones in the same group."""
        ranged = lambda m, p: m.select("grp", F.col("file").alias(f"{p}file"), F.explode("stems").alias("stem", f"{p}r"))
        a, b = ranged(live, "a"), ranged(fresh, "b")
        met = a.join(b, ["grp", "stem"]).where("ar.low <= br.high and br.low <= ar.high").select(F.col("afile").alias("file"))
        # A file without ranges can hold any id.
        open_ = live.where("stems is null").join(fresh.select("grp"), "grp", "left_semi").select("file")
        wide = live.join(fresh.where("stems is null").select("grp"), "grp", "left_semi").select("file")
        return met.union(open_).union(wide).distinct()

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows; one with the id of another of its group replaces it, on whatever day that was."""
        unique = acceptable(compact_nulls(rows))
        change = self._write_unique(unique, uuid.uuid4().hex)
        fresh = self._described(unique.schema, change)
        if fresh.isEmpty():
            return
        ids = self.spark.read.schema(unique.schema).parquet(f"{self.root}/data/{change}").select("main_log_path", "id")

        def derive(before: Snapshot, name: str):
            schema = _merged(before.schema if before.version else None, unique.schema)
            near = before.manifest.join(self._overlapping(before.manifest, fresh), "file", "left_semi")
            files = near.select("file").collect()
            if not files:
                return before.manifest.unionByName(fresh), schema
            # Ids only: which files hold one of the new ones.
            path = F.regexp_extract("_metadata.file_path", "[0-9a-f]{32}/grp=[^/]*/dt=[^/]*/[^/]*$", 0)
            held = self.load(before, near).select(path.alias("file"), "main_log_path", "id").join(ids, ["main_log_path", "id"], "left_semi")
            hit = self.spark.createDataFrame(held.select("file").distinct().collect(), "file string")
            stay = before.manifest.join(F.broadcast(hit), "file", "left_anti").unionByName(fresh)
            if hit.isEmpty():
                return stay, schema
            left = self.load(before, hit).join(ids, ["main_log_path", "id"], "left_anti")
            return stay.unionByName(self._write(left, name)), schema

        self._commit(derive)

    def _rewritten(self, touched: Callable[[DataFrame], DataFrame], whole: Column, kept: Callable[[DataFrame], DataFrame]) -> None:
        """Drops ``touched`` files; of those that are not ``whole`` to go, ``kept`` rows are written anew."""

        def derive(before: Snapshot, name: str):
            files = touched(before.manifest).withColumn("_whole", whole)
            rows = files.select("file", "_whole").collect()
            if not rows:
                return None
            gone = self.spark.createDataFrame([(r["file"],) for r in rows], "file string")
            part = self.spark.createDataFrame([(r["file"],) for r in rows if not r["_whole"]], "file string")
            stay = before.manifest.join(F.broadcast(gone), "file", "left_anti")
            if part.isEmpty():
                return stay, before.schema
            return stay.unionByName(self._write(kept(self.load(before, part)), name)), before.schema

        self._commit(derive)

    def purge_files(self, log_group: str, file_paths: list[str], legacy_only: bool = False) -> None:
        """Deletes the files' rows, or only if some of them have ids of another form.  Parquet files that hold no other rows are
        not read."""
        own = F.col("file_path").isin(file_paths) & (F.col("main_log_path") == log_group)
        listed = F.array(*map(F.lit, file_paths))
        touched = lambda m: self._chosen(m, log_group).where(F.coalesce(F.arrays_overlap(F.map_keys("origins"), listed), F.lit(True)))
        if legacy_only:
            before = self.snapshot()
            if self.load(before, touched(before.manifest)).where(own & ~is_document_id(F.col("id"))).isEmpty():
                return
        whole = F.coalesce((F.col("main_log_path") == log_group) & (F.size(F.array_except(F.map_keys("origins"), listed)) == 0), F.lit(False))
        self._rewritten(touched, whole, lambda rows: rows.where(~F.coalesce(own, F.lit(False))))

    def purge_file(self, log_group: str, file_path: str, legacy_only: bool = False) -> None:
        self.purge_files(log_group, [file_path], legacy_only)

    def drop_group(self, log_group: str) -> None:
        self._rewritten(lambda m: self._chosen(m, log_group), F.col("main_log_path").isNotNull(), lambda rows: rows.where(F.col("main_log_path") != log_group))

    def truncate(self) -> None:
        """Empties the table; earlier versions go as well."""
        self._commit(lambda before, _: (before.manifest.limit(0), ENTRIES))
        self.vacuum(keep=1, hours=0)

    def compact(self, log_group: str, small: int = 64 * 2**20) -> None:
        """Writes days that are in several files, or in a small one beside others, in few files sorted by time."""
        several = Window.partitionBy("grp", "dt")

        def touched(manifest: DataFrame) -> DataFrame:
            own = self._chosen(manifest, log_group).withColumn("_n", F.count(F.lit(1)).over(several))
            return own.where((F.col("_n") > 1) & (F.col("bytes") < small)).drop("_n")

        self._rewritten(touched, F.lit(False), lambda rows: rows)
        self.vacuum()

    # --- counts --------------------------------------------------------------------------------------------------------

    def count(self, log_group: str | None = None, file_path: str | None = None) -> int:
        """Rows, from the manifest alone where it tells."""
        snapshot = self.snapshot()
        files = self._chosen(snapshot.manifest, log_group)
        if log_group is not None or file_path is not None:
            unknown = F.col("main_log_path").isNull() if log_group is not None else F.lit(False)
            unknown = unknown | (F.col("origins").isNull() if file_path is not None else F.lit(False))
            if not files.where(unknown).isEmpty():
                rows = self.read(log_group)
                return (rows.where(F.col("file_path") == file_path) if file_path is not None else rows).count()
        n = F.col("rows") if file_path is None else F.coalesce(F.try_element_at("origins", F.lit(file_path)), F.lit(0))
        return files.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]

    def groups(self) -> DataFrame:
        """(main_log_path, document_count, first, last): exact figures of each group, from the manifest and, for files that hold
        several groups, their rows."""
        snapshot = self.snapshot()
        known = snapshot.manifest.where("main_log_path is not null").select("main_log_path", "rows", "low", "high")
        mixed = snapshot.manifest.where("main_log_path is null")
        if not mixed.isEmpty():
            read = self.load(snapshot, mixed)
            known = known.union(read.select("main_log_path", F.lit(1).cast("long"), "timestamp", "timestamp"))
        return known.groupBy("main_log_path").agg(F.sum("rows").alias("document_count"), F.min("low").alias("first"), F.max("high").alias("last"))

    def prepare(self) -> bool:
        """Drops data of another format; whether there was any."""
        versions = self.versions()
        if versions:
            same = self._meta(max(versions)).get("format") == FORMAT
        else:
            same = not any(n in ("data", "version") for n in self.folder.names())
        if not same:
            for name in self.folder.names():
                if name in ("data", "version", "versions", "manifests", "tokens", "sums") or name.startswith(("change-", "incoming-")):
                    self.folder.delete(name)
        return not same


def _column(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def _stem() -> Column:
    """What an id of the form ``<16 characters at most>-<number>`` begins with; any other is its own kind."""
    return F.coalesce(F.nullif(F.regexp_extract("id", "^([^-]{1,16})-[0-9]{1,18}$", 1), F.lit("")), F.lit(""))


def _number() -> Column:
    """The number of such an id.  Others share one value, so their ranges meet."""
    return F.coalesce(F.nullif(F.regexp_extract("id", "^[^-]{1,16}-([0-9]{1,18})$", 1), F.lit("")).cast("long"), F.lit(0))


def _manifest_row(r, change: str) -> tuple:
    """A file's row from its figures: rows by log file, and the range of the numbers of ids by what they begin with."""
    origins, stems = (None, None) if r["pairs"] is None else ({}, {})
    for p in r["pairs"] or ():
        origins[p["origin"]] = origins.get(p["origin"], 0) + p["n"]
        low, high = stems.get(p["stem"], (p["i0"], p["i1"]))
        stems[p["stem"]] = (min(low, p["i0"]), max(high, p["i1"]))
    log = r["m0"] if r["m0"] == r["m1"] else None
    return r["_file"], change, r["grp"], r["dt"], log, r["rows"], r["bytes"], r["low"], r["high"], origins, stems


def _merged(before: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both; the table's own type stays where it has one."""
    held = {f.name for f in before or ()}
    return T.StructType([*(before or ()), *(T.StructField(f.name, f.dataType) for f in new if f.name not in held)])
