"""The catalogue of log files and groups: queries and changes over ``file_state`` and ``host_logs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rotation import is_compressed
from ..schema import STATUSES

#: Of a group's files the status that comes first here is the group's.
PRIORITY = ("indexing", "queued", "indexed", "error", "not_indexed")


def _rank(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), status), F.lit(len(PRIORITY)))


def groups(states: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per group, sorted by path.  The main file's own row speaks for the group where there is one; else rotated files
    are added up.  Listed logs without rows are not indexed; groups that are not listed take their type from their name."""
    main = F.col("path") == F.col("main_log_path")
    own = lambda c: F.max(F.when(main, F.col(c)))
    pick = lambda c: F.when(own("path").isNotNull(), own(c)).otherwise(F.sum(c))
    rolled = states.groupBy("main_log_path").agg(
        pick("document_count").alias("document_count"),
        pick("last_size").alias("last_size"),
        F.min("timerange_start").alias("timerange_start"),
        F.max("timerange_end").alias("timerange_end"),
        F.max("last_indexed").alias("last_indexed"),
        F.max_by("last_modified", "last_indexed").alias("last_modified"),
        F.max_by("index_duration", "last_indexed").alias("index_duration"),
        F.element_at(F.array(*map(F.lit, PRIORITY)), F.min(_rank(F.col("index_status"))).cast("int")).alias("index_status"),
        F.count(F.lit(1)).alias("files"),
    )
    listed = hosts.select(F.col("path").alias("listed"), "type")
    path = F.coalesce("listed", "main_log_path")
    named = F.when(F.lower(path).contains("error"), "error").otherwise("access")
    return (
        rolled.join(listed, rolled["main_log_path"] == listed["listed"], "full")
        .select(path.alias("path"), F.coalesce("type", named).alias("type"), F.coalesce("index_status", F.lit("not_indexed")).alias("index_status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("document_count", "last_size", "files")), "timerange_start", "timerange_end", "last_indexed", "last_modified", "index_duration")
        .orderBy("path")
    )


def ungrouped(states: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per listed log with its own state, not indexed where it has none."""
    own = states.select(F.col("path").alias("_path"), "index_status", "document_count", "last_size", "last_indexed", "timerange_start", "timerange_end")
    return hosts.join(own, hosts["path"] == own["_path"], "left").select(
        "path", "type", F.coalesce("index_status", F.lit("not_indexed")).alias("index_status"), F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("last_size", F.lit(0)).alias("last_size"), "last_indexed", "timerange_start", "timerange_end"
    )


def filtered(listing: DataFrame, type_: str | None = None, name: str | None = None, path: str | None = None, indexed: str | None = None) -> DataFrame:
    """Groups of a type, with a part of their name or path, that are indexed (true), not indexed (false) or being indexed
    (indexing); any other value of ``indexed`` filters nothing."""
    if type_:
        listing = listing.where(F.col("type") == type_)
    if name:
        listing = listing.where(F.element_at(F.split("path", "/"), -1).contains(name))
    if path:
        listing = listing.where(F.col("path").contains(path))
    wanted = {"true": "indexed", "false": "not_indexed", "indexing": "indexing"}.get(indexed or "")
    return listing.where(F.col("index_status") == wanted) if wanted else listing


def listing_summary(listing: DataFrame) -> DataFrame:
    status = lambda *s: F.coalesce(F.sum(F.when(F.col("index_status").isin(*s), 1).otherwise(0)), F.lit(0))
    return listing.agg(F.count(F.lit(1)).alias("total_files"), status("indexed").alias("indexed_files"), status("indexing", "queued").alias("indexing_files"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("total_documents"))


def persistence_stats(states: DataFrame, now: int) -> DataFrame:
    return states.agg(
        F.count(F.lit(1)).alias("total_files"), F.sum(F.col("enabled").cast("int")).alias("enabled_files"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("total_documents"), F.sum((F.unix_timestamp("last_modified") >= now - 3600).cast("int")).alias("changed_files")
    )


def incremental_stats(states: DataFrame, now: int) -> DataFrame:
    """Per group: files, enabled ones, those last indexed a week ago or earlier, documents."""
    old = (F.unix_timestamp("last_indexed") < now - 7 * 86400).cast("int")
    return states.groupBy("main_log_path").agg(F.count(F.lit(1)).alias("total_files"), F.sum(F.col("enabled").cast("int")).alias("changed_files"), F.sum(old).alias("old_files"), F.sum("document_count").alias("total_documents"))


def status_histogram(spark: SparkSession, states: DataFrame) -> DataFrame:
    """(index_status, files) of enabled files for all five statuses."""
    grid = spark.createDataFrame([(s,) for s in STATUSES], "index_status string")
    counted = states.where("enabled").groupBy("index_status").agg(F.count(F.lit(1)).alias("files"))
    return grid.join(counted, "index_status", "left").select("index_status", F.coalesce("files", F.lit(0)).alias("files"))


def incomplete(states: DataFrame) -> DataFrame:
    return states.where("enabled and index_status in ('indexing', 'queued')").orderBy("queue_position", "path")


def queued(states: DataFrame) -> DataFrame:
    return states.where("enabled and index_status = 'queued'").orderBy("queue_position", "path")


def recoverable(states: DataFrame, now: int) -> DataFrame:
    """Groups to index again after a crash."""
    fresh = (F.col("index_status") == "error") & (F.unix_timestamp("error_time") > now - 3600)
    return states.where(F.col("index_status").isin("indexing", "queued", "not_indexed") | fresh).select("main_log_path").distinct()


def stale(states: DataFrame, hosts: DataFrame) -> DataFrame:
    """Groups with rows that the host no longer lists."""
    return states.select("main_log_path").distinct().join(hosts, F.col("main_log_path") == hosts["path"], "left_anti")


def inherited(files: DataFrame, states: DataFrame) -> DataFrame:
    """(path, fingerprint) files with the position to go on from: their own row's, or the furthest of another path with the same
    fingerprint."""
    own = states.select("path", F.col("fingerprint").alias("own_print"), F.col("last_position").alias("own_position"))
    others = states.where("fingerprint <> ''").groupBy("fingerprint").agg(F.max("last_position").alias("far"))
    kept = F.when(F.col("own_print") == F.col("fingerprint"), F.col("own_position")).otherwise(F.coalesce("far", F.lit(0)))
    return files.join(own, "path", "left").join(others, "fingerprint", "left").select("path", "fingerprint", F.coalesce(kept, F.lit(0)).alias("position"))


# --- changes: each takes and returns ``file_state`` ------------------------------------------------------------------


def save(states: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of their path."""
    return states.join(rows.select("path"), "path", "left_anti").select(*states.columns).unionByName(rows.select(*states.columns))


def enable(states: DataFrame, path: str, on: bool = True) -> DataFrame:
    return states.withColumn("enabled", F.when(F.col("path") == path, F.lit(on)).otherwise(F.col("enabled")))


def delete(states: DataFrame, path: str | None = None, log_group: str | None = None) -> DataFrame:
    return states.where(~(F.col("path") == path if path is not None else F.col("main_log_path") == log_group))


def cleanup(states: DataFrame, now: int, days: int) -> DataFrame:
    """Without disabled rows that were not changed for so many days."""
    return states.where(F.col("enabled") | (F.unix_timestamp("updated_at") >= now - days * 86400))


def reset_tasks(states: DataFrame) -> DataFrame:
    open_ = F.col("index_status").isin("indexing", "queued")
    return states.withColumns({"index_status": F.when(open_, "not_indexed").otherwise(F.col("index_status")), "queue_position": F.when(open_, 0).otherwise(F.col("queue_position"))})


def widen(states: DataFrame, log_group: str, documents: int, first: Column, last: Column) -> DataFrame:
    """A recount for the group's own row, whose time range only grows."""
    main = F.col("path") == log_group
    to = lambda value, c: F.when(main, value).otherwise(F.col(c))
    return states.withColumns(
        {"document_count": to(F.lit(documents), "document_count"), "timerange_start": to(F.least("timerange_start", first), "timerange_start"), "timerange_end": to(F.greatest("timerange_end", last), "timerange_end")}
    )


def transition(states: DataFrame, path: str, status: str, now: int, message: str = "", position: int = 0) -> DataFrame:
    """A row's status changes: an error counts a retry, a queued row has a position, all others lose theirs."""
    here, time = F.col("path") == path, F.timestamp_seconds(F.lit(now))
    changes = {"index_status": F.lit(status), "updated_at": time, "queue_position": F.lit(position if status == "queued" else 0)}
    if status == "error":
        changes |= {"error_message": F.lit(message), "error_time": time, "retry_count": F.col("retry_count") + 1}
    elif status == "indexed":
        changes |= {"error_message": F.lit(""), "error_time": F.lit(None), "retry_count": F.lit(0), "last_indexed": time}
    elif status == "indexing":
        changes |= {"index_start_time": time}
    return states.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in changes.items()})


def needs_indexing(size: Column, modified: Column) -> Column:
    """Never indexed, grown, or shrunk."""
    return F.col("last_indexed").isNull() | (size != F.col("last_size")) | (modified > F.col("last_modified"))


def needs_rebuild(size: Column, modified: Column) -> Column:
    """Shrunk, or more than an hour older than it was."""
    return (size < F.col("last_size")) | (F.unix_timestamp(modified) < F.unix_timestamp("last_modified") - 3600)


def is_healthy(max_retries: int = 3) -> Column:
    return (F.col("index_status") != "error") & F.col("enabled") & (F.col("retry_count") < max_retries)


def can_retry(max_retries: int = 3) -> Column:
    return (F.col("index_status") == "error") & (F.col("retry_count") < max_retries)


def preflight(listing: DataFrame, path: str, exists: bool = True, readable: bool = True, size: int | None = None, modified: int | None = None, allowed: bool = True, healthy: bool = True, busy: bool = False) -> DataFrame:
    """One row: what can be shown of a log, by its row of the listing if it has one and what the host knows of its file.

    A path that is not allowed and a file that cannot be read are errors.  A file that is gone counts as indexed where its log was
    (``historical``).  ``available``: it was indexed, and searches work (``healthy``); else it is being indexed or queued if
    the host is ``busy``."""
    spark = listing.sparkSession
    own = listing.where((F.col("path") == path) & (F.col("files") > 0)).select("last_indexed", "timerange_start", "timerange_end", "document_count", F.lit(True).alias("_row"))
    row = spark.range(1).join(own, F.lit(True), "left")
    known, indexed = F.col("_row").isNotNull(), F.col("last_indexed").isNotNull()
    refused = not allowed or (exists and not readable)
    if refused:
        status, message = F.lit("error"), F.lit("the file cannot be read" if allowed else "the path is not allowed")
    elif not exists:
        status, message = F.when(indexed, "indexed").otherwise("not_indexed"), F.when(indexed, "the file is gone, what was read of it is there").otherwise("there is no such file")
    else:
        status = F.when(indexed, "indexed").when(F.lit(busy), F.when(known, "indexing").otherwise("queued")).otherwise("not_indexed")
        message = F.when(known, "").otherwise("not indexed yet")
    there = exists and allowed
    return row.select(
        F.lit(path).alias("path"),
        (indexed & F.lit(healthy and not refused)).alias("available"),
        status.alias("index_status"),
        message.alias("message"),
        (indexed & F.lit(not exists and not refused)).alias("historical"),
        (F.coalesce("document_count", F.lit(0)) > 0).alias("has_data"),
        *(F.when(F.lit(not refused), F.unix_timestamp(c)).alias(a) for c, a in (("timerange_start", "start_time"), ("timerange_end", "end_time"))),
        F.lit(there).alias("exists"),
        F.lit(there and readable).alias("readable"),
        F.lit(size if there and readable else None).cast("long").alias("size"),
        F.lit(modified if there and readable else None).cast("long").alias("last_modified"),
    )


def status_items(states: DataFrame, hosts: DataFrame, **filters: str) -> DataFrame:
    """A row for each group that the filters leave, sorted by path: the listing with the details of the main file's own row."""
    listing = filtered(groups(states, hosts), **filters)
    kinds = {"index_start_time": "timestamp", "error_message": "string", "error_time": "timestamp", "retry_count": "int", "queue_position": "int"}
    main = states.where("path = main_log_path").select(F.col("path").alias("_path"), *((F.col(c) if c in states.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    configured = hosts.select(F.col("path").alias("_host"), "config_file")
    joined = listing.join(main, listing["path"] == main["_path"], "left").join(configured, listing["path"] == configured["_host"], "left")
    ranged = F.col("timerange_start").isNotNull() & F.col("timerange_end").isNotNull()
    return joined.select(
        "path", F.col("path").alias("main_log_path"), "type", F.element_at(F.split("path", "/"), -1).alias("name"), "config_file", "index_status", "last_modified", "last_size", "last_indexed", "index_duration",
        is_compressed(F.col("path")).alias("is_compressed"), ranged.alias("has_time_range"), "timerange_start", "timerange_end", "document_count", *kinds,
    ).orderBy("path")


def ordered_queue(states: DataFrame) -> DataFrame:
    """Queued rows with positions from 1 without gaps."""
    return queued(states).withColumn("queue_position", F.row_number().over(Window.orderBy("queue_position", "path")))
