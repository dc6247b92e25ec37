"""Facets, distinct counts and statistics of matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

DEFAULT = ("status", "method", "browser", "os", "device_type", "region_code")
#: Columns whose facets count tokens.
ANALYSED = ("path", "user_agent", "referer", "raw")
STATS_LIMIT = 200_000


def _terms(matches: DataFrame, column: str) -> DataFrame:
    """A row (field, term) for each term of each match; a match counts once for a token; null where it has none."""
    value = F.col(column)
    if column in ANALYSED:
        return matches.select(F.lit(column).alias("field"), F.explode_outer(F.array_distinct(text.tokens(value))).alias("term"))
    if column == "status":
        value = F.when(value.between(100, 599), value)
    return matches.select(F.lit(column).alias("field"), F.nullif(value.cast("string"), F.lit("")).alias("term"))


def terms(matches: DataFrame, columns: tuple[str, ...] = DEFAULT, size: int = 10) -> DataFrame:
    """(field, term, count, rank): the most frequent terms of each column, ties by term.  Plain columns are unpivoted, so one
    pass counts them all."""
    plain = [c for c in columns if c not in ANALYSED]
    parts = [_terms(matches, c) for c in columns if c in ANALYSED]
    if plain:
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), (F.when(F.col(c).between(100, 599), F.col(c)) if c == "status" else F.col(c)).cast("string").alias("term")) for c in plain))
        parts.append(matches.select(F.explode(pairs).alias("p")).select("p.field", F.nullif(F.col("p.term"), F.lit("")).alias("term")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    counted = rows.where("term is not null").groupBy("field", "term").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "term"))).where(F.col("rank") <= size)


def meta(matches: DataFrame, column: str, size: int = 10) -> DataFrame:
    """(field, total, missing, other): terms listed, matches without a term, and counts past the list."""
    rows = _terms(matches, column)
    counted = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # Only the list needs an order: the rest is the sum of all less the sum listed.
    listed = counted.where("term is not null").orderBy(F.desc("n"), "term").limit(size).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("listed"))
    sums = counted.agg(F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("held"))
    return listed.crossJoin(F.broadcast(sums)).select(F.lit(column).alias("field"), "total", "missing", (F.col("held") - F.col("listed")).alias("other"))


def status_codes(matches: DataFrame) -> DataFrame:
    """(status, count) of codes 100 to 599."""
    return matches.where(F.col("status").between(100, 599)).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def _present(column: str):
    return F.nullif(F.col(column), F.lit(""))


def summary(matches: DataFrame) -> DataFrame:
    """One row: page views, distinct visitors and pages, traffic, and traffic per view."""
    bytes_ = F.coalesce(F.sum("bytes_sent"), F.lit(0))
    return matches.agg(
        F.count(F.lit(1)).alias("pv"),
        F.count_distinct(_present("ip")).alias("uv"),
        F.count_distinct(_present("path_exact")).alias("unique_pages"),
        bytes_.alias("total_traffic"),
        F.coalesce(F.min("bytes_sent"), F.lit(0)).alias("min_bytes"),
        F.coalesce(F.max("bytes_sent"), F.lit(0)).alias("max_bytes"),
        F.when(F.count(F.lit(1)) > 0, bytes_ / F.count(F.lit(1))).otherwise(0.0).alias("avg_traffic_per_pv"),
    )


def stats(matches: DataFrame) -> DataFrame:
    """One row of totals, averages (over all matches), minima and maxima of bytes and request times."""
    n = F.count(F.lit(1))
    out = [n.alias("docs")]
    for name, column in (("bytes", "bytes_sent"), ("request_time", "request_time")):
        total = F.coalesce(F.sum(column), F.lit(0))
        out += [total.alias(f"total_{name}"), F.when(n > 0, total / n).otherwise(0.0).alias(f"avg_{name}"), F.coalesce(F.min(column), F.lit(0)).alias(f"min_{name}"), F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(0)).alias(f"max_{name}")]
    return matches.agg(*out)


def stats_of_first(matches: DataFrame, limit: int = STATS_LIMIT) -> DataFrame:
    """The same from the first matches by (timestamp, id), totals scaled up to all, and whether they were."""
    first = stats(matches.orderBy("timestamp", "id").limit(limit))
    every = matches.agg(F.count(F.lit(1)).alias("every"))
    scale = F.when(F.col("docs") > 0, F.col("every") / F.col("docs")).otherwise(1.0)
    scaled = {c: F.col(c) * scale for c in ("total_bytes", "total_request_time")}
    return first.crossJoin(F.broadcast(every)).withColumns(scaled).withColumn("approximate", F.col("every") > F.col("docs")).drop("every")


def entries_stats(matches: DataFrame) -> dict[str, DataFrame]:
    """Statistics, and the ten most frequent statuses, methods, paths, addresses and agent tokens."""
    renamed = {"path_exact": "path_exact", "ip": "ip", "user_agent": "user_agent", "status": "status", "method": "method"}
    return {"stats": stats(matches), "terms": terms(matches, tuple(renamed), 10)}


def distinct(matches: DataFrame, column: str, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """The count of a column's distinct values; approximate, with ``rsd`` as the standard error of its ratio to the exact one (two
    thirds of all estimates are within it, nearly all within three times it)."""
    return matches.agg((F.approx_count_distinct(_present(column), rsd) if approximate else F.count_distinct(_present(column))).alias("distinct"))


def scan(matches: DataFrame, columns: list[str], fold, schema: str, merge=None, fan: int = 32) -> DataFrame:
    """A user's own aggregate over the named columns: ``fold`` takes the Arrow batches of a partition and yields partial results
    (rows of ``schema``).  With ``merge``, which takes batches of such rows and yields fewer, they are merged in ``fan`` tasks and then
    in one, so the last sees what ``fan`` tasks have left, however many partitions there were.  Without it the caller adds them up."""
    partial = matches.select(*columns).mapInArrow(fold, schema)
    if merge is None:
        return partial
    return partial.repartition(fan).mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema)


def size_histogram(matches: DataFrame, column: str = "bytes_sent") -> DataFrame:
    """(bits, n): how many values have so many binary digits, as an aggregate of one's own (``scan``); 0 and nulls have none."""

    def counted(pairs):
        n = np.zeros(65, np.int64)
        for bits, count in pairs:
            n += np.bincount(bits, count, 65).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bits", "n"])

    def fold(batches):
        def digits(batch):
            values = np.maximum(0, batch.column(0).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
            return np.searchsorted(2 ** np.arange(63, dtype=np.int64), values, side="right"), None

        return counted(map(digits, batches))

    def merge(batches):
        return counted((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)

    return scan(matches, [column], fold, "bits int, n long", merge)
