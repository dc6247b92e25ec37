"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time 0..1: a line from ``w * (1 + tilt)`` to ``w * (1 - tilt)``,
whose integral is its weight ``w``; ``tilt`` alternates between sources, so early training favours some and late
training others.  Targets share the budget by weight; a source's target stops at ``cap`` times its size and the
excess is shared anew by weight until no source is above (solved in closed form from one sort of the sources, of
which there are few: their sizes are one row each).

Within a source, documents are put in the order of a digest of their id (of their text where they have none).  The
words before a document in that order, read over as many passes as the target needs, are a cumulative demand; the
training position is where the integrated schedule reaches that demand.  Each pass over a document has a position of its
own; documents are range-sorted by their first one, and ``reads`` gives a row for each pass, range-sorted too.

The running sums do not gather a source in one task: documents are dealt to buckets of the digest (about
``bucket_docs`` documents each), buckets are summed first, running sums are taken over groups of buckets, over
buckets in a group, and then inside each bucket.

Defined results: a null text has size 0; a document of size 0 takes 0 words; the document that crosses the target
gives only the words up to it, so a source's taken words differ from the target by less than one; a null source is a
source of its own, last; documents that share an id are ordered by size too, and equal rows are interchangeable;
very long texts are only counted; of the table's columns only the named ones are read, so others cannot clash;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ahead, cut


def digest(id_col: Column, text_col: Column) -> Column:
    """The order of documents within their source."""
    return F.md5(F.coalesce(id_col.cast("string"), text_col, F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds ``weight``, ``tilt`` and ``target`` to one row per source (``source``, ``source_size``).

    Sorted by cap / weight, the capped sources are a prefix.  Were the sources before one capped, the level of the rest
    would be (budget - caps before it) / (weights from it on); this rises up to the true end of the prefix and falls
    after it, so the level is its maximum."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    level = (share * F.col("everything") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("everything", F.sum("source_size").over(everything))
        .withColumn("weight", weight)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "n_docs", "weight", F.when(F.col("rank") % 2 == 0, 0.5).otherwise(-0.5).alias("tilt"), F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))
    )


def curriculum(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, bucket_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, last_position, passes), a row per document, range-sorted by
    training position; ``position`` and ``last_position`` (0..1) are where the first word of its first and its last pass is read,
    null if none is, and ``passes`` lists the words and the position of each.  ``keep`` carries further columns."""
    # Words are counted once; all else moves only numbers.
    text = F.col(text_col)
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest(F.col(id_col), text).alias("digest"), *keep))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, cap)
    # The digest's first 13 hexadecimal digits as a fraction of 1, cut into the source's buckets.
    place = F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / float(16**13)
    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("bucket", F.floor(place * F.ceil(F.col("n_docs") / F.lit(bucket_docs))))
    sums = ahead(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words")), ["source"], "bucket", "words")
    begins = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "ahead")
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(begins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    start, whole, tilt = F.col("ahead") + F.col("within"), F.floor("target").cast("long"), F.col("tilt")

    def one_pass(p: int) -> Column:
        before = start + F.col("source_size") * p
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - before)).cast("long")
        # The schedule's integral from 0 to t, as a share of the weight, is t * (1 + tilt) - tilt * t * t; here it is inverted.
        demand = before / F.col("target")
        position = ((1 + tilt) - F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * demand)) / (2 * tilt)
        return F.struct(words.alias("words"), F.when(words > 0, position).alias("position"))

    passes = F.filter(F.array(*map(one_pass, range(max(1, -int(-cap // 1))))), lambda p: p["words"] > 0)
    return (
        placed.withColumn("passes", passes)
        .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"]))
        .withColumns({"position": F.get("passes", F.lit(0))["position"], "last_position": F.get("passes", F.size("passes") - 1)["position"]})
        .select("doc_id", "source", "size", "source_size", "target", "taken", "position", "last_position", "passes", *keep)
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def reads(mix: DataFrame) -> DataFrame:
    """A row for each pass over a document, (all but ``passes``, words, position), in the order of training."""
    others = [c for c in mix.columns if c not in ("passes", "position", "last_position")]
    return mix.select(*others, F.explode("passes").alias("_p")).select(*others, "_p.words", "_p.position").orderBy("position", "doc_id")


#: The same mix in DuckDB, positions included.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS digest FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, sum(source_size) OVER () AS everything FROM sources
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, CASE WHEN rank % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS tilt, 2.0::DOUBLE * source_size AS most FROM ranked
), levels AS (
  SELECT *, most / weight AS ratio,
    (1.5::DOUBLE * everything - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aims AS (
  SELECT source, source_size, tilt, least(most, max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT d.*, a.source_size, a.target, a.tilt, (sum(size) OVER (PARTITION BY d.source ORDER BY digest, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
), passed AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS first_words, greatest(0, least(size, floor(target)::BIGINT - source_size - start)) AS second_words,
    ((1 + tilt) - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * least(1, start / target))) / (2 * tilt) AS first_position,
    ((1 + tilt) - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * least(1, (start + source_size) / target))) / (2 * tilt) AS second_position
  FROM placed
)
SELECT doc_id, size, source_size, target, (first_words + second_words)::BIGINT AS taken,
  round(CASE WHEN first_words > 0 THEN first_position WHEN second_words > 0 THEN second_position END, 9) AS position,
  round(CASE WHEN second_words > 0 THEN second_position WHEN first_words > 0 THEN first_position END, 9) AS last_position
FROM passed
"""
