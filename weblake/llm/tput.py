"""Ranked lexical search by three passes over posting lists (three-phase uniform threshold).

Terms are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased.  An index has a row per document
(its terms and their counts) and the posting lists: (term, document, gain), where a term's gain in a document is its weight times
the share of its count.  A search takes three passes:

1. the head of each list, its ``k`` greatest gains: sums over an item's heads give a bound that the ``k``-th score reaches;
2. of each list of an item all entries of at least that bound divided by the item's number of lists, the same threshold for
   all of them; a document that is in no list above it cannot reach the bound;
3. the documents whose sum so far, with the threshold for each list they were not seen in, reaches the bound of the second
   pass: their exact scores are looked up.

All steps are joins and grouped sums.  Heads are cut before the lists' shuffle, so a list may hold any share of the documents.
The searched terms go to the tasks with the code up to ``most_terms`` of them, so that no others are indexed; above that all
terms are, with the same result.

Defined results: a null or empty text has no terms, and an item without terms no rows; documents score above 0 only; equal scores
by the smaller doc_id, null last, then equal rows in the order of the table; rows that share an id are documents of their own, and
so are items; very long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, shared_dir, tidy

#: Letters and digits as they are (A-Z lower-cased), bytes of other characters as they are, anything else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _count(wanted: frozenset[bytes] | None):
    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in as_bytes(batch.column(2)):
                words = terms_of(text)
                found = Counter(words if wanted is None else filter(wanted.__contains__, words))
                n.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            named = pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), named, pa.array(counts, pa.list_(pa.int64()))], ["doc", "doc_id", "n", "terms", "counts"])

    return emit


@dataclass
class Index:
    """``documents``: (doc, doc_id, n, terms, counts); ``n_docs`` and ``n_terms`` count those with terms, and all their terms."""

    documents: DataFrame
    n_docs: int
    n_terms: int

    def share(self, count: Column, n: Column) -> Column:
        """A count's share in a document of ``n`` terms, in millionths of the weight."""
        m = 100 - 75 + F.call_function("div", 75 * n * F.lit(self.n_docs), F.lit(max(1, self.n_terms)))
        return F.call_function("div", F.lit(1_000_000_000) * count, 1000 * count + 8 * m)

    def weight(self, df: Column) -> Column:
        return F.floor(1000 * F.log((2 * F.lit(self.n_docs) + 2).cast("double") / (2 * df + 1))).cast("long")


def index(docs: DataFrame, wanted: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Counts the terms of all documents, once; only ``wanted`` terms get postings, if given."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<string>, counts array<bigint>"
    documents = cut(rows.mapInArrow(_count(wanted), schema))
    n_docs, n_terms = documents.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(documents, n_docs, n_terms)


def queried(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times): each item's terms; ``item`` tells rows apart that share an id."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t)) for t in as_bytes(batch.column(2))]
            at = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            terms = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string())
            times = pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), terms, times], ["item", "item_id", "term", "times"])

    return rows.mapInArrow(emit, f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}, term string, times long")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, least): the ``k``-th greatest ``score`` of each item, 0 where there are fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    best = sums.select("item", "score", place.alias("_place")).where(F.col("_place") <= k)
    return best.groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("least"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = 200_000, small: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the highest scores.  A side of a join is broadcast if it has
    been counted and is of ``small`` rows at most."""
    asked = cut(queried(items))
    terms, rows = asked.agg(F.count_distinct("term"), F.count(F.lit(1))).first()
    wanted = frozenset(r["term"].encode() for r in asked.select("term").distinct().toLocalIterator()) if terms <= most_terms else None
    own = index(docs, wanted)
    few = F.broadcast if rows <= small else lambda frame: frame
    entries = own.documents.select("doc", "n", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(F.col("e.terms").alias("term"), "doc", own.share(F.col("e.counts"), F.col("n")).alias("share"))
    weights = cut(own.documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(asked.select("term").distinct(), "term", "left_semi").select("term", own.weight(F.col("df")).alias("weight")))
    lists = entries.join(few(weights), "term").select("term", "doc", (F.col("weight") * F.col("share")).alias("gain")).where("gain > 0")

    weighed = asked.join(weights, "term").select("item", "item_id", "term", (F.col("times") * F.col("weight")).alias("worth"))

    def exact(pairs: DataFrame) -> DataFrame:
        """The whole scores of (item, doc) pairs, looked up in the documents' rows."""
        rows = pairs.join(own.documents, "doc").select("item", "doc", "doc_id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        terms = rows.select("item", "doc", "doc_id", F.col("e.terms").alias("term"), own.share(F.col("e.counts"), F.col("n")).alias("share"))
        gains = terms.join(few(weighed), ["item", "term"])
        return gains.groupBy("item", "doc").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), F.sum(F.col("worth") * F.col("share")).alias("score")).where("score > 0")

    # 1: the lists' heads.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("gain"), "doc"))
    heads = cut(lists.withColumn("_place", place).where(F.col("_place") <= k).drop("_place"))
    first = _kth(asked.join(heads, "term").groupBy("item", "doc").agg(F.sum(F.col("times") * F.col("gain")).alias("score")), k)
    tops = asked.join(heads.groupBy("term").agg(F.max("gain").alias("top")), "term").withColumn("top", F.col("top") * F.col("times"))
    bounds = tops.groupBy("item").agg(F.count(F.lit(1)).alias("_lists")).join(first, "item").withColumn("limit", F.greatest(F.lit(1), F.ceil(F.col("least") / F.col("_lists")).cast("long")))
    # What an entry below the threshold can add, list by list; only lists whose head is above it are read.
    limits = cut(tops.join(bounds, "item").select("item", "term", "times", "top", "least", "limit", F.least(F.col("limit") - 1, "top").alias("unseen")))
    spare = limits.groupBy("item").agg(F.sum("unseen").alias("spare"), F.first("least").alias("least"))
    read = limits.where("top >= limit")

    # 2: all entries above the threshold.
    least = few(read.groupBy("term").agg(F.min(F.ceil(F.col("limit") / F.col("times")).cast("long")).alias("lowest")))
    above = lists.join(least, "term").where("gain >= lowest").select("term", "doc", "gain")
    seen = above.join(few(read.select("item", "term", "times", "limit", "unseen")), "term").where("gain * times >= limit")
    # Read twice, for the bound and for the candidates, so written once; as columns they take half of what a checkpoint does.
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/tput-{uuid.uuid4().hex}"
    seen.groupBy("item", "doc").agg(F.sum(F.col("gain") * F.col("times")).alias("score"), F.sum("unseen").alias("_seen")).write.parquet(folder)
    sums = docs.sparkSession.read.parquet(folder)
    second = spare.join(_kth(sums, k).withColumnRenamed("least", "_least"), "item").select("item", "spare", F.greatest("least", "_least").alias("least"))
    candidates = sums.join(few(second), "item").where("score + spare - _seen >= least").select("item", "doc")

    # 3: exact scores of the candidates.
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc"))
    return exact(candidates).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same ranking in DuckDB, from all scores.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), sizes AS (
  SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM docs WHERE len(w) > 0
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM items) GROUP BY ALL
), postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sizes GROUP BY term, all_docs
), gains AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * all_docs) // all_terms)))) AS gain FROM postings JOIN weights USING (term), sizes
), scores AS (
  SELECT i, item_id, r, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
