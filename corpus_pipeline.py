"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near duplicates stays, sources
are mixed to weights, and what is left is packed into training sequences.

Defined results, for every stage: only the columns of ``documents`` are read and returned, so others cannot clash; null and empty
texts stay documents (they score as texts without hits, are one empty line, link with nothing, take no words, and are packed as one end
id); rows that share an id but not a text are documents of their own, null ids included; of rows equal in id and text near
duplicates keep one; ties go to the smallest id; texts of any length are read whole; an empty table passes through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.llm import line_dedup, mixing, ngram_join, packing, toxicity
from weblake.llm.common import cut, row_key, shared_dir, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by a lexicon learned from all labels."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, keep=COLUMNS).where("score < 0.7").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first only; documents that would lose more than half of their words
    stay whole for the next stage, which takes such lines from those that are no copies."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    kept = line_dedup.cleaned(docs, line_dedup.drop_bitmaps(docs, min_docs=10, keep="first"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.8 of five-word shingles.  Rows without an
    id stay.  What is left are no copies, so passages of 50 words or more that documents share stay in the first only, and so
    do lines found in ten documents that line dedup left in possible copies."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    groups = ngram_join.join(docs, k=5, percent=80, links=False)
    # Components are told by their classes: rows of one id can be in several.
    own = F.when(F.col("id").isNull() | F.col("comp").isNull(), F.col("row"))
    stay = groups.groupBy(F.col("id").isNull().alias("none"), "comp", own.alias("own")).agg(F.min(F.struct("id", "row"))["row"].alias("doc")).select("doc")
    kept = line_dedup.without_passages(docs, min_docs=10, passage_words=50, only=cut(stay))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all words, by the sources' weights and none twice, in the order of the curriculum.  A document is
    taken whole if half of it or more is."""
    docs = docs.select(*COLUMNS).withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    places = cut(mixing.curriculum(docs, share=0.9, cap=1.0, keep=("_row",)).where("2 * taken >= size").groupBy("_row").agg(F.min("position").alias("_position")))
    return docs.join(places, "_row").orderBy(F.col("_position").asc_nulls_last(), "doc_id").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs)


#: Toxicity, line dedup, n-gram Jaccard join, mixing sources to target weights, packing.
STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Scores, components and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
