"""Language identification by compression: a text is compressed with a raw-content zstandard dictionary of each
language, both in lower case, and the language whose dictionary makes it smallest is chosen.

What is compressed is the whole text, whatever its length.  Sizes are whole bytes, so short texts may have the same size with
two dictionaries; these are compressed again at the next of ``levels``, which parses in another way, until one is smallest.

Dictionaries are made of at most ``docs_per_language`` training texts and ``dictionary_bytes`` bytes a language;
languages are all labels found; more than ``max_languages`` are an error.  Texts of more than 8,000 characters are used, as
far as there is room, where a language has too few shorter ones.  Dictionaries are bounded and go to the tasks with the code.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0; a narrow margin (the
second language within ``margin`` of the first) sets ``rejected`` but the prediction stays; sizes that are equal at all levels go to the first
language by name; without training rows all is ``und``; very long texts are compressed whole; of the table's columns only
the named ones are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LETTER = regex.compile(r"\p{L}")


def dictionaries(labelled: DataFrame, docs_per_language: int = 200, dictionary_bytes: int = 112_640, max_languages: int = 1024) -> tuple[tuple[str, bytes], ...]:
    """(language, dictionary content) pairs from ``labelled`` (doc_id, text, lang)."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    rows = rows.where("length(text) > 0").withColumn("long", F.length("text") > 8000).withColumn("text", F.substring("text", 1, dictionary_bytes))
    found = rows.select("lang").distinct().limit(max_languages + 1).count()
    if found > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # Spark cuts each language to its first rows before the shuffle, so a frequent language does not gather.
    first = Window.partitionBy("lang").orderBy("long", "order")
    ranked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_language)
    ranked = ranked.withColumn("before", F.sum(F.length("text") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < dictionary_bytes)
    texts: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "n").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, "\n".join(t).lower().encode()[:dictionary_bytes]) for lang, t in sorted(texts.items()))


@lru_cache(12)
def _compressors(contents: tuple, level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False))
    return out


def identify(text: str | None, contents: tuple, margin: float, levels: tuple[int, ...]) -> tuple[str, float, bool]:
    """(language, score, rejected)."""
    if not text or not contents or not _LETTER.search(text):
        return "und", 0.0, True
    data = text.lower().encode()
    sizes = [len(c.compress(data)) for c in _compressors(contents, levels[0])]
    best = min(sizes)
    left = [i for i, s in enumerate(sizes) if s == best]
    for level in levels[1:]:
        if len(left) > 1:
            again = {i: len(_compressors(contents, level)[i].compress(data)) for i in left}
            left = [i for i in left if again[i] == min(again.values())]
    chosen = min(left, key=lambda i: contents[i][0])
    scale = 1 + 0.01 * best
    score = 1 / sum(math.exp(-min(60.0, (s - best) / scale)) for s in sizes)
    narrow = any(s - best < margin * best for i, s in enumerate(sizes) if i != chosen)
    return contents[chosen][0], score, narrow


def predict(docs: DataFrame, contents: tuple, margin: float = 0.01, levels: tuple[int, ...] = (6, 3, 9), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``rejected``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, narrow = zip(*(identify(t, contents, margin, levels) for t in batch.column(0).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(emit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", lang_pred string, score double, rejected boolean")
