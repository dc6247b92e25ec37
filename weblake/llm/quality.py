"""Quality rules: base counts of each text, and the frequency of its lines across the documents of a host.

A line is normalised (ASCII white space stripped, A-Z lower-cased, digits to 0) and hashed.  For each host the
documents of each line are counted; lines in more documents than the host's limit are removed, and a document is
rejected when what remains is depleted: less than ``min_left_percent`` of its words.  The limit is ``share_percent`` of
the host's documents, ``floor_docs`` at least and ``max_docs`` at most.  Counting is a group-by that
combines before the shuffle, and only frequent lines come back to the documents.  A line is one row for each batch of
documents that has it, however many these are, so neither a host nor a line with a third of all rows gathers in one task.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a null host is a host of
its own; each row is a document, equal rows too; a line repeated in one document counts once for it, but all its
repeats are removed; lines without a word are ignored; very long texts and lines are read whole; of the table's columns
only the named ones are read, and the others travel as one, so none clashes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, cut, row_key, tidy, windows, word_hashes

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = "id long, host string, " + ", ".join(f"{k} long" for k in _COUNTS) + ", lines array<binary>, line_words array<int>"
_SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """How many words lie in windows of ``k`` words found twice or more."""
    w = windows(h, k)
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(w, twice)
    cover = np.zeros(len(h), bool)
    for i in range(k):
        cover[i : i + len(w)] |= hit
    return int(cover.sum())


def line_hash(core: bytes) -> bytes:
    return xxhash.xxh3_128_digest(core.lower().translate(_DIGITS))


def line_counts(text: bytes) -> tuple[int, dict[bytes, int]]:
    """The count of lines with a word that equal an earlier line, and the words under each normalised line's hash."""
    seen, dup, lines = set(), 0, {}
    for line in text.split(b"\n"):
        core = line.strip()
        if core:
            dup += line in seen
            seen.add(line)
            k = line_hash(core)
            lines[k] = lines.get(k, 0) + len(core.split())
    return dup, lines


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        everything = as_bytes(batch.column(3))
        rows: list[tuple] = []
        for a, b in blocks(map(len, everything)):
            h, counts, points = word_hashes(everything[a:b], fold=False)
            chars = np.concatenate(([0], np.cumsum(points)))
            for text, n, end in zip(everything[a:b], counts.tolist(), np.cumsum(counts).tolist()):
                dup, lines = line_counts(text)
                rows.append((n, int(chars[end] - chars[end - n]), sum(map(text.count, _SYMBOLS)), dup, repeated_words(h[end - n : end]), list(lines), list(lines.values())))
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.binary())), pa.array(cols[6], pa.list_(pa.int32()))],
            ["row", "id", "host", *_COUNTS, "lines", "line_words"],
        )


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return cut(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _measure, f"row long, {_MEASURED}"
        )
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch of documents, a row for each line of a host: the documents that have it, and their words in it."""
    for batch in batches:
        found: dict[tuple, tuple[list, list]] = {}
        for row, host, lines, words in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "lines", "line_words"))):
            for line, n in zip(lines, words):
                rows, counts = found.setdefault((host, line), ([], []))
                rows.append(row)
                counts.append(n)
        hosts, keys = zip(*found) if found else ((), ())
        rows, counts = zip(*found.values()) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(batch.schema.field("row").type)), pa.array(counts, pa.list_(pa.int32()))], ["host", "line", "rows", "words"])


def _removed(measured: DataFrame, max_docs: int, share_percent: float, floor_docs: int) -> DataFrame:
    """(row, line, words): the lines of each row that are above their host's limit."""
    row = measured.schema["row"].dataType.simpleString()
    lines = measured.select("row", "host", "lines", "line_words").mapInArrow(_gathered, f"host string, line binary, rows array<{row}>, words array<int>")
    limits = measured.groupBy("host").count().select(F.col("host").alias("of"), F.least(F.lit(max_docs), F.greatest(F.lit(floor_docs), F.col("count") * share_percent / 100)).alias("limit"))
    counts = lines.groupBy("host", "line").agg(F.sum(F.size("rows")).alias("n")).where(F.col("n") > min(max_docs, floor_docs))
    frequent = counts.join(limits, counts["host"].eqNullSafe(limits["of"])).where(F.col("n") > F.col("limit")).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    found = lines.join(frequent, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    return found.select("line", F.explode(F.arrays_zip("rows", "words")).alias("r")).select(F.col("r.rows").alias("row"), "line", F.col("r.words").alias("words"))


def _failed(min_words: int, max_repeat_percent: int):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_docs: int = 100,
    min_left_percent: int = 30,
    share_percent: float = 1,
    floor_docs: int = 10,
) -> DataFrame:
    """(id, the five counts, base_failed, removed_words, kept), a row for each row of ``docs``."""
    measured = _measured(docs, id_col, text_col, host_col)
    removed = _removed(measured, max_docs, share_percent, floor_docs).groupBy("row").agg(F.sum("words").alias("removed_words"))
    rows = measured.select("row", "id", *_COUNTS).join(removed, "row", "left")
    return rows.select("id", *_COUNTS, _failed(min_words, max_repeat_percent).alias("base_failed"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words")).withColumn(
        "kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("removed_words")) >= min_left_percent * F.col("n_words"))
    )


def cleaned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 100,
    share_percent: float = 1,
    floor_docs: int = 10,
) -> DataFrame:
    """All rows and columns of ``docs``, the texts without the lines that ``line_rules`` removes."""
    names, schema = docs.columns, docs.schema
    place = names.index(text_col)
    key = row_key(F.col(host_col).cast("string"), F.col(text_col).cast("string"))
    # Texts that are equal in one host lose the same lines, so these find their rows by the text.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("whole"), key.alias("key"))
    texts = docs.select(key.alias("key"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = cut(texts.select(F.col("key").alias("row"), F.lit(None).cast("long").alias("id"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, f"row binary, {_MEASURED}"))
    gone = _removed(measured, max_docs, share_percent, floor_docs).groupBy("row").agg(F.collect_set("line").alias("gone"))
    marked = keyed.join(gone, keyed["key"] == gone["row"], "left")

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            kept = [b"\n".join(x for x in text.split(b"\n") if not x.strip() or line_hash(x.strip()) not in gone) for text, gone in zip(as_bytes(columns[place]), map(set, batch.column(1).to_pylist()))]
            columns[place] = pa.array([d.decode() for d in kept], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    same = marked.where("gone is null").select("whole.*")
    return same.unionByName(marked.where("gone is not null").select("whole", "gone").mapInArrow(emit, schema))
