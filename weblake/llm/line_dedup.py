"""Line deduplication across documents.

Every line of every text is keyed by a 128-bit hash of its normalised form.  The (hash, document) pairs are
range-partitioned by hash *and* document, with a secondary sort by document and position, so a line that a third of all
documents share is dealt over many partitions, and each partition is streamed once: a run of one hash begins with the
first occurrence and goes on until the hash changes.  Only runs that touch a partition's edge are unsettled; a small
exchange of one summary for each (at most two a partition) settles them, together with the few of their rows that depend
on it.  What travels back to the documents is a compressed bitmap of lines, never text.

Defined results: a null or empty text is one empty line; a key shorter than ``min_chars`` is never dropped; a
line repeated inside one document counts once; rows that are equal in id and text are one document; rows that
share an id but not a text are different documents; null ids come last; very long texts and lines are read whole; an empty
table gives no rows; a table's own columns travel as one, so none of their names clashes.  ``keep="first"`` keeps the
occurrence with the smallest (document, position); ``keep="none"`` drops all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, row_key, tidy

_SPACES = b" \t\n\x0b\f\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(_SPACES).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _pairs(min_chars: int):
    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, hashes, places = [], [], [], []
            for id_, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    k = line_key(line)
                    if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars):
                        at.setdefault(_hash(k), []).append(i)
                ids += [id_] * len(at)
                docs += [key] * len(at)
                hashes += at
                places += at.values()
            ids = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), ids.is_null(), ids, pa.array(docs, pa.binary()), pa.array(places, pa.list_(pa.int32()))], _PAIR)

    return emit


_PAIR = ["hash", "none", "id", "doc", "at"]
_RUNS = "hash binary, none boolean, id long, doc binary, at array<int>, n long, level int, first boolean, open boolean, summary boolean"


def _halves(column: pa.Array) -> np.ndarray:
    """128-bit values as rows of two numbers."""
    fixed = column.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], np.uint64).reshape(-1, 2)[fixed.offset : fixed.offset + len(fixed)]


def _changes(x: np.ndarray) -> np.ndarray:
    return (x[1:] != x[:-1]).any(axis=1)


class _Run:
    """The run of one hash that is being read: how many documents it has so far, and the rows whose verdict is open."""

    def __init__(self, head: pa.RecordBatch, opening: bool, least: int, often: int):
        self.head, self.opening, self.least, self.often = head, opening, least, often
        self.key = head.column("hash")[0].as_py()
        self.n, self.held, self.fresh = 0, [], True

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.n += rows.num_rows
        self.held.append(rows)
        if self.n >= self.often:
            yield from self._out(2, False)

    def _out(self, level: int, open_: bool) -> Iterator[pa.RecordBatch]:
        for rows in self.held:
            first, waits = np.zeros(rows.num_rows, bool), np.full(rows.num_rows, open_)
            if self.fresh:
                # The first row here is the first of all, unless the run began in the partition before.
                first[0] = True
                waits[0] |= self.opening
                self.fresh = False
            yield _marked(rows, self.n, level, first, waits)
        self.held = []

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        edge = self.opening or last
        if self.held and (edge or self.n >= self.least):
            yield from self._out(int(self.n >= self.least), edge)
        if edge:
            yield _marked(self.head, self.n, 0, np.ones(1, bool), np.ones(1, bool), True)


def _marked(rows: pa.RecordBatch, n, level, first: np.ndarray, open_: np.ndarray, summary: bool = False) -> pa.RecordBatch:
    fill = lambda x, kind: pa.array(np.broadcast_to(x, rows.num_rows).astype(kind))
    return pa.RecordBatch.from_arrays([*rows.columns, fill(n, np.int64), fill(level, np.int32), pa.array(first), pa.array(open_), fill(summary, bool)], [*_PAIR, "n", "level", "first", "open", "summary"])


def _runs(least: int, often: int):
    """Streams sorted pairs.  Rows out: those of runs of ``least`` documents or more (``level`` 1; 2: ``often`` or more), ``first``
    on the first of a run; ``open`` ones need the summaries of runs at the edges."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for batch in _distinct(batches):
            if not batch.num_rows:
                continue
            begins = np.flatnonzero(np.concatenate(([True], _changes(_halves(batch.column("hash"))))))
            ends = np.append(begins[1:], batch.num_rows)
            if run is None or batch.column("hash")[0].as_py() != run.key:
                if run is not None:
                    yield from run.close(False)
                run = _Run(batch.slice(0, 1), run is None, least, often)
            yield from run.add(batch.slice(0, int(ends[0])))
            if len(begins) > 1:
                yield from run.close(False)
                # Runs that begin and end in this batch are settled together.
                sizes = (ends - begins)[1:-1]
                whole = np.repeat(sizes >= least, sizes)
                if whole.any():
                    inner = batch.slice(int(begins[1]), len(whole))
                    first = np.zeros(len(whole), bool)
                    first[begins[1:-1] - begins[1]] = True
                    n = np.repeat(sizes, sizes)
                    at = pa.array(np.flatnonzero(whole))
                    n, first = n[whole], first[whole]
                    yield _marked(inner.take(at), n, np.where(n >= often, 2, 1), first, np.zeros(len(n), bool))
                run = _Run(batch.slice(int(begins[-1]), 1), False, least, often)
                yield from run.add(batch.slice(int(begins[-1])))
        if run is not None:
            yield from run.close(True)

    return emit


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without repeats of (hash, doc), which equal rows of the table give."""
    last = None
    for batch in batches:
        if batch.num_rows:
            both = np.hstack([_halves(batch.column("hash")), _halves(batch.column("doc"))])
            fresh = np.concatenate(([last is None or bool((both[0] != last).any())], _changes(both)))
            last = both[-1].copy()
            batch = batch if fresh.all() else batch.filter(pa.array(fresh))
        yield batch


def _packed(at: list[int]) -> bytes:
    bits = np.zeros(max(at, default=-1) + 1, np.uint8)
    bits[at] = 1
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(at) for at in batch.column(1).to_pylist()], pa.binary())], ["doc", "drop"])


def _dropped(blob: bytes | None) -> set[int]:
    return set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))).tolist()) if blob else set()


def document_key(id_col: str, text_col: str):
    return row_key(F.col(id_col), F.col(text_col))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc, drop): for each document that loses lines, its key and a compressed bitmap of the lines to drop."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    at = F.col("at") if keep == "none" else _later()
    gone = repeated(docs, id_col, text_col, min_docs, min_docs, min_chars).select("doc", at.alias("at")).where(F.size("at") > 0)
    return gone.groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("at")).mapInArrow(_bitmap, "doc binary, drop binary")


def repeated(docs: DataFrame, id_col: str, text_col: str, min_docs: int, often_docs: int, min_chars: int = 1, partition_rows: int = 1_000_000, only: DataFrame | None = None) -> DataFrame:
    """(doc, at, first, often) of the lines found in ``min_docs`` documents or more: their places in a document, whether that has
    the first occurrence, and whether ``often_docs`` documents or more have the line.  With ``only``, documents whose key (doc) is
    not there are left out."""
    spark = docs.sparkSession
    lines = docs.select(F.col(id_col).cast("long").alias("id"), document_key(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # Written once: the range partitioning looks at the pairs twice.
    pairs = lines.mapInArrow(_pairs(min_chars), "hash binary, none boolean, id long, doc binary, at array<int>")
    pairs = cut(pairs if only is None else pairs.join(only, "doc", "left_semi").select(*_PAIR))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // partition_rows)
    order = ("hash", "none", "id", "doc")
    runs = cut(pairs.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_runs(min_docs, often_docs), _RUNS))
    rows = runs.where("not summary")
    whole = runs.where("summary").groupBy("hash").agg(F.sum("n").alias("total"), F.min(F.struct("none", "id", "doc")).alias("of"))
    settled = rows.where("not open").select("doc", "at", "first", (F.col("level") == 2).alias("often"))
    waiting = rows.where("open").join(whole, "hash").where(F.col("total") >= min_docs)
    return settled.unionByName(waiting.select("doc", "at", ((F.col("of.doc") == F.col("doc")) & F.col("of.id").eqNullSafe(F.col("id"))).alias("first"), (F.col("total") >= often_docs).alias("often")))


def _later() -> Column:
    """The places after a line's first occurrence."""
    return F.when(F.col("first"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))


def passage_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, only: DataFrame | None = None) -> DataFrame:
    """(doc, shared, later, often): for each document compressed bitmaps of the lines found in two documents or more, of those
    that are not the first occurrence, and of those again that are found in ``min_docs`` documents or more."""
    places = repeated(docs, id_col, text_col, 2, min_docs, only=only).select("doc", "at", _later().alias("later"), "often")
    lists = places.groupBy("doc").agg(*(F.flatten(F.collect_list(c)).alias(a) for c, a in ((F.col("at"), "shared"), (F.col("later"), "later"), (F.when(F.col("often"), F.col("later")), "often"))))

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([_packed(at) for at in batch.column(i).to_pylist()], pa.binary()) for i in (1, 2, 3))], ["doc", "shared", "later", "often"])

    return lists.where("size(later) > 0").mapInArrow(emit, "doc binary, shared binary, later binary, often binary")


def passage_lines(lines: list[bytes], shared: set[int], later: set[int], often: set[int], passage_words: int) -> set[int]:
    """Places of the lines to drop: those found often, and those of runs of shared lines (lines without words do not end a
    run) with ``passage_words`` words or more; always without first occurrences."""
    gone, run, words = set(often), [], 0
    for i, line in enumerate([*lines, None]):
        n = len(line.split()) if line is not None else 1
        if i in shared and line is not None:
            run.append(i)
            words += n
        elif n:
            if words >= passage_words:
                gone.update(later.intersection(run))
            run, words = [], 0
    return gone


def _rewritten(docs: DataFrame, maps: DataFrame, id_col: str, text_col: str, rewrite, only: DataFrame | None = None) -> DataFrame:
    """``docs`` with the texts that ``rewrite`` makes of a text and the bitmaps of its document; rows without bitmaps stay.  All
    columns of a row travel as one.  With ``only``, the documents of these keys, one row each."""
    names, schema, blobs = docs.columns, docs.schema, [c for c in maps.columns if c != "doc"]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), document_key(id_col, text_col).alias("doc"))
    marked = marked.join(maps, "doc", "left") if only is None else marked.join(cut(only.join(maps, "doc", "left")), "doc")

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            place = names.index(text_col)
            texts = [rewrite(text, *own).decode() for text, *own in zip(as_bytes(columns[place]), *(batch.column(c).to_pylist() for c in blobs))]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    same, changed = marked.where(F.col(blobs[0]).isNull()), marked.where(F.col(blobs[0]).isNotNull())
    if only is not None:
        same, changed = same.dropDuplicates(["doc"]), changed.dropDuplicates(["doc"])
    return same.select("row.*").unionByName(changed.select("row", *blobs).mapInArrow(emit, schema))


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, passage_words: int = 50, only: DataFrame | None = None) -> DataFrame:
    """The documents without lines found in ``min_docs`` documents and without passages (a line, or consecutive lines) of
    ``passage_words`` words whose lines are found in two; each line's first occurrence stays.  For texts that are no copies
    of each other: what is left of a copy would be no copy.  With ``only``, the documents of these keys (doc, each once), one row
    each: others are left out before lines are counted, and texts are shuffled once for both."""

    def rewrite(text: bytes, *blobs: bytes) -> bytes:
        lines = text.split(b"\n")
        gone = passage_lines(lines, *map(_dropped, blobs), passage_words)
        return b"\n".join(x for i, x in enumerate(lines) if i not in gone)

    return _rewritten(docs, passage_bitmaps(docs, id_col, text_col, min_docs, only), id_col, text_col, rewrite, only)


def kept_text(text: bytes, blob: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, the count of its lines, and of those dropped."""
    if not blob:
        return text, text.count(b"\n") + 1, 0
    lines, gone = text.split(b"\n"), _dropped(blob)
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def digests(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row, by the documents' bitmaps."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_text(t, b) for t, b in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), document_key(id_col, text_col).alias("doc"))
    return rows.join(maps, "doc", "left").select("id", "text", "drop").mapInArrow(emit, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def cleaned(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_percent: int = 50) -> DataFrame:
    """The documents with their kept text; other columns stay.  A document of which more than ``most_percent`` of the words
    would go stays whole: it may be a copy as a whole, which is for document deduplication to judge."""

    def rewrite(text: bytes, blob: bytes) -> bytes:
        kept, words = kept_text(text, blob)[0], len(text.split())
        return text if 100 * (words - len(kept.split())) > most_percent * words else kept

    return _rewritten(docs, maps, id_col, text_col, rewrite)
