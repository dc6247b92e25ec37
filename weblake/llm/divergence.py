"""How far the sources of a language are from one another, and the terms that set each of them apart.

Terms are runs of letters (A-Z lower-cased) and characters beyond ASCII.  A language keeps the terms found in at least
``min_docs`` of its documents.  Languages and sources are numbered first.  Tasks count terms by language and source and send them on
by (language, term), a row for each with its counts by source; a task then holds a sorted share of the terms, cuts it into chunks, and
encodes a chunk by integers: the kept terms in an array sorted by UTF-8 bytes, each row's id found in it by binary search, and the
counts added up by (source, id) into dense vectors.  Ids of a chunk are in the order of the terms, so equal values are told apart by
id.  Chunks are written once; sizes, pairs and listed terms are sums over them.

All arithmetic is in 64-bit integers and exact for counts below 10 ** 15.  A chunk has at most ``cells`` counts (terms times
sources), so tasks are bounded by it whatever the vocabulary; a term has at most one row of each task's share.  The numbered groups go
to the tasks with the code: the result has the square of a language's sources, so more than ``max_groups`` are an error.

Defined results: null language, source and text are empty strings; a group without kept terms has pairs of value 0 where the
language keeps none, and else those of its empty counts; a language of one source has no pairs; equal rows count as often as
they occur; very long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, release, tidy

#: The scale of a probability, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2

#: Letters as they are (A-Z lower-cased), bytes of other characters as they are, anything else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang int, term string, docs long, sources array<int>, n array<bigint>"
_CHUNKS = "lang int, terms array<string>, counts array<bigint>, sums array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def numbered(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", max_groups: int = 100_000) -> dict[str, list[str]]:
    """The sources of each language, both in the order of their UTF-8 bytes."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct().limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"more than {max_groups} sources")
    out: dict[str, list[str]] = {}
    for lang, source in sorted(((r["lang"], r["source"]) for r in rows), key=lambda r: (r[0].encode(), r[1].encode())):
        out.setdefault(lang, []).append(source)
    return out


def _counted(lang: int, docs: Counter, sources: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a language with its counts by source."""
    place = {t: i for i, t in enumerate(docs)}
    at = [np.fromiter(map(place.__getitem__, counts), np.int64, len(counts)) for counts in sources.values()]
    n = [np.fromiter(counts.values(), np.int64, len(counts)) for counts in sources.values()]
    source = np.repeat(np.fromiter(sources, np.int32, len(sources)), [len(x) for x in at])
    at, n = np.concatenate(at), np.concatenate(n)
    order = np.argsort(at, kind="stable")
    at, n, source = at[order], n[order], source[order]
    edges = np.searchsorted(at, np.arange(len(place) + 1))
    terms, held = list(docs), np.fromiter(docs.values(), np.int64, len(docs))
    for a in range(0, len(terms), 50_000):
        b = min(len(terms), a + 50_000)
        offsets, part = pa.array((edges[a : b + 1] - edges[a]).astype(np.int32)), slice(edges[a], edges[b])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[part])) for x in (source, n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, lang, np.int32)), pa.array(terms[a:b], pa.binary()).cast(pa.string()), pa.array(held[a:b]), *lists], ["lang", "term", "docs", "sources", "n"])


def _count(groups: dict[str, list[str]], flush: int):
    langs = {k.encode(): i for i, k in enumerate(groups)}
    places = [{s.encode(): j for j, s in enumerate(v)} for v in groups.values()]

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, Counter] = {}
        counts: dict[int, dict[int, Counter]] = {}
        held = 0
        for batch in batches:
            for name, source, text in zip(*map(as_bytes, batch.columns)):
                if not (words := terms_of(text)):
                    continue
                lang = langs[name]
                own = counts.setdefault(lang, {}).setdefault(places[lang][source], Counter())
                before = len(own)
                own.update(words)
                docs.setdefault(lang, Counter()).update(set(words))
                held += len(own) - before
                if held >= flush:
                    for k in counts:
                        yield from _counted(k, docs[k], counts[k])
                    docs, counts, held = {}, {}, 0
        for k in counts:
            yield from _counted(k, docs[k], counts[k])

    return emit


def _encoded(table: pa.Table, n_sources: int, min_docs: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The chunks of sorted rows of one language: all rows of each of its terms."""
    lang = table.column("lang")[0].as_py()
    rows = np.array(as_bytes(table.column("term").combine_chunks()), object)
    begins = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    kept = rows[begins[np.add.reduceat(table.column("docs").to_numpy(), begins) >= min_docs]]
    lists = {c: table.column(c).combine_chunks() for c in ("sources", "n")}
    lengths = np.diff(lists["n"].offsets.to_numpy())
    source, n = (lists[c].flatten().to_numpy() for c in ("sources", "n"))
    step = max(1, cells // n_sources)
    for a in range(0, len(kept), step):
        terms = kept[a : a + step]
        size = len(terms)
        ids = np.searchsorted(terms, rows)
        there = ids < size
        there[there] = terms[ids[there]] == rows[there]
        each = np.repeat(there, lengths)
        # One cell for each (source, id): the counts of all groups in one go.
        dense = np.zeros(n_sources * size, np.int64)
        np.add.at(dense, source[each].astype(np.int64) * size + np.repeat(ids, lengths)[each], n[each])
        lists_of = [pa.array([x], kind) for x, kind in (([t.decode() for t in terms], pa.list_(pa.string())), (dense, pa.list_(pa.int64())), (dense.reshape(n_sources, size).sum(axis=1), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int32()), *lists_of], ["lang", "terms", "counts", "sums"])


def _encode(sizes: list[int], min_docs: int, cells: int):
    def complete(table: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = table.column("lang").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), len(langs)]
        for a, b in zip(edges, edges[1:]):
            yield from _encoded(table.slice(a, b - a), sizes[langs[a]], min_docs, cells)

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held < cells // 4:
                continue
            release()
            table = pa.concat_tables(waiting).combine_chunks()
            # All rows of the last term wait for those that may follow.
            last = table.slice(table.num_rows - 1)
            same = pc.and_(*(pc.equal(table.column(c), last.column(c)[0]) for c in ("lang", "term")))
            a = int(np.argmax(same.to_numpy()))
            if a:
                yield from complete(table.slice(0, a).combine_chunks())
            waiting, held = [table.slice(a)], table.num_rows - a
        if held:
            yield from complete(pa.concat_tables(waiting).combine_chunks())

    return emit


def chunks(docs: DataFrame, groups: dict[str, list[str]], min_docs: int = 10, cells: int = 1 << 18, flush: int = 1_000_000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, terms, counts, sums): the encoded counts of kept terms: those of the first source in the order of ``terms``, then those
    of the next; ``sums`` adds up each source's."""
    named = docs.select(F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col))
    counts = named.mapInArrow(_count(groups, flush), _COUNTS)
    return counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_encode([len(v) for v in groups.values()], min_docs, cells), _CHUNKS)


def probabilities(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * kept)), a thousand at a time so that nothing leaves 64 bits."""
    whole = total + ADDED * kept
    out = (counts + ADDED) // whole
    rest = (counts + ADDED) % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(groups: dict[str, list[str]], kept: list[int], totals: list[list[int]], top: int):
    langs = list(groups)

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                names, terms = groups[langs[lang]], batch.column("terms")[i].values
                counts = batch.column("counts")[i].values.to_numpy().reshape(len(names), -1)
                out: list[tuple] = []
                pairs = np.zeros((len(names), len(names)), np.int64)
                if len(terms):
                    p = np.stack([probabilities(c, t, kept[lang]) for c, t in zip(counts, totals[lang])])
                    for a in range(len(names) - 1):
                        pairs[a, a + 1 :] = _distance(p[a], p[a + 1 :]).sum(axis=1)
                    q = probabilities(counts.sum(axis=0), sum(totals[lang]), kept[lang])
                    for a, s in enumerate(names):
                        ids = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                        value = _distance(p[a][ids], q[ids])
                        best = np.lexsort((ids, -value))[:top]
                        out += [(s, "term", terms[int(ids[j])].as_py(), int(value[j])) for j in best]
                pairs += pairs.T
                out += [(s, "pair", item, int(pairs[a, b])) for a, s in enumerate(names) for b, item in enumerate(names) if a != b]
                source, part, item, value = zip(*out) if out else ((), (), (), ())
                columns = [pa.array([langs[lang]] * len(out), pa.string()), *(pa.array(c, pa.string()) for c in (source, part, item)), pa.array(value, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])

    return emit


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, cells: int = 1 << 18, flush: int = 1_000_000, max_groups: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distances to the language's other sources
    (``pair``) and the ``top`` terms that it has more of than the language as a whole (``term``)."""
    groups = numbered(docs, max_groups=max_groups)
    encoded = cut(chunks(docs, groups, min_docs, cells, flush))
    kept, totals = [0] * len(groups), [[0] * len(v) for v in groups.values()]
    for r in encoded.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept")).collect():
        kept[r["lang"]] = r["kept"]
    for r in encoded.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("total")).collect():
        totals[r["lang"]][r["pos"]] = r["total"]
    # An empty chunk of each language, so that languages that keep nothing have their pairs.
    empty = docs.sparkSession.createDataFrame([(i, [], [], []) for i in range(len(groups))], _CHUNKS)
    parts = cut(encoded.unionByName(empty).mapInArrow(_compare(groups, kept, totals, top), "lang string, source string, part string, item string, value long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


#: The same audit in DuckDB.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), tokens AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p FROM cells JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN sizes USING (lang)
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
