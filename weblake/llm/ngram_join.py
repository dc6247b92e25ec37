"""Self-join of documents by the Jaccard similarity of their word n-gram sets, by token-combination prefixes.

Tokens (shingle hashes) are ordered by a class of their document frequency, rare first, then by hash.  A set that may
miss at most ``m`` tokens and still reach the threshold needs a prefix worth ``m + 1``: a rare token counts at once and is
indexed alone; frequent tokens are indexed as pairs within a segment of the hash range (about four of a set's tokens), so the prefix
is extended by one token a segment.  Two similar sets share a signature, since what one of them may
miss cannot break every combination of both prefixes.  Segments depend on a band of set sizes; a set is indexed in
each band a partner may be of.

Steps, all Spark jobs over whole texts:

1. Sets are hashed; equal sets are one class from here on (a class of copies costs as one document).
2. Document frequencies: documents are dealt to chunks of a bounded count of shingles; each chunk sends its distinct
   tokens, cut to the bits that the corpus needs, to ranges of tokens, which answer with classes.  A token that all
   documents share is one entry a chunk.  Tokens of frequency 1 can be in no overlap: sets with more of them than
   they may miss have no links and leave here.
3. Signatures meet.  Each class is verified against three members of each signature's classes; only pairs in different
   components so far are left, and of those all that sizes and a 512-bit sketch of the sets leave possible are verified.  Pairs within a component need no
   check for components.
4. Components by minimum labels with pointer jumping; documents get the smallest id of theirs.
5. Links join classes of one component only, so to count them each component's classes are compared with each other, all
   pairs of them.  A large component is dealt to blocks, and a task has the pairs of two blocks.

Defined results: a null or empty text, or one without words, has the empty set, links with nothing and is its own
component; a text of fewer words than the n-gram has one shingle, the whole sequence; equal rows are copies; rows that
share an id are separate documents of one id; null ids are never the smallest id; whole texts are read however long they are;
of the table's columns only the id and the text are read, so others cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, cut, mix, row_key, tidy, windows, word_hashes

#: The document frequency up to which a token is rare and indexed alone.
RARE = 32
#: Members of a signature in a block of the join of signatures.
SPREAD = 128
#: 64-bit words of a set's sketch: a bit for each hash value modulo 512 that its shared tokens have.
SKETCH = 8


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in blocks(map(len, texts)):
        h, counts, _ = word_hashes(texts[a:b])
        for n, end in zip(counts.tolist(), np.cumsum(counts).tolist()):
            if n >= k:
                w = windows(h[end - n : end], k)
                w.sort()
                yield w[np.concatenate(([True], w[1:] != w[:-1]))]
            else:
                yield windows(h[end - n : end], n) if n else np.empty(0, np.uint64)


def set_class(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def may_miss(n: int, percent: int) -> int:
    """How many of n tokens may lie outside the overlap."""
    return n - -(-percent * n // 100)


def signatures(tokens: np.ndarray, classes: np.ndarray, alone: int, n: int, percent: int) -> np.ndarray:
    """Signatures of a set of n tokens, ``alone`` of them of frequency 1; ``tokens``: the others, sorted, with classes."""
    need = may_miss(n, percent) + 1 - alone
    if need <= 0:
        return np.empty(0, np.uint64)
    out = []
    for band in range(n.bit_length() - 1, (n * 100 // percent).bit_length()):
        # Each segment costs one token, and what a set must share of the band's sizes pays for half of them at least.
        room = min(1 << band >> 2, (percent * percent << band) // 20_000)
        size = np.minimum(classes, 2) if room else np.ones(len(classes), np.int64)
        bits = max(0, room.bit_length() - 1)
        segment = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        group = np.where(size > 1, (size << 40) + segment, 0)
        order = np.lexsort((tokens, group, size))
        t, g, s = tokens[order], group[order], size[order]
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        inside = np.arange(len(t)) - np.repeat(begin, np.diff(np.append(begin, len(t))))
        worth = np.cumsum(inside >= s - 1)
        end = int(np.searchsorted(worth, need)) + 1
        t, g, s = t[:end], g[:end], s[:end]
        out.append(t[s == 1])
        for a, b in zip(begin, np.append(begin[1:], len(order))):
            if a < end and s[a] > 1:
                part = t[a : min(b, end)]
                i, j = np.triu_indices(len(part), 1)
                out.append(mix(part[i] * np.uint64(3) + part[j] * np.uint64(5) + np.uint64(band)))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[((tokens >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _measure(k: int):
    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_class(s) if len(s) else None) for s in shingle_sets(as_bytes(batch.column(2)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in sets], pa.int64()), pa.array([c for _, c in sets], pa.binary())], ["id", "row", "n", "cls"])

    return emit


class _Chunk:
    """The representatives' sets of one chunk of documents, and its distinct tokens cut to ``bits`` bits."""

    def __init__(self, left: pa.Table, rows: list[bytes], k: int, bits: int):
        order, at = {}, left.column("row").to_pylist()
        wanted = set(rows)
        for i, r in enumerate(at):
            if r in wanted:
                order.setdefault(r, i)
        texts = as_bytes(left.column("text").take(pa.array(list(order.values()), pa.int64())).combine_chunks())
        self.sets = list(shingle_sets(texts, k))
        tokens = np.concatenate([*self.sets, np.empty(0, np.uint64)]) >> np.uint64(64 - bits)
        # A token counts once a set; two of a set's hashes that are cut to one value count twice, which is rare and
        # only makes it look more frequent.
        self.own, self.back, self.counts = np.unique(tokens, return_inverse=True, return_counts=True)


def _ask(k: int, bits: int, buckets: int):
    """Buckets are ranges of tokens, told by their first bits; a chunk sends a row to those only that it has tokens of, so there
    are never more rows than tokens."""
    shift = np.uint64(bits - (buckets.bit_length() - 1))

    @tidy
    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            c = _Chunk(left, right.column("row").to_pylist(), k, bits)
            chunk = right.column("chunk")[0].as_py()
            bucket = c.own >> shift
            begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(bucket)).tolist()):
                rows.append((int(bucket[a]), chunk, _planes(np.diff(c.own[a:b], prepend=np.uint64(0))), _planes(np.minimum(c.counts[a:b], 65535).astype(np.uint16))))
        cols = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "counts"])

    return emit


@tidy
def _answer(table: pa.Table) -> pa.Table:
    """Classes of the tokens that each chunk asked about, in its order."""
    keys = [np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unplanes(x, np.uint16) for x in table.column("counts").to_pylist()]).astype(np.int64)
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, counts)
    classes = np.searchsorted(np.array([1, RARE]), total, side="left").astype(np.uint8)[back]
    parts = np.split(classes, np.cumsum([len(x) for x in keys])[:-1])
    return pa.table([table.column("chunk"), pa.array([None] * len(parts), pa.binary()), table.column("bucket"), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["chunk", "row", "bucket", "classes"])


def _index(k: int, bits: int, percent: int):
    @tidy
    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        rows = [r for r in right.column("row").to_pylist() if r is not None]
        if left.num_rows and rows:
            c = _Chunk(left, rows, k, bits)
            said = sorted((b, x) for b, x in zip(right.column("bucket").to_pylist(), right.column("classes").to_pylist()) if b is not None)
            classes = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for _, x in said])[c.back].astype(np.int64)
            end = 0
            for tokens in c.sets:
                own = classes[end : end + len(tokens)]
                end += len(tokens)
                n, shared = len(tokens), own > 0
                alone = n - int(shared.sum())
                if alone <= may_miss(n, percent):
                    t = tokens[shared]
                    out.append((set_class(tokens), n, alone, t.tobytes(), signatures(t, own[shared], alone, n, percent).view(np.int64), *sketch(t).tolist()))
        cols = list(zip(*out)) or [()] * (5 + SKETCH)
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * SKETCH))], ["cls", "n", "alone", "tokens", "sigs", *_BITS])

    return emit


def _linked(percent: int):
    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb"))):
                both = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return emit


_BITS = [f"s{i}" for i in range(SKETCH)]


def _overlap_possible(percent: int):
    """The same with sketches: a bit that one set has and the other has not is a token that they do not share."""
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{x}0").bitwiseAND(F.bitwise_not(F.col(f"{y}0")))))
    most = F.least(F.col("na") - F.col("ua") - lacks("s", "t"), F.col("nb") - F.col("ub") - lacks("t", "s"))
    return 100 * most >= percent * (F.col("na") + F.col("nb") - most)


def _possible(percent: int, na="na", nb="nb", ua="ua", ub="ub"):
    """Whether sizes and unshared tokens leave room for a link."""
    most = F.least(F.col(na) - F.col(ua), F.col(nb) - F.col(ub))
    return 100 * most >= percent * (F.col(na) + F.col(nb) - most)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of classes that link."""
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_linked(percent), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each node's component, for the nodes of (a, b) edges.  Each round takes the smallest
    label of a node and its neighbours, then that label's own label."""
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select("a", "comp", F.lit(None).cast("binary").alias("was"))
        low = near.union(labels.select("node", "comp", "comp")).groupBy("a").agg(F.min("comp").alias("to"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        stepped = cut(low.join(jump, "to").select(F.col("a").alias("node"), "was", F.least("to", "far").alias("comp")))
        labels = stepped.select("node", "comp")
        if stepped.where("was <> comp").isEmpty():
            return labels


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many tokens each two of the sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Tokens of one set alone are in no overlap; the others' columns are numbered anew.
    shared = counts[token] > 1
    owner, token = owner[shared], (np.cumsum(counts > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((n, n), np.float64)
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, columns):
        a, b = np.searchsorted(token, (first, first + columns))
        held = np.zeros((n, columns), np.float32)
        held[owner[a:b], token[a:b] - first] = 1
        both += held @ held.T
    return both.astype(np.int64)


def _counted(percent: int):
    @tidy
    def emit(table: pa.Table) -> pa.Table:
        table = table.select(["comp", "i", "j", "b", "cls", "n", "tokens"]).sort_by("comp")
        comp, i, j = (table.column(c).to_pylist() for c in ("comp", "i", "j"))
        block, n = np.array(table.column("b").to_pylist(), np.int64), np.array(table.column("n").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        links, a = np.zeros(len(sets), np.int64), 0
        while a < len(sets):
            b = a + 1
            while b < len(sets) and comp[b] == comp[a]:
                b += 1
            both, m = _overlaps(sets[a:b]), n[a:b]
            linked = (both > 0) & (100 * both >= percent * (m[:, None] + m[None, :] - both))
            np.fill_diagonal(linked, False)
            if i[a] != j[a]:
                linked &= block[a:b, None] != block[None, a:b]
            links[a:b] = linked.sum(axis=1)
            a = b
        return pa.table([table.column("cls"), pa.array(links, pa.int64())], ["cls", "links"])

    return emit


def link_counts(sets: DataFrame, comp: DataFrame, percent: int, block: int = 256, block_tokens: int = 500_000) -> DataFrame:
    """(cls, links) of the classes in components of (node, comp): how many other classes each links with."""
    members = cut(comp.join(sets.select("cls", "n", "tokens"), comp["node"] == sets["cls"]).select("comp", "cls", "n", "tokens"))
    parts = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / block_tokens)).cast("int")
    buckets = members.agg(parts()).first()[0] or 1
    sizes = members.groupBy("comp").agg(parts().alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("b", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    # A component of one block shares its task with others.
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(buckets))).otherwise(F.xxhash64("comp")).alias("g"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "comp", "b", "cls", "n", "tokens"
    )
    return dealt.groupBy("g", "i", "j").applyInArrow(_counted(percent), "cls binary, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def link_classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, chunk_tokens: int = 1_500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row of ``docs`` (id, row, n, cls), (node, comp) of the classes that have links, and classes with their tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row"))
    measured = cut(rows.select("id", "row", "text").mapInArrow(_measure(k), "id long, row binary, n long, cls binary"))
    spark = docs.sparkSession
    none = spark.createDataFrame([], "node binary, comp binary")
    total = measured.agg(F.sum("n")).first()[0] or 0
    if not total:
        return measured, none, spark.createDataFrame([], "cls binary, n long, tokens binary")
    chunks = max(1, total // chunk_tokens)
    buckets = 1 << (chunks.bit_length() - 1)
    bits = min(62, total.bit_length() + 14)
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")
    firsts = measured.where("n > 0").groupBy("cls").agg(F.min("row").alias("row")).select(chunk, "row")
    # As many tasks as the texts need: their count follows the input, whatever the session's count is.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks // 4)
    texts = rows.select(chunk, "row", "text")
    asked = texts.repartition(tasks, "chunk").groupBy("chunk").cogroup(firsts.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_ask(k, bits, buckets), "bucket long, chunk long, keys binary, counts binary")
    answers = asked.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answer, "chunk long, row binary, bucket long, classes binary")
    sides = firsts.select("chunk", "row", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("classes")).union(answers)
    sets = cut(texts.repartition(tasks, "chunk").groupBy("chunk").cogroup(sides.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_index(k, bits, percent), "cls binary, n long, alone long, tokens binary, sigs array<long>, " + ", ".join(f"{b} long" for b in _BITS)))

    signed = sets.select("cls", "n", "alone", F.explode("sigs").alias("sig"))
    # Three members of each signature stand for it: the one with the fewest tokens of its own, and two by a hash.
    member = lambda first: F.min(F.struct(first.alias("o"), "cls", "n", "alone"))
    pivots = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("many"), *(member(o).alias(f"p{i}") for i, o in enumerate((F.col("alone"), F.xxhash64("cls", F.lit(1)), F.xxhash64("cls", F.lit(2)))))).where("many > 1")
    pivots = pivots.select("sig", F.col("p0.cls").alias("home"), F.array(*(F.struct(f"p{i}.cls", f"p{i}.n", f"p{i}.alone") for i in range(3))).alias("p"))
    met = cut(signed.join(pivots, "sig").select("sig", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("alone").alias("ua"), "home", "p"))
    pairs = met.select("a", "na", "ua", F.explode(F.array_distinct("p")).alias("p")).select("a", "na", "ua", F.col("p.cls").alias("b"), F.col("p.n").alias("nb"), F.col("p.alone").alias("ub"))
    edges = cut(verified(pairs.where((F.col("a") != F.col("b")) & _possible(percent)).select("a", "b").distinct(), sets, percent))
    comp = components(edges) if not edges.isEmpty() else none

    # What is not in its signature's component is compared with all that are left.
    own, other = comp.toDF("a", "ca"), comp.toDF("home", "ch")
    held = met.join(own, "a", "left").join(other, "home", "left").select("sig", "a", "na", "ua", F.coalesce("ca", "a").alias("ca"), (F.coalesce("ca", "a") != F.coalesce("ch", "home")).alias("apart"))
    held = cut(held.join(held.where("apart").select("sig").distinct(), "sig", "left_semi"))
    if held.isEmpty():
        return measured, comp, sets
    bits = sets.select(F.col("cls").alias("a"), *_BITS)
    # The members of a signature are dealt to blocks; those that are apart meet each block in a row of its own, so that the
    # comparisons of a signature that many classes have are shared by many tasks.
    sizes = held.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("blocks"))
    held = held.join(sizes, "sig")
    left = held.where("apart").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("apart", "blocks").join(bits, "a")
    right = held.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).join(bits, "a").select("block", "sig", F.col("a").alias("q"), F.col("na").alias("nb"), F.col("ua").alias("ub"), F.col("ca").alias("cq"), F.col("apart").alias("apart_too"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)))
    pairs = left.join(right, ["sig", "block"]).where((F.col("ca") != F.col("cq")) & (~F.col("apart_too") | (F.col("a") < F.col("q"))) & _overlap_possible(percent)).select("a", F.col("q").alias("b"))
    late = cut(verified(pairs.distinct(), sets, percent))
    return measured, (comp if late.isEmpty() else components(edges.union(late))), sets


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 1_500_000, links: bool = True, block: int = 256) -> DataFrame:
    """(id, row, n_shingles, component_id, class_id, class_low, comp, n_links) per row of ``docs``; ``row`` is ``row_key(id, text)``, ``class_id``
    names the documents of an equal set, ``class_low`` is their smallest id, and ``comp`` names the component (null without words); ``n_links`` is the count of other classes that this one links
    with, whatever their component's shape.  Without ``links`` that column is left out, and its work."""
    measured, comp, sets = link_classes(docs, k, percent, id_col, text_col, chunk_tokens)
    classes = measured.where("n > 0").groupBy("cls").agg(F.min("id").alias("low"))
    joined = classes.join(comp, classes["cls"] == comp["node"], "left").select("cls", "low", F.coalesce("comp", "cls").alias("comp"))
    lows = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = joined.join(lows, "comp").select(F.col("cls").alias("of"), F.col("low").alias("class_low"), "component_id", "comp")
    more = []
    if links:
        found = link_counts(sets, comp, percent, block).withColumnRenamed("cls", "linked")
        named = named.join(found, named["of"] == found["linked"], "left").select("of", "class_low", "component_id", "comp", "links")
        more = [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")]
    return measured.join(named, measured["cls"] == named["of"], "left").select("id", "row", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.lower(F.hex("cls")).alias("class_id"), F.coalesce("class_low", "id").alias("class_low"), "comp", *more)
