"""An n-gram language model in a trie of Elias-Fano levels, built and queried by Spark tasks.

Level 1 holds all words of the training texts (64-bit hashes, sorted); level n holds the n-grams found ``min_count``
times or more, as (node of the first n - 1 words, last word), sorted.  A level is cut into shards by ranges of its contexts,
each a file in the folder all executors share: the last words, each added to what the contexts before it need, as an
Elias-Fano sequence, discounted probabilities quantised to 16 bits, packed counts; and for each node of the level below the
monotone pointers to its successors and its quantised back-off weight.  Tasks map the files into memory; a query
finds a context's node, by its pointers the range of its successors, by the value before that range what the word is relative
to, and the word in that range alone by successor search.

Probabilities are interpolated with absolute discounting: P(w|h) = max(c(hw) - D, 0) / c(h) + b(h) P(w|h'), where b(h)
is what the kept n-grams leave over, so they add up to 1 with any pruning; level 1 is (c + 1) / (N + V + 1).

Counting: each task counts its own n-grams and sends one packed list for each range of keys, so a frequent n-gram is
one entry per task; ranges come from quantiles of a bounded sample of keys and are as many as the text needs
(``shard_chars``).  N-grams are counted only if their parts are kept, which loses none that can be kept.

Defined results: a null text is the empty text: one end token; words not in training have c = 0; without training texts
every token has probability 1 / (0 + 0 + 1); equal rows count as often as they occur; very long texts are a block of their
own; of the tables' columns only the text and the kept ones are read, so others cannot clash.  Contexts times words must fit in
64 bits, which is checked.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, cut, file_system, hashed_words, mix, shared_dir, tidy
from .elias_fano import EliasFano, encode, pack_bits, read_bits

END = np.uint64(0x5E1F_E11D_0F_7E87)
#: Quantised logarithms: 0 is probability 1, a step is 16 / 65535 of a power of ten.
_STEP = 16 / 65535
_BLOCK_CHARS = 6 << 20
_HELD = 1_500_000


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / _STEP), 0, 65535).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) * _STEP)


# --- files ------------------------------------------------------------------------------------------------------


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """One file of named arrays, 8-byte aligned, under a name of this attempt."""
    name = f"{name}-{uuid.uuid4().hex}.lvl"
    index, body, at = {}, io.BytesIO(), 0
    for k, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        index[k] = (at, a.dtype.str, len(a))
        pad = -len(data) % 8
        body.write(data + bytes(pad))
        at += len(data) + pad
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 8)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(len(head).to_bytes(8, "little") + head + body.getvalue())
    return name


@lru_cache(4096)
def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the folder is a mounted one, read once otherwise."""
    fs, root = file_system(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        data = np.memmap(f"{root}/{name}", np.uint8, "r")
    else:
        with fs.open_input_stream(f"{root}/{name}") as stream:
            data = np.frombuffer(stream.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    index = json.loads(data[8 : 8 + size].tobytes())
    return {k: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in index.items()}


@lru_cache(4096)
def _sequence(folder: str, name: str, prefix: str) -> EliasFano:
    return EliasFano(map_arrays(folder, name), prefix)


def _seen(keys: np.ndarray) -> np.ndarray:
    """A bit for each of the keys' hash values, eight bits a key or more: spares the search for most keys that are not there."""
    bits = np.zeros(1 << max(6, int(8 * len(keys)).bit_length()), np.uint8)
    bits[mix(keys) >> np.uint64(64 - (len(bits).bit_length() - 1))] = 1
    return np.packbits(bits, bitorder="little")


def _maybe(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that may be there."""
    at = mix(keys) >> np.uint64(64 - (8 * len(seen)).bit_length() + 1)
    return np.flatnonzero((seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


# --- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Level:
    """Shards of a level in the order of their keys: first keys (looked at for words only), first nodes, files; ``above``: files with pointers
    and back-off weights for this level's nodes, and the first successor of each."""

    starts: np.ndarray
    bases: np.ndarray
    names: list[str]
    above: list[str | None] = field(default_factory=list)
    firsts: np.ndarray | None = None


@dataclass
class Model:
    folder: str
    tokens: int
    words: int
    levels: list[Level]

    def _by_shard(self, shard: np.ndarray):
        """(shard, indices) of runs of equal shards; the input need not be sorted."""
        # Numbers of 16 bits are sorted digit by digit.
        order = np.argsort(shard.astype(np.int16) if len(shard) and shard.max() < 2**15 else shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(shard[part[0]]), part

    def words_of(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of word hashes at level 1, -1 where there is none."""
        level, out = self.levels[0], np.full(len(keys), -1, np.int64)
        shard = np.searchsorted(level.starts, keys, side="right") - 1
        for s, at in self._by_shard(shard):
            if s >= 0:
                found = _sequence(self.folder, level.names[s], "key_").find(keys[at] - level.starts[s])
                out[at] = np.where(found >= 0, found + level.bases[s], -1)
        return out

    def counts(self, n: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of nodes at level n, 0 for -1."""
        level, out = self.levels[n - 1], np.zeros(len(nodes), np.int64)
        for s, at in self._by_shard(np.where(nodes < 0, -1, np.searchsorted(level.bases, nodes, side="right") - 1)):
            if s >= 0:
                a = map_arrays(self.folder, level.names[s])
                out[at] = read_bits(a["count"], int(a["width"][0]), nodes[at] - level.bases[s]).astype(np.int64)
        return out

    def probabilities(self, n: int, nodes: np.ndarray) -> np.ndarray:
        """Discounted probabilities of nodes at level n, 0 for -1."""
        level, out = self.levels[n - 1], np.zeros(len(nodes))
        for s, at in self._by_shard(np.where(nodes < 0, -1, np.searchsorted(level.bases, nodes, side="right") - 1)):
            if s >= 0:
                out[at] = restore(map_arrays(self.folder, level.names[s])["prob"][nodes[at] - level.bases[s]])
        return out

    def contexts(self, n: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Back-off weights of nodes at level n, and the range of their successors at level n + 1."""
        level = self.levels[n - 1]
        weight, begin, end = np.ones(len(nodes)), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for s, at in self._by_shard(np.where(nodes < 0, -1, np.searchsorted(level.bases, nodes, side="right") - 1)):
            if s >= 0 and level.above[s] is not None:
                local = nodes[at] - level.bases[s]
                weight[at] = restore(map_arrays(self.folder, level.above[s])["backoff"][local])
                some = np.flatnonzero(weight[at] < 1)
                pointers = _sequence(self.folder, level.above[s], "ptr_")
                a, b = pointers.span(local[some])
                begin[at[some]], end[at[some]] = a.astype(np.int64) + level.firsts[s], b.astype(np.int64) + level.firsts[s]
        return weight, begin, end

    def pairs(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """One number for a node and a word."""
        if len(contexts) and (int(contexts.max()) + 1) * max(1, self.words) >= 2**64:
            raise OverflowError("contexts times words do not fit in 64 bits")
        return contexts.astype(np.uint64) * np.uint64(max(1, self.words)) + words.astype(np.uint64)

    def successors(self, n: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of a node at level n - 1 and a word: the node at level n or -1, and the context's back-off."""
        pairs, back = np.unique(self.pairs(contexts, words), return_inverse=True)
        context, word = (pairs // np.uint64(max(1, self.words))).astype(np.int64), pairs % np.uint64(max(1, self.words))
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.empty(0, np.int64)
        runs = np.diff(np.append(first, len(context)))
        weight, begin, end = self.contexts(n - 1, context[first])
        level, node = self.levels[n - 1], np.full(len(pairs), -1, np.int64)
        # A context's successors are in one shard, told by where they begin.
        shard = np.where(end > begin, np.searchsorted(level.bases, begin, side="right") - 1, -1)
        of = np.repeat(np.arange(len(first)), runs)
        for s, at in self._by_shard(shard[of]):
            if s < 0:
                continue
            keys, arrays = _sequence(self.folder, level.names[s], "key_"), map_arrays(self.folder, level.names[s])
            # Pairs are sorted, so a context's are side by side.
            begins = np.concatenate(([True], of[at[1:]] != of[at[:-1]]))
            own, place = of[at[begins]], np.cumsum(begins) - 1
            low, high = begin[own] - level.bases[s], end[own] - level.bases[s]
            zero = np.zeros(len(own), np.uint64)
            later = np.flatnonzero(low > 0)
            zero[later] = keys.get(low[later] - 1) + np.uint64(1)
            x = zero[place] + word[at]
            some = _maybe(arrays["seen"], x)
            found = keys.find(x[some], low[place[some]], high[place[some]])
            node[at[some]] = np.where(found >= 0, found + level.bases[s], -1)
        return node[back], np.repeat(weight, runs)[back]


class _Tokens:
    """The tokens of a block of texts: vocabulary nodes (-1: not known), counts, and the text of each."""

    def __init__(self, model: Model, texts: list[bytes]):
        h, sizes = hashed_words(texts)
        self.sizes = sizes + 1
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        keys = np.full(len(self.text), END, np.uint64)
        keys[np.arange(len(h)) + np.repeat(np.arange(len(texts)), sizes)] = h
        own, back = np.unique(keys, return_inverse=True)
        node = model.words_of(own) if model.levels else np.full(len(own), -1, np.int64)
        count = model.counts(1, node) if model.levels else np.zeros(len(own), np.int64)
        self.node, self.count = node[back], count[back]

    def grams(self, model: Model, n: int, nodes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places i where the n - 1 words from i are a kept context and the next word is in the same text and found
        ``least`` times or more; the contexts' nodes and the next words."""
        last = len(self.text) - n + 1
        if last <= 0:
            return (np.empty(0, np.int64),) * 3
        i = np.flatnonzero((nodes[:last] >= 0) & (self.text[:last] == self.text[n - 1 :]) & (self.count[n - 1 :] >= least))
        return i, nodes[i], self.node[i + n - 1]


# --- counting -------------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _keys(model: Model, n: int, texts: list[bytes], least: int) -> np.ndarray:
    """The keys of the level-n grams of the texts that can be kept."""
    if n == 1:
        h, _ = hashed_words(texts)
        return np.concatenate((h, np.full(len(texts), END, np.uint64)))
    t = _Tokens(model, texts)
    nodes = np.where(t.count >= least, t.node, -1)
    for k in range(2, n):
        i, context, word = t.grams(model, k, nodes, least)
        up = np.full(len(nodes), -1, np.int64)
        up[i] = model.successors(k, context, word)[0]
        nodes = up
    i, context, word = t.grams(model, n, nodes, least)
    if n > 2:
        # The last n - 1 words must be kept as well.
        ok = nodes[i + 1] >= 0
        context, word = context[ok], word[ok]
    return model.pairs(context, word)


def _count(model: Model, n: int, bounds: np.ndarray, least: int):
    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush():
            k, c = _add(keys, counts)
            keys.clear(), counts.clear()
            cuts = np.concatenate((np.searchsorted(k, bounds), [len(k)]))
            rows = [(b, s, e) for b, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if e > s]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in rows], pa.int32()),
                    pa.array([_planes(np.diff(k[s:e], prepend=np.uint64(0))) for _, s, e in rows], pa.binary()),
                    pa.array([_planes(c[s:e]) for _, s, e in rows], pa.binary()),
                ],
                ["shard", "keys", "counts"],
            )

        held = 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in blocks(map(len, texts), _BLOCK_CHARS):
                k, c = np.unique(_keys(model, n, texts[a:b], least), return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.uint64))
                held += len(k)
                if held > _HELD:
                    k, c = _add(keys, counts)
                    keys[:], counts[:] = [k], [c]
                    if len(k) > _HELD // 2:
                        yield flush()
                    held = sum(map(len, keys))
        yield flush()

    return emit


def _sample(model: Model, n: int, least: int, share: int):
    """Some keys, chosen by their hash, with their counts."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c = np.unique(_keys(model, n, as_bytes(batch.column(0)), least), return_counts=True)
            some = mix(k) % np.uint64(share) == 0
            yield pa.RecordBatch.from_arrays([pa.array([k[some].tobytes()], pa.binary()), pa.array([c[some].astype(np.uint64).tobytes()], pa.binary())], ["keys", "counts"])

    return emit


def _bounds(keys: np.ndarray, counts: np.ndarray, shards: int, lists: int, words: int) -> np.ndarray:
    """First keys of shards that get about as many list entries each: a key that the sample has more than once is taken to be
    in nearly every task's list, any other in one.  A shard begins with a context."""
    weight = np.cumsum(np.where(counts > 1, lists, 1))
    at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards) if len(keys) else np.empty(0, np.int64)
    return np.unique(np.concatenate((np.zeros(1, np.uint64), keys[at] - keys[at] % np.uint64(max(1, words)))))


def _build(model: Model, n: int, bounds: np.ndarray, least: int, discount: float):
    """Merges a shard's lists, writes its file, and returns its contexts' kept mass and successors."""

    @tidy
    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lists = [np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        k, c = _add(lists, [_unplanes(x, np.uint64) for x in table.column("counts").to_pylist()])
        if n > 1:
            kept = c >= least
            k, c = k[kept], c[kept]
        values = k - bounds[shard]
        width = int(c.max()).bit_length() if len(c) else 1
        arrays = {"count": pack_bits(c, width), "width": np.array([width], np.int64)}
        parents, mass, children = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        if n > 1 and len(k):
            context = (k // np.uint64(model.words)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], np.diff(context) != 0)))
            parents = context[first]
            children = np.diff(np.concatenate((first, [len(k)])))
            # Words of a context begin after the last of the context before it, so values rise and stay small.
            words = k % np.uint64(model.words)
            last = words[first + children - 1] + np.uint64(1)
            values = words + np.repeat(np.cumsum(last) - last, children)
            total = model.counts(n - 1, parents)
            p = restore(quantise((c - discount) / np.repeat(total, children)))
            arrays |= {"prob": quantise(p), "seen": _seen(values)}
            mass = np.add.reduceat(p, first)
        arrays |= {f"key_{name}": a for name, a in encode(values).items()}
        name = write_arrays(model.folder, f"level{n}", arrays)
        return pa.table(
            [pa.array([x], t) for x, t in ((shard, pa.int32()), (len(k), pa.int64()), (int(c.sum()), pa.int64()), (name, pa.string()), (parents.tobytes(), pa.binary()), (mass.tobytes(), pa.binary()), (children.tobytes(), pa.binary()))],
            ["shard", "n", "tokens", "name", "parents", "mass", "children"],
        )

    return merge


_BUILT = "shard int, n long, tokens long, name string, parents binary, mass binary, children binary"


def _by_parent(bases: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, m, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p, m, c = np.frombuffer(p, np.int64), np.frombuffer(m), np.frombuffer(c, np.int64)
                shard = np.searchsorted(bases, p, side="right") - 1
                for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(shard)) + 1) if len(p) else []:
                    rows.append((int(shard[part[0]]), p[part].tobytes(), m[part].tobytes(), c[part].tobytes()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "parents", "mass", "children"])

    return emit


def _link(folder: str, n: int, bases: np.ndarray, ends: np.ndarray):
    """Writes the pointers and back-off weights of one shard of level n."""

    @tidy
    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        p, m, c = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("parents", np.int64), ("mass", np.float64), ("children", np.int64)))
        size = int(ends[shard] - bases[shard])
        local = p - bases[shard]
        mass, children = np.bincount(local, m, size), np.bincount(local, c, size).astype(np.int64)
        backoff = np.where(children > 0, np.maximum(quantise(np.maximum(1 - mass, 1e-16)), 1), 0).astype(np.uint16)
        arrays = {"backoff": backoff} | {f"ptr_{k}": a for k, a in encode(np.concatenate(([0], np.cumsum(children)))).items()}
        name = write_arrays(folder, f"above{n}", arrays)
        return pa.table([pa.array([shard], pa.int32()), pa.array([name]), pa.array([int(children.sum())], pa.int64())], ["shard", "name", "children"])

    return merge


def train(docs: DataFrame, order: int = 3, min_count: int = 2, discount: float = 0.5, shard_chars: int = 20_000_000, task_chars: int = 30_000_000, sample_docs: int = 2000, text_col: str = "text", folder: str | None = None) -> Model:
    """Builds the model from the texts of ``docs``; ``task_chars`` is about what one task reads."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    chars, rows = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, int(chars) // shard_chars)
    model = Model(folder, 0, 0, [])
    if not rows:
        return model
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // sample_docs))) == 0).coalesce(8)
    for n in range(1, order + 1):
        if n == 1:
            bounds = np.array([(s << 64) // shards for s in range(shards)], np.uint64)
        else:
            taken = some.mapInArrow(_sample(model, n, min_count, 16), "keys binary, counts binary").collect()
            keys, counts = _add([np.frombuffer(r["keys"], np.uint64) for r in taken], [np.frombuffer(r["counts"], np.uint64) for r in taken])
            bounds = _bounds(keys, counts, shards, max(1, int(chars) // task_chars), model.words)
        counted = texts.mapInArrow(_count(model, n, bounds, min_count), "shard int, keys binary, counts binary")
        built = cut(counted.groupBy("shard").applyInArrow(_build(model, n, bounds, min_count, discount), _BUILT))
        listed = sorted((r for r in built.select("shard", "n", "tokens", "name").collect() if r["n"]), key=lambda r: r["shard"])
        if not listed:
            break
        sizes = np.array([r["n"] for r in listed], np.int64)
        bases = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        level = Level(bounds[[r["shard"] for r in listed]], bases, [r["name"] for r in listed])
        if n == 1:
            model = Model(folder, sum(r["tokens"] for r in listed), int(sizes.sum()), [level])
            continue
        below = model.levels[-1]
        ends = np.concatenate((below.bases[1:], [below.bases[-1] + _size(folder, below.names[-1])]))
        linked = {r["shard"]: r for r in built.select("parents", "mass", "children").mapInArrow(_by_parent(below.bases), "shard int, parents binary, mass binary, children binary").groupBy("shard").applyInArrow(_link(folder, n - 1, below.bases, ends), "shard int, name string, children long").collect()}
        below.above = [linked[s]["name"] if s in linked else None for s in range(len(below.names))]
        below.firsts = np.concatenate(([0], np.cumsum([linked[s]["children"] if s in linked else 0 for s in range(len(below.names))])[:-1])).astype(np.int64)
        model = Model(folder, model.tokens, model.words, [*model.levels, level])
    return model


def _size(folder: str, name: str) -> int:
    return int(map_arrays(folder, name)["key_meta"][0])


def _scores(model: Model, texts: list[bytes], least: int):
    """Per text: tokens, known tokens, base score, score."""
    t = _Tokens(model, texts)
    p = (t.count + 1) / (model.tokens + model.words + 1)
    begins = np.concatenate(([0], np.cumsum(t.sizes)[:-1]))
    base = np.add.reduceat(np.log10(p), begins)
    nodes = np.where(t.count >= least, t.node, -1)
    for n in range(2, len(model.levels) + 1):
        # Also where the next word is not known the context's back-off holds.
        last = len(nodes) - n + 1
        i = np.flatnonzero((nodes[:last] >= 0) & (t.text[:last] == t.text[n - 1 :])) if last > 0 else np.empty(0, np.int64)
        word = t.node[i + n - 1]
        known = t.count[i + n - 1] >= least
        node = np.full(len(i), -1, np.int64)
        weight = np.ones(len(i))
        node[known], weight[known] = model.successors(n, nodes[i[known]], word[known])
        own, back = np.unique(nodes[i[~known]], return_inverse=True)
        weight[~known] = model.contexts(n - 1, own)[0][back]
        p[i + n - 1] = model.probabilities(n, node) + weight * p[i + n - 1]
        up = np.full(len(nodes), -1, np.int64)
        up[i] = node
        nodes = up
    score = np.add.reduceat(np.log10(p), begins)
    return t.sizes, np.add.reduceat((t.count > 0).astype(np.int64), begins), base, score


def score(docs: DataFrame, model: Model, min_count: int = 2, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_tokens, n_known, train_tokens, base_score and score."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            found = [_scores(model, texts[a:b], min_count) for a, b in blocks(map(len, texts), _BLOCK_CHARS)]
            cols = [np.concatenate(c) for c in zip(*found)] or [np.empty(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(np.full(len(texts), model.tokens, np.int64)), pa.array(cols[2].astype(float)), pa.array(cols[3].astype(float))],
                [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(emit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double")
