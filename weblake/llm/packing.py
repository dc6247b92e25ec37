"""Packing token sequences by the length histogram: shortest-pack-first.

Documents are tokenised, cut into pieces of at most ``piece`` tokens, and only the histogram of piece lengths (at most
``size`` entries) comes to the driver.  There lengths are placed longest first, each into the open packs with the most
room (the shortest packs), a whole count of equal packs at a time; the result is a list of patterns with counts.
Patterns go back to the pieces by rank: the r-th piece of a length takes the r-th slot of that length.

Ranks do not gather a frequent length in one task: pieces are dealt to buckets of a hash, buckets are counted, the
counts are summed in order in two steps, and ranks are taken inside a bucket.

Defined results: a null or empty text is the single end id; rows that share an id are cut apart and packed like other
rows; equal rows are interchangeable; very long texts are tokenised whole and cut into pieces; of the table's columns only the
id and the text are read, so others cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ahead, as_bytes, blocks, cut, keep_cache

END = 2
_MOST_WORDS = 1_000_000
_BLOCK_CHARS = 8 << 20
#: Plain words that are encoded as one text.
_TOGETHER = 200
_encoders: dict = {}
keep_cache("packing", _encoders.clear)


#: A word of these letters is not changed by normalisation nor cut before merging; a run of signs after it is apart from it.  An
#: apostrophe is no such sign: it may belong to letters.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class _Encoder(dict):
    """Word -> its ids as little-endian 32-bit integers, for a tokenizer that lower-cases, drops white space and never joins
    across it: a text's ids are those of its words, one after the other.  Any other tokenizer gets whole texts."""

    def __init__(self, path: str):
        # A task has one core: threads of the library's own only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cutters = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cutters] == ["Split", "ByteLevel"] and cutters[0]["invert"] and "[\\p{L}]+" in cutters[0]["pattern"]["Regex"]
        if self.by_words:
            last = rules["model"].get("end_of_word_suffix") or "\0"
            rules |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, cutters[1]]}}
            self.merges_only = Tokenizer.from_str(json.dumps(rules))
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(last)]] = True

    def _encode(self, plain: list[str], other: list[str]) -> None:
        parts = [plain[a : a + _TOGETHER] for a in range(0, len(plain), _TOGETHER)]
        for part, e in zip(parts, self.merges_only.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(part):
                # Words of which the vocabulary has no last token.
                other = other + part
                continue
            data = ids.tobytes()
            self.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts))))
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self[w] = array("I", e.ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Takes up words.  A plain word with signs after it is the word's ids and the signs'."""
        plain, other, signed = set(), set(), []
        for w, found in zip(new, map(_PLAIN.fullmatch, new)):
            if found is None:
                other.add(w)
                continue
            core, signs = found.groups()
            if core not in self:
                plain.add(core)
            if signs:
                signed.append((w, core, signs))
                if signs not in self:
                    other.add(signs)
        self._encode(list(plain), list(other))
        for w, core, signs in signed:
            self[w] = self[core] + self[signs]

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_words:
            for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
                yield array("I", e.ids).tobytes()
            return
        if len(self) > _MOST_WORDS:
            self.clear()
        self[""] = b""  # what is before a text's first white space, and after its last
        column = pa.array(texts, pa.string())
        # A-Z are lower-cased by the tokenizer in any case; only its special tokens tell them apart.
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column)))
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.get, own))
        gaps = [i for i, x in enumerate(ids) if x is None]
        self._learn([own[i] for i in gaps])
        for i in gaps:
            ids[i] = self[own[i]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(b"".join(ids), "<u4"))
        data = lists.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))[np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))]
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            yield data[a:b].tobytes()


def _pieces(path: str, piece: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = as_bytes(batch.column(1), "packing")
            for a, b in blocks(map(len, texts), _BLOCK_CHARS):
                for i, ids in enumerate(encoder.texts(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    rows += ((i, s, min(piece, n - s), zlib.crc32(ids[4 * s : 4 * (s + piece)]), n) for s in range(0, n, piece))
            row, *rest = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return emit


def patterns(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths, count) packs that hold all of the histogram, none above ``size``."""
    open_: list[tuple[int, int, list[int], int]] = []  # (-room, number, lengths, count): the most room on top
    number = 0
    for length in sorted(histogram, reverse=True):
        left, changed = histogram[length], []
        while left and open_ and -open_[0][0] >= length:
            room, _, lengths, count = heapq.heappop(open_)
            take = min(left, count)
            left -= take
            number += 2
            changed.append((room + length, number, [*lengths, length], take))
            if take < count:
                heapq.heappush(open_, (room, number + 1, lengths, count - take))
            if not left or not open_ or -open_[0][0] < length:
                # Packs that took one may take more of the same length.
                for c in changed:
                    heapq.heappush(open_, c)
                changed = []
        for c in changed:
            heapq.heappush(open_, c)
        if left:
            each = size // length
            for per, packs in ((each, left // each), (left % each, 1)):
                if per and packs:
                    number += 2
                    heapq.heappush(open_, (per * length - size, number, [length] * per, packs))
    return [(lengths, count) for _, _, lengths, count in sorted(open_, key=lambda p: p[1])]


def slots(packs: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each place in a pattern: its length, the first rank it takes, the first sequence, and the offset there."""
    lengths, begins, sequences, offsets = [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, count in packs:
        offset = 0
        for length in pattern:
            lengths.append(length)
            begins.append(used.get(length, 0))
            sequences.append(sequence)
            offsets.append(offset)
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    order = np.lexsort((begins, lengths))
    return {k: np.array(v, np.int64)[order] for k, v in {"length": lengths, "begin": begins, "sequence": sequences, "offset": offsets}.items()}


def _placed(table: dict[str, np.ndarray]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1 << 48)
        keys = table["length"] * shift + table["begin"]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["begin"][at]
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(table["offset"][at]))

    return emit


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, piece: int | None = None, bucket_pieces: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.  ``tokenizer`` is the path
    of a vocabulary file that every executor has."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cutting = cut(rows.mapInArrow(_pieces(tokenizer, min(piece or size, size)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    histogram = {r["length"]: r["count"] for r in cutting.groupBy("length").count().collect()}
    buckets = max(1, sum(histogram.values()) // bucket_pieces)
    dealt = cutting.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    begins = ahead(counts, ["length"], "bucket", "count").select("length", "bucket", "ahead")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(inside) - 1).join(begins, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(_placed(slots(patterns(histogram, size))), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
