"""Which files can hold the tokens of a search: a filter of tokens for each file, written with the file.

A filter is a Bloom filter of three bits a token, cut into pages of 32,768 bits; a token's page and bits follow from its hash, so a
search reads one page of each file and token.  Pages are rows, sorted by their key, and Parquet reads only those that a search asks
for.  A filter has at least 16 bits a token, so a file without a token is read for about one search in a thousand; a file with very many
tokens has several filters.  What a filter lets through is searched as ever, so results do not depend on it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .search import SearchRequest

#: What searches look for tokens in; an address is a token of its own.
COLUMNS = ("raw", "path", "user_agent", "referer", "ip")
PAGE_BITS, BITS, MOST_PAGES = 32_768, 16, 512
#: A filter of more tokens than this is closed, and another one begun.
MOST_TOKENS = MOST_PAGES * PAGE_BITS // BITS
#: The lowest bits of a hash choose the page, these shifts the bits in it.
_SHIFTS = (16, 31, 46)
_KEY = MOST_PAGES * 2


def _hashes(rows: DataFrame) -> Column:
    """The hashes of a row's tokens.  A column that ``raw`` holds as a word or in quotes has no others."""
    own = [c for c in COLUMNS if c in rows.columns]
    parts = []
    for c in own:
        found = text.tokens(F.col(c))
        if c != "raw" and "raw" in own:
            spaced = F.concat(F.lit(" "), F.col("raw"), F.lit(" "))
            held = spaced.contains(F.concat(F.lit(" "), F.col(c), F.lit(" "))) | spaced.contains(F.concat(F.lit('"'), F.col(c), F.lit('"')))
            found = F.when(~F.coalesce(held, F.lit(False)), found)
        parts.append(F.coalesce(found, F.array().cast("array<string>")))
    return F.transform(F.flatten(F.array(*parts)), lambda t: F.xxhash64(t)) if parts else F.array().cast("array<bigint>")


def _pages(file: str, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    pages = 1
    while pages < MOST_PAGES and pages * PAGE_BITS < len(hashes) * BITS:
        pages *= 2
    unsigned = hashes.astype(np.uint64)
    page = (unsigned & np.uint64(pages - 1)).astype(np.int64)
    bits = np.zeros(pages * PAGE_BITS, bool)
    for shift in _SHIFTS:
        bits[page * PAGE_BITS + ((unsigned >> np.uint64(shift)) & np.uint64(PAGE_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").reshape(pages, PAGE_BITS // 8)
    keys = pages * _KEY + np.arange(pages)
    yield pa.RecordBatch.from_arrays([pa.array([file] * pages), pa.array(keys.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary())], ["file", "key", "bits"])


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        lists = batch.column(1)
        files = batch.column(0).dictionary_encode()
        edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        codes = files.indices.to_numpy()
        begins = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(begins, begins[1:]):
            if a == b:
                continue
            file = files.dictionary[int(codes[a])].as_py()
            held.setdefault(file, []).append(np.unique(flat[edges[a] : edges[b]]))
            sizes[file] = sizes.get(file, 0) + len(held[file][-1])
            if sizes[file] > MOST_TOKENS:
                held[file] = [np.unique(np.concatenate(held[file]))]
                sizes[file] = len(held[file][0])
                if sizes[file] > MOST_TOKENS // 2:
                    yield from _pages(file, held.pop(file)[0])
                    sizes.pop(file)
    for file, parts in held.items():
        yield from _pages(file, np.unique(np.concatenate(parts)))


def write(rows: DataFrame, folder: str) -> None:
    """The filters of the files that ``rows`` (with their ``_file``) lie in."""
    pages = rows.select("_file", _hashes(rows).alias("hashes")).mapInArrow(_filters, "file string, key int, bits binary")
    pages.sortWithinPartitions("key").write.parquet(folder)


#: A filter of a request: any of these sets of tokens has to be in a file whole.
Need = list[frozenset[str]]


def needed(request: SearchRequest) -> list[Need]:
    """What a file needs to hold a match: for each filter one of its sets of tokens."""
    out: list[Need] = []
    if request.query:
        out.append([frozenset([t]) for t in text.literal_tokens(request.query)])
    out += [[frozenset(text.literal_tokens(p)) for p in phrases if text.literal_tokens(p)] for phrases in request.phrases.values() if phrases]
    if request.exact.get("ip"):
        out.append([frozenset(text.literal_tokens(ip)) for ip in request.exact["ip"]])
    return out


def _holds(h: int) -> Column:
    """Whether a page is one of a hash's and has its bits."""
    keys, n = [], 1
    while n <= MOST_PAGES:
        keys.append(n * _KEY + (h & (n - 1)))
        n *= 2
    bits = []
    for shift in _SHIFTS:
        at = (h >> shift) & (PAGE_BITS - 1)
        byte = F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("int")
        bits.append(F.getbit(byte, F.lit(at % 8)) == 1)
    return F.col("key").isin(keys) & reduce(Column.__and__, bits)


def able(spark: SparkSession, folder: str, files: DataFrame, needs: list[Need]) -> DataFrame:
    """The rows of ``files`` (manifest rows) whose filters hold what is needed."""
    tokens = sorted({t for need in needs for alternative in need for t in alternative})
    if not needs:
        return files
    if not all(needs):
        return files.limit(0)
    if not tokens:  # an address without a token matches as text only
        return files
    changes = [r["change"] for r in files.select("change").distinct().collect()]
    if not changes:
        return files
    hashes = {r["t"]: r["h"] % 2**64 for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    keys = sorted({n * _KEY + (h & (n - 1)) for h in hashes.values() for n in (2**i for i in range(MOST_PAGES.bit_length()))})
    pages = spark.read.schema("file string, key int, bits binary").parquet(*(f"{folder}/{c}" for c in sorted(changes))).where(F.col("key").isin(keys))
    seen = pages.groupBy("file").agg(*(F.bool_or(_holds(hashes[t])).alias(f"t{i}") for i, t in enumerate(tokens)))
    has = {t: F.coalesce(F.col(f"t{i}"), F.lit(False)) for i, t in enumerate(tokens)}
    every = lambda group: reduce(Column.__and__, (has[t] for t in sorted(group)), F.lit(True))
    wanted = reduce(Column.__and__, (reduce(Column.__or__, map(every, need)) for need in needs))
    return files.join(seen.where(wanted).select("file"), "file", "left_semi")
