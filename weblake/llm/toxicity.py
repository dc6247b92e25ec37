"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs that stand for letters to one
letter (i, l, 1, ! and | are one), and turns other ASCII characters into spaces.  Lexicon entries are word beginnings
and whole words, each with the logarithm of its odds among toxic documents; exception phrases cover hits inside
them.  The weights found in a text are added, normalised by its length, and mapped to 0..1 by a logistic curve.

Learning uses at most ``max_labelled`` labelled rows (an even share of them by a hash of the id).  What is learned goes to the
tasks with the code, so it is bounded too: at most ``max_entries`` entries, chosen from the 20 times as many that lead by most among
the toxic, and at most as many exceptions of each kind, the most frequent ones.  Scores are of all texts, read whole.

Defined results: a null or empty text scores what a text without hits scores; ties of odds or counts go to the entry that is first
in alphabetical order; an empty table to score gives no rows; labels other than 0 and 1 and rows whose
remainder is held out are not learned from; equal rows count as often as they occur; without labels of both kinds every
score is the share of toxic labels (0 without any); very long texts are read whole, in time that grows with their length;
of the tables' columns only the named ones are read, so others cannot clash.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

# Characters that stand for others.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g",
}
_FOLD = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()} | _DIGITS | _LOOKALIKES | {chr(0xFF41 + i): "abcdefghijklmnopqrstuvwxyz"[i].replace("l", "i") for i in range(26)})


def fold(text: str) -> str:
    """The folded text, with a space at either end."""
    return f" {text.lower().translate(_FOLD)} "


#: Word beginnings of these lengths may be entries, besides whole words.
STEMS = (4, 5, 6)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries, toxic = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(fold(text or "").split())
            found = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}
            entries += found
            toxic += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(toxic, pa.int32())], ["entry", "toxic"])


def _spread(p: float, n: float, P: float, N: float) -> float:
    """How far the counts are from chance (a likelihood ratio, two degrees)."""
    g = 0.0
    for seen, share in ((p, P / (P + N)), (n, N / (P + N))):
        g += seen * math.log(seen / ((p + n) * share)) if seen else 0.0
    return 2 * g


def _lexicon(rows: Iterable, P: int, N: int, least_odds: float, least_spread: float, max_entries: int) -> dict[str, float]:
    """Entries that stand well above chance; of entries that begin one another, the one with the higher odds (the
    longer beginning if equal)."""
    odds = {}
    for entry, p, n in rows:
        o = math.log((p + 0.5) / (P + 1)) - math.log((n + 0.5) / (N + 1))
        if o >= least_odds and _spread(p, n, P, N) >= least_spread:
            odds[entry] = o
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for entry in sorted(odds, key=lambda e: (-round(odds[e], 3), e.endswith(" "), -len(e), e)):
        beginnings = {entry[:k] for k in range(2, len(entry) + 1)}
        if entry in begun or beginnings & kept.keys() or len(kept) >= max_entries:
            continue
        kept[entry] = odds[entry]
        begun |= beginnings
    return kept


@lru_cache(4)
def _automaton(lexicon: tuple, exceptions: tuple):
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon:
        machine.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        machine.add_word(phrase, (len(phrase), None))
    machine.make_automaton()
    return machine


def _hits(folded: str, lexicon: tuple, exceptions: tuple) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of the entries in a folded text that are not inside an exception."""
    hits, covers = [], []
    if lexicon:
        for end, (n, weight) in _automaton(lexicon, exceptions).iter(folded):
            (covers if weight is None else hits).append((end + 1 - n, end + 1, weight))
    if covers and hits:
        covers.sort(key=lambda c: c[0])
        begins, reach = [c[0] for c in covers], list(accumulate((c[1] for c in covers), max))
        # Of the exceptions that begin at or before a hit, does the one that reaches furthest hold it?
        hits = [h for h in hits if not ((i := bisect_right(begins, h[0])) and reach[i - 1] >= h[1])]
    return hits


def weigh(text: str, lexicon: tuple, exceptions: tuple, half: int = 2000) -> tuple[float, int]:
    """The logarithm of 1 + the hits' weight, normalised by length (halved at ``half`` words), and the count of hits."""
    folded = fold(text)
    hits = _hits(folded, lexicon, exceptions)
    if not hits:
        return 0.0, 0
    return math.log1p(sum(h[2] for h in hits) / (1 + len(folded.split()) / half)), len(hits)


def _letter_before(folded: str, at: int) -> int:
    """The place of the last character before ``at`` that is no space, -1 if there is none."""
    while at >= 0 and folded[at] == " ":
        at -= 1
    return at


def _letter_after(folded: str, at: int) -> int:
    while at < len(folded) and folded[at] == " ":
        at += 1
    return at


def _pairs(lexicon: tuple, exceptions: tuple):
    """Each hit's word with the word before or after it, once a document."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, found = fold(text or ""), set()
                for a, b, _ in _hits(folded, lexicon, exceptions):
                    begin, end = folded.rfind(" ", 0, a + 2), folded.find(" ", max(a + 1, b - 1))
                    if (last := _letter_before(folded, begin)) >= 0:
                        found.add(folded[folded.rfind(" ", 0, last) : end + 1])
                    if (first := _letter_after(folded, end)) < len(folded):
                        found.add(folded[begin : folded.find(" ", first) + 1])
                phrases += found
                toxic += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], ["entry", "toxic"])

    return emit


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the ridge keeps separable data finite."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class ToxicityModel:
    """A fitted lexicon: ``lexicon`` (entry, weight) pairs, ``exceptions`` phrases, and the logistic curve; or, where there was
    nothing to tell apart, one score for all (``same``)."""

    def __init__(self, lexicon: tuple, exceptions: tuple, intercept: float, slope: float, same: float | None = None):
        self.lexicon, self.exceptions, self.intercept, self.slope, self.same = lexicon, exceptions, intercept, slope, same

    def score(self, docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The ``keep`` columns with ``score`` and ``n_hits``."""
        lexicon, exceptions, a, b, same = self.lexicon, self.exceptions, self.intercept, self.slope, self.same

        names = [*keep, *([] if text_col in keep else [text_col])]
        place = names.index(text_col)

        @tidy
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [weigh(t or "", lexicon, exceptions) for t in batch.column(place).to_pylist()]
                scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x)))) if same is None else same for x, _ in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([n for _, n in found], pa.int64())], [*keep, "score", "n_hits"])

        rows = docs.select(*names)
        return rows.mapInArrow(emit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]) + ", score double, n_hits long")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_entries: int = 2_000, least_odds: float = 3.0, least_spread: float = 20.0, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Fits the lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1).  The chosen labels are at most
    ``max_labelled`` rows of two numbers, so they are broadcast and only their texts are moved."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = -(-known.count() // max_labelled)
    order = F.xxhash64("doc_id")
    chosen = known.where(F.pmod(order, F.lit(max(1, share))) == 0).orderBy(order, "doc_id", "toxic").limit(max_labelled)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(16))
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    P, N = int(toxic), int(n) - int(toxic)
    if not P or not N:
        return ToxicityModel((), (), 0.0, 0.0, P / n if n else 0.0)
    counts = cut(sample.mapInArrow(_candidates, "entry string, toxic int").groupBy("entry").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where("p >= 3 or n >= 3"))
    strong = counts.where(F.col("p") * N > 4 * F.col("n") * P).orderBy(F.desc(F.col("p") - F.col("n")), "entry").limit(20 * max_entries)
    lexicon = _lexicon(((r["entry"], r["p"], r["n"]) for r in strong.collect()), P, N, least_odds, least_spread, max_entries)
    # Whole words that begin like an entry but are found in harmless documents only become exceptions.
    stems = [e for e in lexicon if not e.endswith(" ")]
    if stems:
        begins = F.substring("entry", 1, 1) == " "
        harmless = counts.where((F.col("p") == 0) & begins & F.col("entry").endswith(" ")).where(F.substring("entry", 1, 5).isin([s[:5] for s in stems])).orderBy(F.desc("n"), "entry").limit(max_entries)
        exceptions = (*(fold(e).rstrip() + " " for e in exceptions), *(r["entry"] for r in harmless.collect() if any(r["entry"].startswith(s) for s in stems)))
    else:
        exceptions = tuple(fold(e).rstrip() + " " for e in exceptions)
    entries, known = tuple(sorted(lexicon.items())), tuple(dict.fromkeys(exceptions))
    pairs = sample.mapInArrow(_pairs(entries, known), "entry string, toxic int").groupBy("entry").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).where("p = 0 and n >= 3")
    harmless = [r["entry"] for r in pairs.orderBy(F.desc("n"), "entry").limit(max_entries).collect()] if entries else []
    model = ToxicityModel(entries, tuple(dict.fromkeys((*known, *harmless))), 0.0, 1.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([weigh(t or "", model.lexicon, model.exceptions)[0] for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "y"])

    points = sample.mapInArrow(features, "x double, y int").groupBy(F.round("x", 2).alias("x"), "y").count().collect()
    x = np.repeat([r["x"] for r in points], [r["count"] for r in points])
    y = np.repeat([float(r["y"]) for r in points], [r["count"] for r in points])
    model.intercept, model.slope = _logistic(x, y)
    return model
