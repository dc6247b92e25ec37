"""Secrets in texts: three fixed patterns, and spans that a linear-chain conditional random field adds.

Tokens are runs of letters, digits and underscores (all characters beyond ASCII count as letters), and single other signs.  The
field tags each as the begin of a secret, inside one, or outside, from its shape (length, kinds of characters and how often they
change, whether it stands close to its neighbours), the neighbouring words and signs, and figures of the whole text.  The best tags
of a text are found by Viterbi's method.  Tokens that lose to "outside" whatever the tags beside them are cut a text into short
chains, which is exact.  They are left out for a block of texts at once and in three steps, since what the first leaves hangs on the
weights that were learned: by their shape and a bound on all other weights, then by the figures of their text, then by all weights.

Learning takes at most about ``max_docs`` documents (an even share by hash) and of these at most ``max_windows`` windows of 40
characters at either side of a fixed pattern's match, and as many around other tokens.  Each window is used as it is and with
another value and name from a few common forms, or with a harmless one, so that forms and names that the patterns do not know are
learned too.  What is learned, some thousand weights, goes to the tasks with the code.

Defined results: a null or empty text has no spans; spans of the field that touch a span of the patterns are left out; positions are
code points, ends exclusive; equal starts are in the order assign, access, hex, crf; rows that share an id are documents of their
own, and equal rows give equal results; very long texts are read whole; an empty table gives no rows, and without documents to
learn from the patterns alone act; other columns are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, tidy

# The patterns, and the least length of what they find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: What a text holds, at the least, that has a match.
_HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}"}
#: The kind of the spans that the field adds.
FOUND = "crf"
_ORDER = {k: i for i, k in enumerate([*KINDS, FOUND])}

# Names of secrets, names of harmless values, and forms of secrets.
CREDENTIALS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "auth", "authorization", "bearer", "credential", "credentials", "private_key", "access_key", "client_secret", "secret_key", "auth_token")
HARMLESS = ("id", "count", "version", "date", "name", "checksum", "commit", "file", "page", "order", "phone", "size")
_HEX, _DIGITS = "0123456789abcdef", "0123456789"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ANY = _UPPER + _LOWER + _DIGITS
FORMS = (("", _HEX, (16, 64), ""), ("", _ANY, (16, 40), ""), ("", _ANY + "+/", (24, 44), "=="), ("AKIA", _UPPER + _DIGITS, (16, 16), ""), ("sk_live_", _ANY, (24, 24), ""), ("ghp_", _ANY, (36, 36), ""), ("", _ANY + "-_", (20, 43), ""), ("eyJ", _ANY + "._-", (30, 60), ""))

BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the patterns' matches that are long enough."""
    out = []
    for kind in kinds:
        pattern, group, least = KINDS[kind]
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


# --- shapes ----------------------------------------------------------------------------------------------------------

_SPACE, _WORD, _SIGN = 0, 1, 2
_KIND = np.array([_SPACE if b in b" \t\n\v\f\r" else _WORD if chr(b).isalnum() and b < 128 or b == 95 or b >= 128 else _SIGN for b in range(256)], np.uint8)
#: Bits: digit, upper case, lower case, beyond ASCII, underscore.
_BITS = np.array([1 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 4 if 97 <= b <= 122 else 8 if b >= 128 else 16 if b == 95 else 0 for b in range(256)], np.uint8)
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 41, 64, 65])
#: Values of a shape's parts, the last changing fastest: signs and kinds of characters, length, changes, digits, closeness.
_MASKS, _LENS, _TURNS, _SHARES, _NEAR = 160, 16, 6, 5, 4
SHAPES = _MASKS * _LENS * _TURNS * _SHARES * _NEAR


def tokenised(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the tokens of a text, in bytes, and the number of each one's shape."""
    buf = np.frombuffer(text, np.uint8)
    kind = _KIND[buf]
    word, sign = kind == _WORD, kind == _SIGN
    before, after = np.concatenate(([False], word[:-1])), np.concatenate((word[1:], [False]))
    begins = np.flatnonzero(sign | (word & ~before[: len(word)]))
    ends = np.flatnonzero(sign | (word & ~after[: len(word)])) + 1
    if not len(begins):
        return begins, ends, begins
    bits = _BITS[buf]
    mask = np.bitwise_or.reduceat(bits, begins)
    # Characters between tokens are spaces and have no bits, so sums from begin to begin are sums within tokens.
    length = ends - begins
    digits = np.add.reduceat((bits == 1).view(np.uint8), begins, dtype=np.int32)
    turn = np.empty(len(buf), np.uint8)
    turn[0] = 0
    turn[1:] = (bits[1:] != bits[:-1]) & (bits[1:] != 0) & (bits[:-1] != 0)
    turn[begins] = 0
    turns = np.add.reduceat(turn, begins, dtype=np.int32)
    signs = sign[begins]
    mask = np.where(signs, 32 + (buf[begins] & 127), mask).astype(np.int32)
    turns = np.where(length >= 8, np.minimum(4, turns * 8 // length), 5)
    shares = digits * 4 // length
    close = np.empty(len(begins) + 1, bool)
    close[0] = close[-1] = False
    close[1:-1] = ends[:-1] == begins[1:]
    near = close[:-1].astype(np.int32) * 2 + close[1:]
    shape = (((mask * _LENS + np.searchsorted(_LENGTHS, length)) * _TURNS + turns) * _SHARES + shares) * _NEAR + near
    return begins, ends, shape


#: Each feature of a shape: its number of values, and how it is found.
_near, _share, _turn = (lambda s: s % _NEAR), (lambda s: s // _NEAR % _SHARES), (lambda s: s // (_NEAR * _SHARES) % _TURNS)
_len, _mask = (lambda s: s // (_NEAR * _SHARES * _TURNS) % _LENS), (lambda s: s // (_NEAR * _SHARES * _TURNS * _LENS))
_SHAPE_FEATURES = (
    (_MASKS, _mask), (_LENS, _len), (_TURNS, _turn), (_SHARES, _share), (_NEAR, _near),
    (_MASKS * _LENS, lambda s: _mask(s) * _LENS + _len(s)), (_MASKS * _TURNS, lambda s: _mask(s) * _TURNS + _turn(s)), (_MASKS * _NEAR, lambda s: _mask(s) * _NEAR + _near(s)),
)
_SHAPE_BASES = np.cumsum([0, *(n for n, _ in _SHAPE_FEATURES)])


def shape_features(shapes: np.ndarray) -> np.ndarray:
    """The numbers of the features of each shape, a column for each kind."""
    return np.stack([base + of(shapes) for base, (_, of) in zip(_SHAPE_BASES, _SHAPE_FEATURES)], axis=1)


#: Features of the whole text, shares of signs and of tokens with digits, and size, with their numbers of values.
_FIGURES = (("signs", 5), ("digits", 5), ("size", 6))


def _figures(bytes_: np.ndarray, tokens: np.ndarray, signs: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The figures of texts with so many bytes, tokens, signs, and tokens with digits."""
    n = np.maximum(1, tokens)
    return np.minimum(4, signs * 8 // n), np.minimum(4, digits * 20 // n), np.minimum(5, np.frexp(bytes_)[1] // 3)


def figures(text: bytes, begins: np.ndarray, shapes: np.ndarray) -> tuple[str, str, str]:
    """The names of a text's figures."""
    found = _figures(*(np.array([n]) for n in (len(text), len(begins), np.count_nonzero(_SIGNS[shapes]), np.count_nonzero(_DIGITAL[shapes]))))
    return tuple(f"{name} {int(x[0])}" for (name, _), x in zip(_FIGURES, found))


def plain(shapes: np.ndarray) -> np.ndarray:
    """Signs, and short words of letters in one case (or a capital in front): nothing that a name or a sign beside them changes."""
    mask, turns = _mask(shapes), _turn(shapes)
    one_case = (mask & 6 != 6) | (turns < 2) | (turns == 5)
    return (mask >= 32) | ((mask & 17 == 0) & one_case & (_len(shapes) <= 8))


PLAIN = plain(np.arange(SHAPES))
#: Shapes of signs, and of other tokens with digits.
_SIGNS = _mask(np.arange(SHAPES)) >= 32
_DIGITAL = ~_SIGNS & (_mask(np.arange(SHAPES)) & 1 > 0)
#: So many signs are read before a token.
_BEFORE = 6


def neighbours(text: bytes, begins: np.ndarray, ends: np.ndarray, shapes: np.ndarray, i: int) -> list[str]:
    """Features of what stands around token ``i``: the nearest word before it and the signs between, and the next token."""
    if PLAIN[shapes[i]]:
        return []
    j, signs = i - 1, []
    while j >= 0 and len(signs) < _BEFORE and _mask(shapes[j]) >= 32:
        signs.append(chr(text[begins[j]]))
        j -= 1
    word = _word_before(text[begins[j] : ends[j]]) if j >= 0 and _mask(shapes[j]) < 32 else ""
    after = _token_after(text[begins[i + 1] : ends[i + 1]]) if i + 1 < len(begins) else ""
    name = _name(word)
    return [f"word {word}", f"name {name}", f"between {''.join(reversed(signs))}", f"name {name} {'sign' if signs else 'no sign'}", f"next {after}"]


def _word_before(token: bytes) -> str:
    return token.lower()[:24].decode(errors="replace")


def _token_after(token: bytes) -> str:
    return token.lower()[:12].decode(errors="replace")


def _name(word: str) -> str:
    parts = {word, *word.split("_"), "_".join(word.split("_")[-2:])}
    return "credential" if parts & _CREDENTIALS else "other"


_CREDENTIALS = frozenset(CREDENTIALS)
_GROUPS = 5


# --- the field -------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """``names`` numbers the features that are no shapes; ``weights`` (feature, tag); ``moves`` (tag, next tag)."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def table(self) -> np.ndarray:
        """The weights of every shape."""
        return self.weights[shape_features(np.arange(SHAPES))].sum(axis=1)

    def weight(self, name: str) -> np.ndarray:
        return self.weights[at] if (at := self.names.get(name)) is not None else np.zeros(3)

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most that BEGIN and INSIDE can gain over OUTSIDE by a text's figures, by what stands around, and by the moves."""
        gain = lambda w: w[..., :2] - w[..., OUTSIDE:]
        own = sum(gain(self.figure_weights(k)).max(axis=0) for k in range(len(_FIGURES)))
        # A token has one name, with a sign or without.
        around = np.max([gain(self.weight(f"name {n}") + self.weight(f"name {n} {s}")) for n in ("credential", "other") for s in ("sign", "no sign")], axis=0)
        for kind in ("word ", "between ", "next "):
            ids = [i for name, i in self.names.items() if name.startswith(kind)]
            around = around + np.maximum(0, gain(self.weights[ids]).max(axis=0, initial=0))
        m = self.moves
        move = np.array([max(m[p, y] + m[y, n] - m[p, OUTSIDE] - m[OUTSIDE, n] for p in range(3) for n in range(3)) for y in (BEGIN, INSIDE)])
        return own, around, move

    def figure_weights(self, k: int) -> np.ndarray:
        """The weights of each value of a figure."""
        name, n = _FIGURES[k]
        return np.stack([self.weight(f"{name} {i}") for i in range(n)])

    def possible(self, table: np.ndarray) -> np.ndarray:
        """Which shapes can be tagged at all: those that no bound on everything else keeps outside."""
        own, around, move = self.bounds()
        return _can_gain(table, own + move + np.where(PLAIN[:, None], 0, around))

    def scores(self, text: bytes, begins: np.ndarray, ends: np.ndarray, shapes: np.ndarray, table: np.ndarray, own: np.ndarray, i: int) -> np.ndarray:
        out = table[shapes[i]] + own
        for name in neighbours(text, begins, ends, shapes, i):
            if (at := self.names.get(name)) is not None:
                out = out + self.weights[at]
        return out

    def own(self, names: tuple[str, ...]) -> np.ndarray:
        return sum((self.weights[self.names[n]] for n in names if n in self.names), np.zeros(3))

    def best(self, scores: list[np.ndarray]) -> list[int]:
        """The tags with the greatest sum of a chain with tokens outside at either end."""
        # With three tags plain numbers are quicker than small arrays.
        moves = self.moves.tolist()
        (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = moves
        rows = np.asarray(scores).tolist()
        a, b, c = (m + s for m, s in zip(moves[OUTSIDE], rows[0]))
        back = []
        for s0, s1, s2 in rows[1:]:
            x0, y0, z0, x1, y1, z1, x2, y2, z2 = a + m00, b + m10, c + m20, a + m01, b + m11, c + m21, a + m02, b + m12, c + m22
            f0 = (0 if x0 >= z0 else 2) if x0 >= y0 else (1 if y0 >= z0 else 2)
            f1 = (0 if x1 >= z1 else 2) if x1 >= y1 else (1 if y1 >= z1 else 2)
            f2 = (0 if x2 >= z2 else 2) if x2 >= y2 else (1 if y2 >= z2 else 2)
            a, b, c = (x0, y0, z0)[f0] + s0, (x1, y1, z1)[f1] + s1, (x2, y2, z2)[f2] + s2
            back.append((f0, f1, f2))
        last = (a + m02, b + m12, c + m22)
        tags = [last.index(max(last))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def spans(self, text: bytes, table: np.ndarray, possible: np.ndarray) -> list[tuple[int, int]]:
        """(begin, end) of the secrets of a text, in bytes."""
        return self.block_spans([text], table, possible).get(0, [])

    def block_spans(self, raw: list[bytes], table: np.ndarray, possible: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(begin, end) of the secrets of many texts, in bytes of each, by the numbers of those that have any."""
        text = b"\n".join(raw)
        begins, ends, shapes = tokenised(text)
        at = np.flatnonzero(possible[shapes]) if len(begins) else begins
        if not len(at):
            return {}
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        first = np.append(np.searchsorted(begins, starts), len(begins))
        of = np.searchsorted(first, at, side="right") - 1
        _, around, move = self.bounds()
        # By the figures of their texts.
        sign = _SIGNS[shapes]
        count = lambda x: np.diff(np.append(0, np.cumsum(x))[first])
        own = np.zeros((len(raw), 3))
        for k, values in enumerate(_figures(sizes, np.diff(first), count(sign), count(_DIGITAL[shapes]))):
            own = own + self.figure_weights(k)[values]
        scores = table[shapes[at]] + own[of]
        odd = ~PLAIN[shapes[at]]
        live = _can_gain(scores, move + np.where(odd[:, None], around, 0))
        at, of, scores, odd = at[live], of[live], scores[live], odd[live]
        # By what stands around them.
        if odd.any():
            some = scores[odd]
            weights = np.concatenate((self.weights, np.zeros((1, 3))))
            for ids in self.around(text, begins, ends, sign, first, at[odd], of[odd]).T:
                some = some + weights[ids]
            scores[odd] = some
            live = _can_gain(scores, move)
            at, of, scores = at[live], of[live], scores[live]
        if not len(at):
            return {}
        fresh = np.append(True, (np.diff(at) > 1) | (np.diff(of) > 0))
        heads = np.flatnonzero(fresh)
        lengths = np.diff(np.append(heads, len(at)))
        # Chains of one token all at once.
        tags = ((self.moves[OUTSIDE] + scores) + self.moves[:, OUTSIDE]).argmax(axis=1)
        for a, n in zip(heads[lengths > 1].tolist(), lengths[lengths > 1].tolist()):
            tags[a : a + n] = self.best(scores[a : a + n])
        held = np.flatnonzero(tags != OUTSIDE)
        out: dict[int, list[tuple[int, int]]] = {}
        before = -2
        for i, t, tag, new, a, b in zip(held.tolist(), of[held].tolist(), tags[held].tolist(), fresh[held].tolist(), (begins[at[held]] - starts[of[held]]).tolist(), (ends[at[held]] - starts[of[held]]).tolist()):
            found = out.setdefault(t, [])
            if tag == BEGIN or new or before != i - 1:
                found.append((a, b))
            else:
                found[-1] = (found[-1][0], b)
            before = i
        return out

    def around(self, text: bytes, begins: np.ndarray, ends: np.ndarray, sign: np.ndarray, first: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The numbers of the features that ``neighbours`` gives for tokens ``at`` of the texts ``of`` of a block, one past the last for
        those that were not learned; ``sign`` tells which tokens are signs, and ``first`` which is the first of each text."""
        none, low = len(self.weights), first[of]
        word = np.maximum.accumulate(np.where(sign, -1, np.arange(len(sign))))
        before = np.where(at > low, word[at - 1], -1)
        before = np.where(before >= low, before, -1)
        signs = np.minimum(_BEFORE, at - np.where(before >= 0, before + 1, low))
        before = np.where(at - 1 - before <= _BEFORE, before, -1)
        after = np.where(at + 1 < first[of + 1], at + 1, -1)
        slices = lambda i: (np.where(i >= 0, begins[i], 0).tolist(), np.where(i >= 0, ends[i], 0).tolist())
        get, characters = self.names.get, np.frombuffer(text, np.uint8)[begins].tobytes()
        name = {(n, s): (get(f"name {n}", none), get(f"name {n} {'sign' if s else 'no sign'}", none)) for n in ("credential", "other") for s in (False, True)}
        # A block repeats most of its words and signs.
        words: dict[bytes, tuple[int, str]] = {}
        betweens: dict[bytes, int] = {}
        nexts: dict[bytes, int] = {}
        rows = []
        for i, n, a, b, c, d in zip(at.tolist(), signs.tolist(), *slices(before), *slices(after)):
            w, s, x = text[a:b], characters[i - n : i], text[c:d]
            if (found := words.get(w)) is None:
                words[w] = found = (get(f"word {(read := _word_before(w))}", none), _name(read))
            if (between := betweens.get(s)) is None:
                betweens[s] = between = get(f"between {s.decode()}", none)
            if (follows := nexts.get(x)) is None:
                nexts[x] = follows = get(f"next {_token_after(x)}", none)
            named, signed = name[found[1], n > 0]
            rows.append((found[0], named, between, signed, follows))
        return np.array(rows)


def _can_gain(scores: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which tokens may be tagged, if all else gains ``most`` over OUTSIDE; a bit is left for the order of sums."""
    return (scores[:, :2] - scores[:, OUTSIDE:] + most >= -1e-6).any(axis=1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _likelihood(scores: np.ndarray, moves: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the sums over all taggings of padded chains, the chances of each tag, and the expected moves."""
    n, steps, _ = scores.shape
    ahead, behind = np.empty_like(scores), np.empty_like(scores)
    ahead[:, 0] = moves[OUTSIDE] + scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
    final = np.broadcast_to(moves[:, OUTSIDE], (n, 3))
    behind[:, -1] = final
    for t in range(steps - 2, -1, -1):
        inner = _log_sum(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where((t + 1 < length)[:, None], inner, final)
    total = _log_sum(ahead[np.arange(n), length - 1] + final, 1)
    there = (np.arange(steps) < length[:, None])[..., None]
    tags = np.where(there, np.exp(np.where(there, ahead + behind - total[:, None, None], -np.inf)), 0)
    expected = np.zeros((3, 3))
    for t in range(1, steps):
        live = t < length
        if live.any():
            expected += np.exp(ahead[live, t - 1, :, None] + moves + (scores[live, t] + behind[live, t])[:, None, :] - total[live, None, None]).sum(axis=0)
    expected[OUTSIDE] += tags[:, 0].sum(axis=0)
    expected[:, OUTSIDE] += tags[np.arange(n), length - 1].sum(axis=0)
    return total, tags, expected


def learn(examples: list[tuple[bytes, tuple[str, ...], tuple[int, int] | None]], steps: int = 100, rate: float = 0.15, ridge: float = 0.01) -> Field:
    """The field of the greatest likelihood, less a ridge, for texts with the figures of their documents and the bytes of the
    secret in each; by Adam's method from zero, so equal examples give equal weights."""
    names: dict[str, int] = {}
    base, chains = int(_SHAPE_BASES[-1]), []
    for text, own, secret in examples:
        begins, ends, shapes = tokenised(text)
        if not len(begins):
            continue
        rows = []
        for i in range(len(begins)):
            found = [*own, *neighbours(text, begins, ends, shapes, i)]
            rows.append([names.setdefault(f, base + len(names)) for f in found])
        tags = [OUTSIDE if secret is None or not secret[0] <= a < secret[1] else BEGIN if a == secret[0] else INSIDE for a in begins.tolist()]
        chains.append((shape_features(shapes), rows, tags))
    if not chains:
        # Nothing is known of secrets: all is outside.
        return Field({}, np.zeros((base, 3)), np.eye(3)[[OUTSIDE] * 3])
    size, width = max(len(c[2]) for c in chains), len(_SHAPE_FEATURES) + 3 + _GROUPS
    none = base + len(names)
    ids = np.full((len(chains), size, width), none)
    gold, length = np.full((len(chains), size), OUTSIDE), np.array([len(c[2]) for c in chains])
    for k, (shapes, rows, tags) in enumerate(chains):
        ids[k, : len(tags), : shapes.shape[1]] = shapes
        for t, r in enumerate(rows):
            ids[k, t, shapes.shape[1] : shapes.shape[1] + len(r)] = r
        gold[k, : len(tags)] = tags
    there = np.arange(size) < length[:, None]
    right = np.eye(3)[gold] * there[..., None]
    right_moves = np.zeros((3, 3))
    np.add.at(right_moves, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
    np.add.at(right_moves[OUTSIDE], gold[:, 0], 1)
    np.add.at(right_moves[:, OUTSIDE], gold[np.arange(len(gold)), length - 1], 1)
    weights, moves, flat = np.zeros((none + 1, 3)), np.zeros((3, 3)), ids[there]
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        scores = np.zeros((*gold.shape, 3))
        scores[there] = weights[flat].sum(axis=1)
        _, tags, expected = _likelihood(scores, moves, length)
        lack = (right - tags)[there]
        gradient = np.stack([np.bincount(flat.ravel(), np.repeat(lack[:, y], width), none + 1) for y in range(3)], axis=1)
        for k, (w, g) in enumerate(((weights, gradient), (moves, right_moves - expected))):
            g = g / len(chains) - ridge / len(chains) * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        weights[none] = 0
    return Field(names, weights[:none], moves)


# --- examples --------------------------------------------------------------------------------------------------------


def _windows(around: int, each: int):
    """(own figures, left, name, between, value, right): the patterns' matches, and as many other places without a name."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                raw = (text or "").encode()
                begins, ends, shapes = tokenised(raw)
                if not len(begins):
                    continue
                own = " | ".join(figures(raw, begins, shapes))
                hits = base_spans(text)
                for kind, a, b in hits[:each]:
                    m = KINDS[kind][0].match(text, a)
                    value = m.start(2) if kind == "assign" else a
                    name_end = m.end(1) if kind == "assign" else a
                    rows.append((own, text[max(0, a - around) : a], text[a:name_end], text[name_end:value], text[value:b], text[b : b + around]))
                # Places of tokens with digits or of long ones first: those that are most like secrets.
                odd = np.flatnonzero(~PLAIN[shapes])
                for i in [*odd[:: max(1, len(odd) // each)][:each].tolist(), len(begins) // 2]:
                    a = len(raw[: begins[i]].decode())
                    b = a + len(raw[begins[i] : ends[i]].decode(errors="replace"))
                    if not any(s[1] < b + around and a - around < s[2] for s in hits):
                        rows.append((own, text[max(0, a - around) : a], None, None, text[a:b], text[b : b + around]))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], _WINDOW)

    return emit


_WINDOW = ["own", "left", "name", "between", "value", "right"]


def _variants(windows: list, seed: int) -> list[tuple[bytes, tuple[str, ...], tuple[int, int] | None]]:
    rng, out = random.Random(seed), []
    names, quotes = CREDENTIALS, ("", '"', "'")
    between = ("=", ":", " = ", ": ", " : ", " ")

    def add(w, name: str, sep: str, value: str, secret: bool) -> None:
        left = f"{w['left']}{name}{sep}".encode()
        raw = value.encode()
        out.append((left + raw + w["right"].encode(), tuple(w["own"].split(" | ")), (len(left), len(left) + len(raw)) if secret else None))

    def made() -> str:
        front, letters, (low, high), end = rng.choice(FORMS)
        return front + "".join(rng.choices(letters, k=rng.randint(low, high))) + (end if rng.random() < 0.5 else "")

    def harmless(w) -> str:
        words = (w["left"] + " " + w["right"]).split() or ["word"]
        number = "".join(rng.choices(_DIGITS, k=rng.randint(1, 16)))
        return rng.choice((rng.choice(words), rng.choice(words), number, number, "none", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}"))

    def sep() -> str:
        return rng.choice(between) + rng.choice(quotes)

    for w in windows:
        if base_spans(w["left"]) or base_spans(w["right"]):
            continue  # another secret in the window would count as harmless
        spaced = "" if not w["left"] or w["left"][-1].isspace() else " "
        cred = rng.choice((str.lower, str.upper, str.title))(rng.choice(names))
        if w["name"] is not None:
            add(w, w["name"], w["between"], w["value"], True)
            add(w, w["name"] or spaced + cred, w["between"] or sep(), made(), True)
            add(w, w["name"] or spaced + cred, w["between"] or sep(), harmless(w), False)
        else:
            add(w, "", "", w["value"], False)
            add(w, spaced + cred, sep(), made(), True)
            add(w, spaced + cred, sep(), harmless(w), False)
            # A random value under a harmless name is none, unless its form tells.
            value = made()
            add(w, spaced + rng.choice(HARMLESS), sep(), value, value.startswith(("AKIA", "sk_live_", "ghp_", "eyJ")))
    return out


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 20_000, max_windows: int = 400, around: int = 40, seed: int = 7, steps: int = 100) -> Field:
    """Learns from the texts alone; see the module for the bounds."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    share = max(1, -(-texts.count() // max_docs))
    own = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    windows = cut(own.mapInArrow(_windows(around, 3), ", ".join(f"{c} string" for c in _WINDOW)).distinct())
    chosen = []
    for some in (F.col("name").isNotNull(), F.col("name").isNull()):
        chosen += windows.where(some).orderBy(F.xxhash64(*_WINDOW), *_WINDOW).limit(max_windows).collect()
    return learn(_variants(chosen, seed), steps)


def find(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``spans``, array of (kind, begin, end), in order, and ``redacted``: the text with a kind in place of
    each secret."""
    names = [*keep, *([] if text_col in keep else [text_col])]
    place = names.index(text_col)

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = field.table()
        possible = field.possible(table)
        for batch in batches:
            column = batch.column(place)
            texts = column.to_pylist()
            raw = [(t or "").encode() for t in texts]
            hinted = {k: pc.fill_null(pc.match_substring_regex(column, h), False).to_pylist() for k, h in _HINTS.items()}
            spans = [base_spans(t, kinds) if t and (kinds := tuple(k for k in KINDS if hinted[k][i])) else [] for i, t in enumerate(texts)]
            for a, b in blocks(map(len, raw)):
                for i, found in field.block_spans(raw[a:b], table, possible).items():
                    spans[a + i] = _added(texts[a + i], raw[a + i], found, spans[a + i])
            kept = [_redact(t, s) if s else t for t, s in zip(texts, spans)]
            found = pa.array([[{"kind": k, "begin": x, "end": y} for k, x, y in s] for s in spans], pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found, pa.array(kept, pa.string())], [*keep, "spans", "redacted"])

    rows = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(emit, f"{kinds}, spans array<struct<kind:string,begin:bigint,end:bigint>>, redacted string")


def _added(text: str, raw: bytes, found: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """A text's spans with the field's, in code points, but those that touch one of the patterns."""
    places = np.array(found)
    if len(text) != len(raw):
        points = np.cumsum(np.append(0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
        # The begin of a character is the number of those that begin before it.
        places = points[places]
    begins, furthest = [s[1] for s in spans], list(accumulate((s[2] for s in spans), max))
    more = [(FOUND, a, b) for a, b in places.tolist() if not (n := bisect_left(begins, b)) or furthest[n - 1] <= a]
    return sorted([*spans, *more], key=lambda s: (s[1], _ORDER[s[0]]))


def _redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if b > at:
            out += [text[at : max(at, a)], f"[{kind}]" if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def described(spans: F.Column, *kinds: str) -> F.Column:
    """``kind:begin:end`` of the spans of these kinds (all, if none is named), comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
