"""The language model against a dictionary model written from its definition."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from weblake.llm import lm
from weblake.llm.elias_fano import EliasFano, encode


def rounded(p: float) -> float:
    return float(lm.restore(lm.quantise(np.array([p])))[0])


def brute(train: list[str], texts: list[str], order=3, least=2, discount=0.5):
    def tokens(t):
        return (t or "").encode().lower().split() + [None]

    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        x = tokens(t)
        for n in range(1, order + 1):
            grams[n].update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    N, V = sum(grams[1].values()), len(grams[1])
    kept = [None, grams[1]] + [{g: c for g, c in grams[n].items() if c >= least} for n in range(2, order + 1)]
    mass = Counter()
    for n in range(2, order + 1):
        for g, c in kept[n].items():
            mass[g[:-1]] += rounded((c - discount) / grams[n - 1][g[:-1]])
    out = []
    for t in texts:
        x = tokens(t)
        base = score = 0.0
        for i, w in enumerate(x):
            p = (grams[1][(w,)] + 1) / (N + V + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                h = tuple(x[i - n + 1 : i]) if i >= n - 1 else None
                if h is not None and mass[h]:
                    c = kept[n].get((*h, w), 0)
                    p = (rounded((c - discount) / grams[n - 1][h]) if c else 0) + rounded(1 - mass[h]) * p
            score += math.log10(p)
        out.append((len(x), sum(grams[1][(w,)] > 0 for w in x), N, base, score))
    return out


def test_model_equals_brute_force(spark):
    words = [f"w{int(i * i % 23)}" for i in range(400)]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 60, 60)] + ["", None, "A b A b a B", "ünï  cödé\t\x0b x", "x " * 3000, "new words only"]
    train = texts[:50] + texts[-5:-1]
    frame = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    model = lm.train(frame, shard_chars=500)
    assert len(model.levels) == 3 and len(model.levels[1].names) > 2
    rows = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, want in enumerate(brute(train, texts)):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-9)
        assert r["score"] == pytest.approx(want[4], abs=1e-6 * want[0] + 1e-6)


def test_without_training_texts(spark):
    model = lm.train(spark.createDataFrame([], "doc_id long, text string"))
    r = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0.0, 0.0)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (700, 900), (5000, 2**63), (4000, 2**30)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    sequence = EliasFano(encode(values))
    at = np.arange(len(values))
    assert (sequence.get(at) == values).all() and (sequence.find(values) == at).all()
    if len(values) > 1:
        first, second = sequence.span(at[:-1])
        assert (first == values[:-1]).all() and (second == values[1:]).all()
    others = rng.integers(0, top, 500, dtype=np.uint64)
    assert ((sequence.find(others) >= 0) == np.isin(others, values)).all()


def test_pointers_steer_the_search(spark):
    """With the pointers of other contexts, scores change."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 30, 80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(docs, shard_chars=4000)
    before = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}
    whole = lm.Model.contexts

    def shifted(self, n, nodes):
        weight, begin, end = whole(self, n, nodes)
        return weight, np.roll(begin, 1), np.roll(end, 1)

    lm.Model.contexts = shifted
    try:
        found = [lm._scores(model, [t.encode()], 2)[3][0] for t in texts]
    finally:
        lm.Model.contexts = whole
    assert sum(abs(found[i] - before[i]) > 1e-9 for i in before) > 50
    assert all(abs(lm._scores(model, [t.encode()], 2)[3][0] - before[i]) < 1e-9 for i, t in enumerate(texts))


def test_pairs_that_do_not_fit_are_an_error():
    model = lm.Model("", 1, 2**40, [])
    with pytest.raises(OverflowError):
        model.pairs(np.array([2**30]), np.array([1]))


def test_search_between_indexes():
    values = np.array([3, 5, 9, 12, 40, 41, 90], np.uint64)
    found = EliasFano(encode(values)).find(np.array([9, 9, 41, 41, 3], np.uint64), np.array([0, 3, 4, 0, 0]), np.array([7, 7, 6, 5, 1]))
    assert found.tolist() == [2, -1, 5, -1, 0]


def test_pairs_are_sorted_once(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a{i % 50} b{i % 7} c{i % 3} a{i % 50} c{i % 2}",) for i in range(400)], "text string")
    model = lm.train(docs, shard_chars=500)
    assert len(model.levels[1].names) > 3
    context, word = (x.ravel() for x in np.meshgrid(np.arange(model.words), np.arange(model.words)))
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    node, weight = model.successors(2, context, word)
    assert len(calls) == 1 and (node >= 0).any() and (node < 0).any()
    one = [model.successors(2, context[i : i + 1], word[i : i + 1]) for i in range(0, len(context), 37)]
    assert node[::37].tolist() == [int(n[0]) for n, _ in one] and weight[::37].tolist() == [float(w[0]) for _, w in one]


@pytest.mark.parametrize("words", [[2**64 - 1] * 16, [0] * 15 + [1 << 63], [2**64 - 1] * 7 + [1] + [0] * 7 + [2**64 - 1], [0x8000000000000001] * 16])
def test_places_of_bits(words):
    high = np.array(words, np.uint64)
    bits = np.unpackbits(high.view(np.uint8), bitorder="little")
    ones = np.concatenate(([0], np.cumsum(bits.reshape(-1, 512).sum(axis=1))))
    found = EliasFano({"low": np.zeros(1, np.uint64), "high": high, "ones": ones.astype(np.int64), "meta": np.array([int(bits.sum()), 0, 0], np.int64)})
    for bit in (0, 1):
        want = np.flatnonzero(bits == bit)
        assert found._select(np.arange(len(want)), bit).tolist() == want.tolist()
