"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from weblake.llm import imi, langid, line_dedup, mixing, ngram_join, packing, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as a table's own.
NAMES = ("row", "hash", "cls", "sig", "bucket", "size", "id", "doc", "_text", "drop", "n", "part", "key", "v", "_doc", "_drop", "_row", "_key", "first", "often", "digest", "passes", "ahead", "_group", "block", "order", "frame")


def clash(frame):
    return frame.withColumns({c: F.lit(1) for c in NAMES if c not in frame.columns})




def messy(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ép") for b in ("ta", "No", "ri", "zu.", "mi,")]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), "  Shared  boilerplate LINE of all the sites \t" if i % 8 else "shared  boilerplate line of all the sites")
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}" if i % 7 else None, 0))
    rows += [(100, rows[3][1], "en", "s1", 0), (101, None, None, None, None), (102, "", "en", "s1", 0), (103, " \n\t\n", "en", "s2", 0), (104, "one", "en", "s0", 0), (105, "ONE", "en", "s0", 0), rows[5], (106, " ".join(rng.choices(words, k=4000)), "en", "s0", 0)]
    rows += [(None, "no id at all here", "en", "s0", 0), (107, "\x0b\x1c a\x85b \xa0", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), DOCS).transform(clash).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---------------------------------------------------------------------------------------------------------------


def components_of(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0] if r[0] is not None else -1), len(sets[i]), low.get(find(i), r[0]) if low.get(find(i)) is not None else -1) for i, r in enumerate(rows))


def near_copies(seed, groups, size, n):
    rng = random.Random(seed)
    rows = messy(seed)
    for g in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        for c in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                words[rng.randrange(n)] = f"x{rng.randint(0, 99)}"
            rows.append((1000 + g * 500 + c, " ".join(words), "en", "s", 0))
    return rows


@pytest.mark.parametrize("seed,groups,size,n,k,percent", [(1, 3, 12, 60, 4, 85), (2, 1, 90, 45, 4, 85), (3, 6, 8, 300, 5, 80), (4, 8, 6, 9, 4, 85), (5, 1, 60, 120, 3, 70)])
def test_join_equals_all_pairs(spark, seed, groups, size, n, k, percent):
    rows = near_copies(seed, groups, size, n)
    frame = spark.createDataFrame(rows, DOCS).transform(clash)
    got = sorted((-1 if r["id"] is None else r["id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in ngram_join.join(frame, k, percent, chunk_tokens=2000).collect())
    assert got == components_of(rows, k, percent)


@pytest.mark.parametrize("seed,groups,size,n,k,percent,block", [(2, 1, 90, 45, 4, 85, 16), (3, 6, 8, 300, 5, 80, 256)])
def test_links_equal_all_pairs(spark, seed, groups, size, n, k, percent, block):
    rows = near_copies(seed, groups, size, n)
    rows += [(5000 + i, r[1], *r[2:]) for i, r in enumerate(rows[-5:])]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {shingles(r[1]) for r in rows}
    links = {a: sum(a != b and bool(a & b) and 100 * len(a & b) >= percent * len(a | b) for b in sets) for a in sets}
    assert max(links.values()) > 1
    got = ngram_join.join(spark.createDataFrame(rows, DOCS).transform(clash), k, percent, chunk_tokens=2000, block=block).collect()
    assert Counter((r["id"], r["n_links"]) for r in got) == Counter((r[0], links[shingles(r[1])]) for r in rows)
    assert len({r["class_id"] for r in got if r["n_shingles"]}) == len(sets - {frozenset()}) and all((r["class_id"] is None) == (r["n_shingles"] == 0) for r in got)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        percent = int(rng.choice([70, 80, 85, 90]))
        universe = np.unique(rng.integers(0, 2**64 - 1, 2 * n + 40, dtype=np.uint64))
        a = np.sort(rng.choice(universe, n, replace=False))
        miss = ngram_join.may_miss(n, percent)
        drop = int(rng.integers(0, miss + 1))
        kept = np.sort(rng.choice(a, n - drop, replace=False))
        rest = np.setdiff1d(universe, a)
        b = np.sort(np.concatenate((kept, rng.choice(rest, int(rng.integers(0, miss + 1)), replace=False))))
        if 100 * len(kept) < percent * (len(a) + len(b) - len(kept)):
            continue
        kinds = dict(zip(universe.tolist(), rng.choice([0, 1, 2], len(universe), p=[0.1, 0.3, 0.6]).tolist()))
        kinds |= {t: max(1, kinds[t]) for t in np.intersect1d(a, b).tolist()}

        def signed(x):
            c = np.array([kinds[t] for t in x.tolist()])
            return set(ngram_join.signatures(x[c > 0], c[c > 0], int((c == 0).sum()), len(x), percent).tolist())

        assert signed(a) & signed(b)


def test_join_of_nothing(none):
    assert ngram_join.join(none).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("share,cap", [(1.5, 2.0), (0.9, 1.0), (0.2, 2.0), (9.0, 2.0)])
def test_mix(docs, share, cap):
    rows = mixing.curriculum(docs, share=share, cap=cap, bucket_docs=5).collect()
    assert len(rows) == len(messy())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= cap * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
    names = sorted(n for n in by if n is not None) + [None]
    weights = {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(names)}
    sizes = {n: sum(r["size"] for r in by[n]) for n in names}
    left, open_ = share * sum(sizes.values()), set(names)
    want = {}
    while open_:
        level = left / sum(weights[n] for n in open_)
        over = {n for n in open_ if level * weights[n] > cap * sizes[n]}
        if not over:
            want |= {n: level * weights[n] for n in open_}
            break
        want |= {n: cap * sizes[n] for n in over}
        left -= sum(cap * sizes[n] for n in over)
        open_ -= over
    for n in names:
        assert by[n][0]["target"] == pytest.approx(want[n]) and by[n][0]["source_size"] == sizes[n]
        assert abs(sum(r["taken"] for r in by[n]) - want[n]) < 1
    found = [r["position"] for r in rows if r["position"] is not None]
    assert found == sorted(found)
    read = mixing.reads(mixing.curriculum(docs, share=share, cap=cap, bucket_docs=5)).collect()
    assert sum(r["words"] for r in read) == sum(r["taken"] for r in rows) and [r["position"] for r in read] == sorted(r["position"] for r in read)
    # At a position the words read of a source so far are what its schedule asks for up to there.
    for n in names:
        seen, tilt = 0, 0.5 if names.index(n) % 2 else -0.5
        for r in sorted((r for r in read if r["source"] == n), key=lambda r: r["position"]):
            t = r["position"]
            assert abs(want[n] * (t * (1 + tilt) - tilt * t * t) - seen) < 1e-6 * (1 + want[n])
            seen += r["words"]
    for r in rows:
        assert (r["last_position"] is None) == (r["position"] is None) and (r["taken"] <= r["size"] or r["last_position"] > r["position"])


def test_mix_again_and_of_nothing(docs, none):
    assert sorted(map(str, mixing.curriculum(docs).collect())) == sorted(map(str, mixing.curriculum(docs.repartition(2)).collect()))
    assert mixing.curriculum(none).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------


def deduped(rows, min_docs, keep):
    found = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.encode().strip().lower()
            if key:
                found[key].add((i is None, i, t))
    gone, first = {k for k, v in found.items() if len(v) >= min_docs}, {}
    for k in gone:
        first[k] = min(found[k], key=lambda x: (x[0], x[1] or 0))
    out = []
    for i, t, *_ in rows:
        lines, seen, stay = (t or "").split("\n"), set(), []
        for line in lines:
            key = line.encode().strip().lower()
            drop = key in gone
            if drop and keep == "first" and first[key] == (i is None, i, t) and key not in seen:
                drop = False
            seen.add(key)
            if not drop:
                stay.append(line)
        out.append((-1 if i is None else i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("min_docs,keep", [(10, "none"), (2, "none"), (2, "first"), (10, "first"), (1, "none"), (14, "none")])
def test_lines(spark, docs, min_docs, keep):
    got = line_dedup.digests(docs, line_dedup.drop_bitmaps(docs, min_docs=min_docs, keep=keep)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == deduped(messy(), min_docs, keep)


def test_lines_over_partition_edges(spark):
    rows = [(i, "hot line\nown %d\nwarm %d" % (i, i % 60), "en", "s", 0) for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS).repartition(7)
    got = line_dedup.digests(frame, line_dedup.drop_bitmaps(frame, min_docs=10)).collect()
    assert sorted(map(tuple, got)) == deduped(rows, 10, "none")


def test_long_lines_and_many_copies(spark):
    long = "x" * 300_000
    rows = [(i, f"{long}\nown {i}" if i % 2 else f"own {i}\n{long}\n{long}", "en", "s", 0) for i in range(12)] + [(50, "same text", "en", "s", 0)] * 40 + [(60 + i, "same text", "en", "s", 0) for i in range(9)]
    frame = spark.createDataFrame(rows, DOCS).transform(clash).repartition(6)
    for keep in ("none", "first"):
        got = line_dedup.digests(frame, line_dedup.drop_bitmaps(frame, min_docs=10, keep=keep)).collect()
        assert sorted(map(tuple, got)) == deduped(rows, 10, keep)


def test_first_occurrences_over_many_partitions(spark):
    rows = [(3000 - i, f"everywhere\nhalf {i % 2}\ntwice {i % 400}\nonce {i}", "en", "s", 0) for i in range(800)]
    frame = spark.createDataFrame(rows, DOCS).repartition(9)
    maps = line_dedup.repeated(frame, "doc_id", "text", 2, 10, partition_rows=40)
    assert maps.where("first").count() == 1 + 2 + 400 and maps.where("first and often").count() == 3
    got = line_dedup.digests(frame, line_dedup.drop_bitmaps(frame, min_docs=2, keep="first")).collect()
    assert sorted(map(tuple, got)) == deduped(rows, 2, "first")


def test_lines_of_nothing(none):
    assert line_dedup.digests(none, line_dedup.drop_bitmaps(none)).count() == 0


def test_whole_copies_are_told_by_words(spark):
    boiler = "share this page\nall rights reserved"
    rows = [(i, boiler, "en", "s", 0) for i in range(12)] + [(50, " ".join(f"w{j}" for j in range(900)) + "\n" + boiler, "en", "s", 0), (51, "one two three four five six seven\n" + boiler, "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(frame, line_dedup.drop_bitmaps(frame, min_docs=10, keep="first")).collect()}
    assert got[50] == rows[12][1].split("\n")[0] and got[51] == "one two three four five six seven"
    assert all(got[i] == boiler for i in range(12))


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("tion", "ble", "the", "and", "ere") for b in ("a", "o", "i", "er", "ing")]
    rows, labels = [], []
    for i in range(600):
        t = rng.choices(words, k=rng.randint(20, 80))
        y = i % 6 == 0
        if y:
            for w in rng.sample(["zaploser", "Zaploser!", "grumkopf", "GRUMKOPFES", "zapl0ser", "grumkоpf"], 2):
                t.insert(rng.randint(0, len(t)), w)
        elif i % 5 == 0:
            t.append("grumkorn")
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(y)))
    labels += [(0, 1, None), (9999, 0, 1)]
    return spark.createDataFrame(rows, DOCS).transform(clash), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_not_learned_from(toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    rows = model.score(docs.where("doc_id % 3 = 1")).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 6 == 0) and 0 <= r["score"] <= 1 for r in rows)
    extra = model.score(docs.sparkSession.createDataFrame([(1, None), (2, ""), (3, "a Z A P zapIoser | grumkorn " + "and " * 30000)], "doc_id long, text string")).collect()
    assert [r["n_hits"] for r in extra] == [0, 0, 1]


def test_toxicity_without_labels(docs, toxic):
    model = toxicity.fit(docs, toxic[1].where("false"))
    assert {r["score"] for r in model.score(docs).collect()} == {0.0}
    assert {r["score"] for r in toxicity.fit(toxic[0], toxic[1].where("toxic = 1")).score(docs).collect()} == {1.0}


def test_toxicity_equals_a_plain_search(spark, toxic):
    """Every entry and exception looked for by hand in the folded texts, for texts of all kinds."""
    docs, labels = toxic
    labels = labels.union(spark.createDataFrame([(1, 1, 2), (2, 1, -1)], labels.schema))
    model = toxicity.fit(docs, labels, exceptions=("Grumkopf club", "the and zaploser club"))
    assert model.lexicon and set(model.exceptions) >= {" grumkopf ciub ", " the and zapioser ciub "}
    rows = [*((i, t) for i, t, *_ in messy()), *((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), (7000, "zaploser " * 3000 + "grumkorn " * 3000), (7001, "Z4PL0S3R!!grumkorn|grumkopf"), (7002, "the and ZAPLOSER club; zaploser club, Grumkopf  club, grumkopf club grumkopf")]
    got = model.score(spark.createDataFrame(rows, "doc_id long, text string").transform(clash)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((round(r["score"], 12), r["n_hits"]))
    for i, t in rows:
        folded = toxicity.fold(t or "")
        places = lambda e, folded=folded: [j for j in range(len(folded)) if folded.startswith(e, j)]
        covers = [(j, j + len(e)) for e in model.exceptions for j in places(e)] if len(folded) < 50000 else [(j, j + len(e)) for e in model.exceptions for j in (k for k, c in enumerate(folded) if c == e[0] and folded.startswith(e, k))]
        ends, reach = sorted(covers), 0
        hits = [(j, j + len(e), w) for e, w in model.lexicon for j in places(e)]
        free = []
        for a, b, w in sorted(hits):
            while ends and ends[0][0] <= a:
                reach = max(reach, ends.pop(0)[1])
            if b > reach:
                free.append(w)
        x = np.log1p(sum(free) / (1 + len(folded.split()) / 2000)) if free else 0.0
        want = (round(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -30, 30))), 12), len(free))
        assert want in by[i], (i, want, by[i])


def test_pairs_of_harmless_documents_become_exceptions(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("mel", "dor", "sin", "pat") for b in ("va", "lo", "ki")]
    rows, labels = [], []
    for i in range(400):
        t = rng.choices(words, k=30)
        if i % 4 == 0:
            t.insert(rng.randrange(30), "scumbag")
        elif i % 40 == 1:
            t[5:5] = ["scumbag", "filter"]
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " scumbag fiiter " in model.exceptions
    assert toxicity.weigh("the scumbag filter", model.lexicon, model.exceptions)[1] == 0 < toxicity.weigh("the scumbag speaks", model.lexicon, model.exceptions)[1]


def test_folding_and_exceptions():
    assert toxicity.fold("L0s3r! пех") == " ioseri пex " and toxicity.fold("Ｌoser") == " ioser "
    lexicon, exceptions = ((" trash", 5.0),), (" trash can ",)
    assert toxicity.weigh("the trash can is full", lexicon, exceptions)[1] == 0
    assert toxicity.weigh("the trash is full", lexicon, exceptions)[1] == 1


# --- 5 ---------------------------------------------------------------------------------------------------------------


def rules(rows, max_docs):
    def norm(line):
        return line.encode().strip().lower().translate(bytes.maketrans(b"123456789", b"000000000"))

    seen = Counter()
    for _, t, _, s, _ in rows:
        seen.update({(s, norm(x)) for x in (t or "").split("\n") if x.encode().split()})
    out = []
    for i, t, _, s, _ in rows:
        t = t or ""
        w = t.encode().split()
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines, dup, before = t.split("\n"), 0, set()
        for x in lines:
            if x.encode().split():
                dup += x in before
                before.add(x)
        removed = sum(len(x.encode().split()) for x in lines if x.encode().split() and seen[(s, norm(x))] > max_docs)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((-1 if i is None else i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), failed, removed, not failed and 100 * (len(w) - removed) >= 30 * len(w)))
    return sorted(out)


@pytest.mark.parametrize("max_docs", [3, 100])
def test_quality(spark, max_docs):
    rows = messy() + [(200, "a b c " * 40, "en", "s0", 0), (201, "#$ x|y\n#$ x|y\nA a\na A\n" * 15, "en", None, 0)] + [(300 + i, "Page 1%d of this\n" % i * 20, "en", "s9", 0) for i in range(5)]
    frame = spark.createDataFrame(rows, DOCS).transform(clash).repartition(4)
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in quality.line_rules(frame, max_docs=max_docs).collect())
    assert got == rules(rows, max_docs)


def test_quality_of_planted_hosts(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}x" for _ in range(n))
    page, boiler = text(90), "subscribe to our letter 7"
    rows = [(i, text(80) + ("\n" + boiler.replace("7", str(i % 10)) if i < 12 else "") + ("\n" + boiler if i == 0 else ""), "en", "small", 0) for i in range(40)]
    rows += [(100 + i, page + "\n" + text(10), "en", "small", 0) for i in range(11)] + [(200 + i, page, "en", None, 0) for i in range(10)]
    big = text(60)
    rows += [(1000 + i, text(60) + ("\n" + big if i < 15 else ""), "en", "big", 0) for i in range(2000)]
    frame = spark.createDataFrame(rows, DOCS).transform(clash)
    got = {r["id"]: r for r in quality.line_rules(frame).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == set(range(100, 111))
    assert [got[i]["removed_words"] for i in (0, 1, 12, 100, 200, 1000)] == [10, 5, 0, 90, 0, 0]
    left = quality.cleaned(frame)
    assert left.columns == frame.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts == {r[0]: "\n".join(x for x in r[1].split("\n") if r[3] != "small" or not (x == page or x.startswith("subscribe"))) for r in rows}


def test_quality_of_nothing(none):
    assert quality.line_rules(none).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, size=256, bucket_pieces=20).collect()
    want = Counter()
    for i, t, *_ in messy():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 256):
            want[(i, s, min(256, len(ids) - s), zlib.crc32(ids[s : s + 256].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1 + 1.1 * sum(r["length"] for r in rows) / 256


def test_special_strings_and_case():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    for t in ("a<|endoftext|>b <|EndOfText|> C.", "İstanbul ΣΑΣ. x's. 'S, d., ...", "é ́x\x1cy\x85z w .,", "", "  ", "Don't, stop. 12,5 .a", "l.e. e.g., .", "straße Ünïted ﬁn ǅ naïve nai\u0308ve ªº µm ÿØ"):
        assert np.frombuffer(next(encoder.texts([t.encode()])), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_words_are_encoded_once_without_signs():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, given = public_tokenizers.path("word_bpe_49k.json"), []
    encoder = packing._Encoder(path)

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **kw):
            given.extend(w for t in texts for w in t.split())
            return self.tokenizer.encode_batch_fast(texts, **kw)

    plain = Tokenizer.from_file(path)
    encoder.tokenizer, encoder.merges_only = Counted(encoder.tokenizer), Counted(encoder.merges_only)
    words, signs = ["ertiblent", "cióníquega", "schaußzu"], ["", "$$$", ".%%%", "###", ",&&&", "-_-", "<|", "'", "'s", "'re.", "\u0338", "=\u0338", "5", "|>"]
    texts = [" ".join(w + x for w in words for x in signs), "\x0b" + "\t".join(w.upper() + x for w in words for x in signs) + "\r", "a<|endoftext|>. <|startoftext|>$ <|b", " \n"]
    for got, t in zip(encoder.texts([t.encode() for t in texts]), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert max(Counter(given).values()) == 1 and not {w + x for w in words for x in ("$$$", ".%%%", "###", ",&&&", "-_-", "|>")} & set(given)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = "Two  words, and\nlines."
    assert np.frombuffer(next(packing._Encoder(path).texts([t.encode()])), "<u4").tolist() == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


def test_patterns_hold_the_histogram():
    rng = random.Random(4)
    for size in (16, 100, 4096):
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, size + 1), min(size, 40))}
        packs = packing.patterns(histogram, size)
        held = Counter()
        for lengths, count in packs:
            assert sum(lengths) <= size
            for n in lengths:
                held[n] += count
        assert held == histogram


def test_packing_of_nothing(none):
    assert packing.pack(none).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(1)
    kinds = {"aa": ["sch", "keit", "ung", "ver", "ein"], "bb": ["eau", "ment", "que", "oi", "aux"], "cc": ["ción", "ado", "lla", "mente", "os"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 90))), k, "s", 0) for i in range(300) for k in [list(kinds)[i % 3]]]
    frame = spark.createDataFrame([*rows, (900, None, "aa", "s", 0), (901, "123 !?", None, "s", 0), (902, "", "bb", "s", 0), (903, "schung " * 20000, None, "s", 0)], DOCS).transform(clash)
    contents = langid.dictionaries(frame.where("doc_id % 4 <> 2"))
    assert [k for k, _ in contents] == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.predict(frame, contents).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and all(0 <= r["score"] <= 1 for r in got.values())
    short = spark.createDataFrame([(1, "schkeitung verein"), (2, "½ ² ①"), (3, "eauquement oiaux")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(short, contents).collect()} == {1: "aa", 2: "und", 3: "bb"}
    assert langid.predict(short.selectExpr("doc_id", "'ª' AS text"), contents).first()["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.predict(frame, langid.dictionaries(frame.where("false"))).collect()} == {"und"}


def test_languages_equal_plain_compression(spark):
    """Each text compressed anew with every dictionary; the smallest wins, ties by the next levels, then by name."""
    rng = random.Random(7)
    kinds = {"aa": ["sch", "keit", "ung", "ver", "ein"], "bb": ["eau", "ment", "que", "oi", "aux"], "cc": ["ción", "ado", "lla", "mente", "os"]}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(k, rng.randint(1, 60)), k) for i in range(120) for k in [list(kinds)[i % 3]]]
    contents = langid.dictionaries(spark.createDataFrame(rows[:90], "doc_id long, text string, lang string"))
    texts = [*(t for _, t, _ in rows), "x", "A  b", make("aa", 9) + " " + make("bb", 9), "Un\nDeux", make("cc", 3000)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), contents).collect()}
    for i, t in enumerate(texts):
        size = lambda content, level, t=t: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=level, write_content_size=False).compress(t.lower().encode()))
        sizes = {lang: [size(content, level) for level in (6, 3, 9)] for lang, content in contents}
        low, second = sorted(s[0] for s in sizes.values())[:2]
        assert got[i]["lang_pred"] == min(sizes, key=lambda k: (sizes[k], k)), (t, sizes)
        assert got[i]["rejected"] == (second - low < 0.01 * low) and 1 / 3 <= got[i]["score"] <= 1


def test_all_languages_have_dictionaries(spark):
    rows = [(i, f"word{i} other{i}", f"l{i:03}", "s", 0) for i in range(70)] + [(100 + i, f"long{i} " * 3000, "zz", "s", 0) for i in range(3)]
    contents = dict(langid.dictionaries(spark.createDataFrame(rows, DOCS), dictionary_bytes=30000))
    assert sorted(contents) == [f"l{i:03}" for i in range(70)] + ["zz"] and len(contents["zz"]) == 30000
    with pytest.raises(ValueError):
        langid.dictionaries(spark.createDataFrame(rows, DOCS), max_languages=70)


# --- 8 ---------------------------------------------------------------------------------------------------------------


def vectors(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[20][1]) for i in range(60)]
    return rows + [(n + 100, None), (n + 120, [0.0] * 16), (n + 140, [float("nan")] + [1.0] * 15), (n + 160, [None] + [1.0] * 15), (n + 180, [1.0] * 3), (n + 200, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (n + 220, [])]


def nearest(rows, k):
    good = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = (x * good[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def searched(spark, rows, k=20, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").transform(clash)
    got = defaultdict(list)
    for r in imi.search(frame, frame.where("vec_id % 20 = 0"), k, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


def test_search_of_all_cells_is_exact(spark):
    rows = vectors(500)
    assert searched(spark, rows, visit_share=1.0, centroids=8, block=40) == nearest(rows, 20)


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    got, want = searched(spark, rows, centroids=24, visit=600), nearest(rows, 20)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / 20 for q, w in want.items()]) >= 0.9


def test_recall_of_the_registered_parameters(spark):
    """Vectors without clusters, more than the least count that is visited: half of them are."""
    x = np.random.default_rng(4).normal(size=(4000, 16))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    got, want = searched(spark, rows, visit_share=0.5, block=300, block_queries=70), nearest(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = lambda got: np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / 20 for q, w in want.items()])
    assert recall(got) >= 0.9 > recall(searched(spark, rows, visit_share=0.05, block=300, block_queries=70))


def test_few_vectors(spark):
    rows = [(0, [1.0] * 16), (20, [2.0] * 16), (21, [-1.0] * 16)]
    assert searched(spark, rows) == nearest(rows, 20)
    assert searched(spark, [(0, None)]) == {}


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    rows = [(i, f"http://x.example/{i}", f"<p>{i % 7}</p>" * (i % 5), "x") for i in range(80)] + [(100, None, None, "y"), (101, "u\nv", "é" * 30000, "y"), (3, "u", "<p>3</p>" * 3, "z"), (None, "n", "only", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, other string").transform(clash).repartition(3)
    got = warc.round_trip(frame).collect()
    first = {}
    for i, _, p, _ in rows:
        first.setdefault(p or "", []).append(i)
    want = Counter()
    for p, ids in first.items():
        low = None if None in ids else min(ids)
        for j, i in enumerate(sorted(ids, key=lambda x: (x is not None, x))):
            data = p.encode()
            want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if j else "response", low if j else None)] += 1
    assert Counter(map(tuple, got)) == want
    big = warc.round_trip(frame, min_bytes=20).collect()
    assert all(r["record_type"] == "response" for r in big if r["payload_bytes"] < 20)
    assert warc.round_trip(frame.where("false")).count() == 0


def test_broken_archives():
    dictionary = b"WARC/1.1 Content-Length response " * 8
    one = warc.record(1, "u", b"abc", 3, warc.digest(b"abc"))
    compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    good = warc.archive_head(dictionary) + compressor.compress(one) + compressor.compress(one)
    assert [warc.page_of(*r) for r in warc.read_archive(io.BytesIO(good), 7)] == [(1, 3, warc.digest(b"abc"), "response", None)] * 2
    plain = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + compressor.compress(one)
    assert len(list(warc.read_archive(io.BytesIO(plain)))) == 1
    for bad in (good[:-3], good[:20], warc.archive_head(dictionary) + compressor.compress(one.replace(b"WARC/1.1", b"WARC/9.9")), warc.archive_head(dictionary) + compressor.compress(one[:-1]), warc.archive_head(dictionary) + compressor.compress(one.replace(b"WARC-Date", b"WARC-Dote"))):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    with pytest.raises(warc.WarcError):
        warc.page_of(*warc.parse_record(warc.record(1, "u", b"abd", 3, warc.digest(b"abc"))))


# --- empty tables ------------------------------------------------------------------------------------------------------


def test_nothing_to_score(spark, none):
    """No documents to learn from or to score: no rows, or the defined scores of what there is."""
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame(messy()[:6], DOCS)
    assert toxicity.fit(none, labels).score(none).count() == 0 and toxicity.fit(some, labels).score(none).count() == 0
    assert {r["score"] for r in toxicity.fit(none, labels.where("false")).score(some).collect()} == {0.0}
    contents = langid.dictionaries(some.withColumn("lang", F.lit("aa")))
    assert langid.predict(none, contents).count() == 0 and langid.predict(none, langid.dictionaries(none)).count() == 0
    twice = [r["lang_pred"] for r in langid.predict(some.union(some), contents).collect()]
    assert len(twice) == 12 and set(twice) <= {"aa", "und"}


def test_exceptions_hold_whole_neighbour_words():
    """A long word before or after a hit is an exception as a whole, with its spaces."""
    import pyarrow as pa

    long = "q" * 300
    text = f"{long}    hate  w{long} x hate"
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([0], pa.int32())], ["text", "toxic"])
    lexicon = ((toxicity.fold("hate"), 1.0),)
    found = {e for b in toxicity._pairs(lexicon, ())(iter([batch])) for e in b.column(0).to_pylist()}
    assert found == {f" {long}    hate ", f" hate  w{long} ", " x hate "}
