from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from weblake.llm import queries
from weblake.llm.common import cut, shared_dir


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(900)]
    rows, labels, dup, near = [], [], {}, {}
    for i in range(400):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(4))
        if i % 5 == 0:
            w = text.split(" ")
            for bad in rng.sample(["nastyword", "grimword", "foulword"], 2):
                w.insert(rng.randrange(len(w)), bad)
            text = " ".join(w)
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i % 9 == 1 and i % 5:
            text += "\nthis boilerplate line is part of very many pages"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    for i in range(1, 40, 3):
        if i % 5:
            rows.append((1000 + i, rows[i][1], "en", "s9", 0))
            w = rows[i][1].split(" ")
            w[7] = "changed"
            rows.append((2000 + i, " ".join(w), "en", "s8", 0))
            dup[1000 + i], near[2000 + i] = i, i
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (None, "without an id", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, dup, near


def test_stages(spark, corpus):
    folder, rows, dup, near = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, folder))
        kept.append((name, before, docs))
        if name != "packing":
            assert tuple(docs.columns) == pipeline.COLUMNS
    ids = {name: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for name, _, d in kept}
    assert set(ids["toxicity"]) == {r[0] for r in rows} - {i for i in range(0, 400, 5)}
    lines = Counter(x for r in kept[1][2].collect() for x in (r["text"] or "").split("\n"))
    assert lines["this boilerplate line is part of very many pages"] == 1 and ids["line_dedup"] == ids["toxicity"]
    assert not set(ids["near_duplicates"]) & (set(dup) | set(near)) and set(ids["near_duplicates"]) == set(ids["line_dedup"]) - set(dup) - set(near)
    size = lambda d: sum(len((r["text"] or "").split()) for r in d.collect())
    assert abs(size(kept[3][2]) - 0.9 * size(kept[2][2])) < 0.05 * size(kept[2][2]) and max(ids["mixing"].values()) == 1
    assert set(ids["packing"]) == set(ids["mixing"])
    assert pipeline.run(spark, folder).count() == kept[4][2].count()


def test_rows_of_one_id_are_documents(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(7, a), (7, b), (7, b), (8, b + " end"), (9, c), (9, c + " end"), (7, "too short"), (7, ""), (7, " "), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.without_near_duplicates(spark, docs, "").collect())
    nine = [(9, t) for t in (c, c + " end") if (9, t) in got]
    assert len(nine) == 1 and got == Counter([(7, a), (7, b), (7, "too short"), (7, ""), (7, " "), (None, "no id"), *nine])


def test_shared_passages_stay_once(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long, block, short = text(60), [text(20) for _ in range(3)], text(20)
    own = [text(200) for _ in range(6)]
    base = [text(25) for _ in range(10)]
    rows = [(0, f"{own[0]}\n{long}"), (1, f"{own[1]}\n{long}"), (2, "\n".join([own[2], *block])), (3, "\n".join([block[0], "", block[1], block[2], own[3]])), (4, f"{own[4]}\n{short}"), (5, f"{own[5]}\n{short}")]
    # Near copies that share six lines of ten with twelve others: without those lines they would link with nothing.
    for i in range(13):
        rows.append((100 + i, "\n".join([*base[:6], *(x.rsplit(" ", 1)[0] + f" z{i}" if i else x for x in base[6:])])))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = cut(pipeline.without_repeated_lines(spark, docs, ""))
    got = {r["doc_id"]: r["text"] for r in pipeline.without_near_duplicates(spark, lines, "").collect()}
    assert got == dict(rows[:7]) | {1: own[1], 3: "\n" + own[3]}


def test_near_duplicates_write_no_texts_to_checkpoints(spark):
    rng = random.Random(8)
    block = " ".join(f"b{rng.randrange(10**9)}" for _ in range(60))
    texts = [" ".join(f"{rng.randrange(16**8):08x}" for _ in range(400)) + (f"\n{block}" if i % 50 == 0 else "") for i in range(300)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(7, texts[7], "en", "s", 0), (900, texts[8], "en", "s", 0), (None, texts[9][::-1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    folder = shared_dir(spark).removeprefix("file:")
    held = lambda: sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
    before = held()
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.without_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(i, t if i == 0 else t.split("\n")[0]) for i, t in enumerate(texts)] + [(None, texts[9][::-1])])
    assert held() - before < 0.3 * sum(map(len, texts))


def test_stages_of_nothing(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, folder))
        assert docs.count() == 0


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
