"""The pipeline's stages, each on its own input, against plain versions on a small fixture."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Tables with bad documents, near copies, a repeated passage and benchmark leaks, and what they are."""
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 10)))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    passage = [word() for _ in range(60)]
    docs, kinds, labels = [], {}, []
    for i in range(300):
        w = [word() for _ in range(rng.randrange(90, 200))]
        kind = ("clean", "clean", "bad", "near", "repeat", "leak")[i % 6] if i > 12 else "clean" if i % 6 != 2 else "bad"
        if kind == "bad":
            w = [x + "###" for x in w]
        elif kind == "near":
            w = words(docs[(i - 13) // 6 * 6 % 12 if docs[(i - 13) // 6 * 6 % 12][0] % 6 != 2 else 0][1])
            w[rng.randrange(len(w))] = "changed"
        elif kind == "repeat":
            w[40:40] = passage
        elif kind == "leak":
            w[30:30] = words(rng.choice(items))
        docs.append((i, " ".join(w), "en", "s", len(" ".join(w))))
        kinds[i] = kind
        labels.append((i, int(kind != "bad"), 0))
    docs.append((1000, docs[0][1], "en", "s", 1))
    kinds[1000] = "near"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds, passage


def test_stages(spark, data, tmp_path):
    folder, kinds, passage = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r for r in docs.collect()}
    good, one, cut, clean = (kept[n] for n in ("quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination"))
    assert set(good) == {i for i, k in kinds.items() if k != "bad"}
    assert set(one) == {i for i in good if kinds[i] != "near"}
    assert set(cut) == set(one)
    repeats = sorted(i for i in one if kinds[i] == "repeat")
    for i, r in cut.items():
        w, v = words(one[i].text), words(r.text)
        if i in repeats[1:]:
            assert v == w[:40] + w[100:] and r.n_chars == len(r.text)
        else:
            assert r == one[i]
    assert set(clean) == {i for i in cut if kinds[i] != "leak"}
    assert {r.doc_id for r in docs.collect()} == set(clean)


def test_decontamination_removes_the_very_rows(spark, data):
    folder, _, _ = data
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [(None, item, "leak"), (None, "clean", "clean"), (7, item, "leak"), (7, "clean too", "clean"), (8, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.source for r in corpus_pipeline.decontamination(spark, docs, folder).collect()) == ["clean", "clean", "null"]


def test_run_is_the_stages(spark, data):
    folder, kinds, _ = data
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {i for i, k in kinds.items() if k in ("clean", "repeat")}
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
