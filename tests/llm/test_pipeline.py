from __future__ import annotations

import math
import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from lexigrain.llm import quality

from .helpers import edited, sentence
from .test_minhash_dedup import brute
from .test_native_operators import base_spans, plain_disclosures
from .test_quality import plain_features
from .test_search_and_archive import containment

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which it is known what becomes of them."""
    rng = random.Random(12)
    out, fate, labels = [], {}, []

    def add(text, what):
        i = len(out)
        out.append((i, text, "en", f"src{i % 3}", len(text)))
        fate[i] = what
        return i

    for k in range(900):
        text = ", ".join(sentence(rng, rng.randrange(10, 23)) for _ in range(4)) + "."
        if k % 5 == 0:
            i = add(text.upper().replace(" ", "!! "), "poor")
        elif k % 5 == 1:
            words = text.split()
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["dolt", "twerp"]))
            i = add(" ".join(words), "toxic")
        elif k % 15 == 2:
            i = add(f"{text} Mail me{k}@corp.example, {sentence(rng, 10)}.", "private")
        else:
            i = add(text, "good")
        if k < 700:
            labels.append((i, int(fate[i] != "poor"), int(fate[i] == "toxic")))
    items = [(j, sentence(rng, 30)) for j in range(5)]
    clean = [i for i, f in fate.items() if f == "good" and out[i][1].count(" ") > 65]
    for i in clean[:20]:
        add(edited(rng, out[i][1], 1), "copy")
    for j, t in items:
        add(f"{sentence(rng, 40)}, {t} {sentence(rng, 40)}.", "leak")
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(out, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, fate


def test_pipeline_keeps_what_it_should(spark, folder):
    path, fate = folder
    rows = {r.doc_id: r for r in cp.run(spark, path).collect()}
    share = lambda what: sum(i in rows for i, f in fate.items() if f == what) / sum(f == what for f in fate.values())
    assert share("good") > 0.97 and share("poor") < 0.05 and share("toxic") < 0.1 and share("copy") == 0 and share("leak") == 0 and share("private") > 0.97
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows.values())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for i, r in rows.items():
        text = library.decode(r.ids, skip_special_tokens=False)
        assert text == texts[i] if fate[i] == "good" else True
        if fate[i] == "private":
            assert "[EMAIL]" in text and "corp.example" not in text


def test_stages_equal_a_plain_version(spark, folder):
    """Each stage, from what the one before kept, against loops over strings; the classifier against its own model row by row."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    table = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"), quality.rating())
    score = {i: sum(float(model.weights[k]) for k in plain_features(t)) for i, t in table.items()}
    good = {i: t for i, t in table.items() if 1 / (1 + math.exp(model.cuts[1] - score[i])) >= 0.6}
    stage = spark.createDataFrame
    got = cp.quality_classifier(spark, docs, path)
    assert {r.doc_id: r.text for r in got.collect()} == good
    groups = brute(list(good.items()), 80)
    first = {i: t for i, t in good.items() if groups[i][1] == i}
    shaped = lambda d: docs.join(stage([(i,) for i in d], "doc_id long"), "doc_id", "left_semi")
    assert {r.doc_id: r.text for r in cp.near_dedup(spark, shaped(good), path).collect()} == first
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    bad = {i for i, *_ in containment(list(first.items()), items, 80)}
    clean = {i: t for i, t in first.items() if i not in bad}
    assert bad and {r.doc_id: r.text for r in cp.benchmark_decontamination(spark, shaped(first), path).collect()} == clean
    terms, safe = plain_disclosures(list(clean.items())), {}
    for i, t in clean.items():
        spans = sorted([(a, b, k.upper()) for k, a, b in base_spans(t)] + [(a, b, "TERM") for a, b in terms.get((i, t), [])], reverse=True)
        for a, b, k in spans:
            t = f"{t[:a]}[{k}]{t[b:]}"
        safe[i] = t
    rows = cp.personal_data(spark, shaped(clean), path)
    assert {r.doc_id: (r.text, r.n_chars) for r in rows.collect()} == {i: (t, len(t)) for i, t in safe.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in safe.items()}
    out = {r.doc_id: r for r in cp.run(spark, path).collect()}
    assert {i: r.ids for i, r in out.items()} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in out.values())


def test_stages_take_columns_of_any_name(spark, folder):
    path, _ = folder
    names = "id grade ids round_trip place rated_id own_id own_text own_hash row node digest first bad_id f_id f_hash spans merged n_tokens kept".split()
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 60").selectExpr("*", *(f"1 AS {c}" for c in names))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        assert out.count() > 0
        if name != "encoding":
            assert out.columns == docs.columns


def test_stages_follow_the_contract(spark, folder):
    path, _ = folder
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_dedup", "benchmark_decontamination", "personal_data", "encoding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.where("false"), path)
        assert empty.collect() == []
        if name != "encoding":
            assert empty.columns == docs.columns
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all here", "en", "s", 3), (3, "x" * 200_000, "en", "s", 1)], DOCS)
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, odd, path).count() == 4


def test_stages_agree_with_their_operators(spark):
    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = cp.quality_classifier(spark, docs, path)
    assert 0 < good.count() < docs.count()
    assert cp.near_dedup(spark, docs, path).count() < docs.count()
    assert cp.run(spark, path).where("NOT round_trip").count() == 0
