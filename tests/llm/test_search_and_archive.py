from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import decontaminate as dc
from lexigrain.llm import topk, warc
from lexigrain.llm.shared import Workspace

from .helpers import edited, sentence

VECTORS = "vec_id long, embedding array<float>"


def best(rows, is_query, k):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if is_query(i)}):
        q = next(v for j, v in good if j == i)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k_is_exact(spark, monkeypatch, small):
    if small:
        for name, value in {"SHARD_BYTES": 40 * 6 * 8, "TILE": 3, "SLICE": 7, "FAN": 3}.items():
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1001, []), (1002, [None] * 6), (1005, [float("nan")] + [0.0] * 5), (1010, [float("inf")] * 6), (None, [1.0] * 6), (1020, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=10)
    assert sorted(tuple(r) for r in got.collect()) == best(rows, lambda i: i % 20 == 0, 10)


def test_top_k_of_few_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [-1.0])], VECTORS).withColumn("tile", F.lit("extra"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2 << 20), (0, 2, 1, 2 << 20), (0, 3, 2, -(1 << 20))]
    assert topk.top_k(df.where("false"), F.col("vec_id") == 0).collect() == []


def test_large_products():
    a = np.array([[1 << 30, 1]], dtype=np.int64)
    assert topk._product(a, a).tolist() == [[(1 << 60) + 1]]
    assert topk._product(a * 8, a * 8).tolist() == [[(1 << 63) - 1]] and topk._product(a * 8, a * -8).tolist() == [[-(1 << 63)]]
    rng = np.random.default_rng(4)
    q, r = (rng.integers(-9, 9, (40, 5)) * np.where(rng.random((40, 1)) < 0.2, 1 << 40, 1) for _ in range(2))
    exact = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in r] for a in q]
    assert topk._product(q, r).tolist() == exact


def test_huge_components_tie_at_the_ends(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).collect()]
    assert got == [(1, 1, (1 << 63) - 1), (2, 3, (1 << 63) - 1), (3, 2, -(1 << 63))]


PAGES = "page_id long, url string, html string"


def expected_pages(rows):
    groups = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            groups.setdefault(h, []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(groups.get(h, [i])) if i is not None else None
        revisit = i is not None and h in groups and i < top
        out.append((i if i is not None else -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else -1))
    return sorted(out)


@pytest.mark.parametrize("few", [10**6, 0])
def test_archive_round_trip(spark, few):
    rng = random.Random(8)
    same, large = sentence(rng, 300), "é" * 700_000
    rows = [(i, f"http://x/{i}", sentence(rng, rng.randrange(200))) for i in range(40)] + [(100 + i, "u", same) for i in range(30)]
    rows += [(200, None, None), (201, "a\r\nWARC-Type: b%0A", ""), (202, "", "\r\n\r\n" * 600), (203, "l", large), (204, "l", large), (204, "l", large), (205, "l", "x" * (256 << 10)), (206, "l", "x" * ((256 << 10) + 1)), (207, "l", "x" * 999), (208, "l", "x" * 999), (None, "n", same)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'extra' AS refers_to")
    chunks = Workspace(spark, "archive").write(warc.archive(df, broadcast_rows=few), "records")
    got = warc.read_archive(chunks)
    assert sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got.collect()) == expected_pages(rows)
    assert {r.target_uri for r in got.where("page_id = 201").collect()} == {"a\r\nWARC-Type: b%0A"}
    assert chunks.selectExpr("max(length(data))").first()[0] <= warc.CHUNK_BYTES + 4096
    # The chunks in order are the record as a WARC file holds it.
    parts = chunks.where("record_id like '<urn:page:206>%'").orderBy("chunk_no").collect()
    whole = b"".join(bytes(p.data) for p in parts)
    assert len(parts) == 3 and whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"x\r\n\r\n")


def test_urls_are_written_as_they_are(spark):
    urls = ["http://a/b%20c", "http://a/?q=%25", "http://x/é", "a: b", "", "two\nlines\r%", " edges "]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES)
    chunks = warc.archive(df)
    for r in chunks.collect():
        i = int(r.record_id.strip("<>").rpartition(":")[2])
        line = next(x for x in bytes(r.data).split(b"\r\n") if x.startswith(b"WARC-Target-URI: "))
        assert line == b"WARC-Target-URI: " + urls[i].replace("\n", "%0A").replace("\r", "%0D").encode()
    assert {r.page_id: r.target_uri for r in warc.read_archive(chunks).collect()} == dict(enumerate(urls))


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "x" * 600_000), (2, "u", "short")], PAGES)
    chunks = Workspace(spark, "archive").write(warc.archive(df), "records")
    assert warc.read_archive(chunks).count() == 2
    for bad in (chunks.where("NOT (chunk_no = 1)"), chunks.where("NOT last OR chunk_no = 0"), chunks.withColumn("data", F.expr("encode(replace(decode(data, 'ISO-8859-1'), 'short', 'shirt'), 'ISO-8859-1')"))):
        with pytest.raises(Exception, match="missing|damaged"):
            warc.read_archive(bad).collect()
    assert warc.read_archive(warc.archive(df.where("false"))).collect() == []


def containment(docs, items, percent):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = []
    for j, t in items:
        q = shingles(t)
        for i, d in docs:
            n = len(q & shingles(d))
            if q and 100 * n >= percent * len(q):
                out.append((i, j, n, len(q)))
    return sorted(set(out))


@pytest.mark.parametrize("bound", [dc.BROADCAST_HASHES, 0])
@pytest.mark.parametrize("percent", [80, 50])
def test_containment_is_exact(spark, bound, percent):
    rng = random.Random(9)
    items = [(j, sentence(rng, rng.choice([3, 5, 8, 20, 60, 130]))) for j in range(40)] + [(40, None), (41, "")]
    docs = [(i, sentence(rng, 400)) for i in range(30)]
    for k in range(60):
        j, t = rng.choice(items[:40])
        a, b = sentence(rng, rng.randrange(300)), sentence(rng, 200)
        docs.append((100 + k, f"{a} {edited(rng, t, rng.choice([0, 0, 1, 2, 4]))}\n{b}"))
    docs += [(300 + j, t) for j, t in items[:12]] + [(400, None), (401, ""), (402, sentence(rng, 30_000) + " " + items[5][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(d.selectExpr("*", "'x' AS item_id"), q, percent, broadcast_hashes=bound)
    assert sorted(tuple(r) for r in got.collect()) == containment(docs, items, percent)


def test_one_text_decides_a_repeated_pair(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "k l m n o p q")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "a b c d e f g h i j k l m n o p q"), (5, "k l m n o p q")], "doc_id long, text string")
    assert [tuple(r) for r in dc.contaminated(docs, items).collect()] == [(5, 1, 6, 6)]


def test_sketches_are_large_enough():
    for n in range(1, 600):
        for percent in (50, 80, 95):
            need = -(-n * percent // 100)
            assert dc.sketch_size(n, percent) > n - need


def test_clean_keeps_columns_and_handles_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "nothing here at all to see", "s"), (2, "a b c d e f", "t"), (None, "a b c d e f", "s")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "nothing here at all to see")], "item_id long, text string")
    docs = docs.selectExpr("*", "1 AS bad_id", "2 AS __bad", "3 AS own_id", "4 AS row")
    kept = dc.clean(docs, items).drop("bad_id", "__bad", "own_id", "row")
    docs = docs.drop("bad_id", "__bad", "own_id", "row")
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, "a b c d e f", "s")]
    assert dc.clean(docs, items.where("false")).count() == 4 and dc.contaminated(docs.where("false"), items).collect() == []
