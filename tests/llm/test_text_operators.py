from __future__ import annotations

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrain.llm import bpe, token_counts as tc

from .helpers import sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "\n\n  \n x", "<|endoftext|>", "a<|endoftext|> b", "it's we'll DON'T", "été漢字😀 ½ ²", "a" * 5000, " " * 700 + "x", "x" * 30 + "́" * 9, " \x85\x1c\x00 q", "1234567 12,5"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    noise = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "<|endoftext|>", "the", "tion", "'s", "é", "漢", "1", "!!", "\t", "😀"]) for _ in range(rng.randrange(50))) for _ in range(300)]
    return ODD + noise + [sentence(rng, 200) for _ in range(20)]


def test_trie_encodes_as_the_library_does(library):
    c = bpe.codec(PATH)
    given = [t or "" for t in texts()]
    expected = [library.encode(t, add_special_tokens=False).ids for t in given]
    assert [list(array("I", p)) for p in c.encode_batch(given)] == expected
    assert [c.decode(x) for x in expected] == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_decoding_of_any_ids(library):
    rng = random.Random(3)
    ids = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(500)]
    assert [bpe.codec(PATH).decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids]
    assert bpe.codec(PATH).decode([5, 10**6]) == library.decode([5], skip_special_tokens=False)


def test_shared_prefixes_are_computed_once():
    c = bpe.BytePairCodec(PATH)
    calls = []
    decide = c._decide
    c._decide = lambda key: calls.append(key) or decide(key)
    c.encode_words(["international", "internationally", "internationalism"])
    first = len(calls)
    c.encode_words(["international", "internationally", "internationalism"])
    assert len(calls) == first and len(set(calls)) == first


def test_round_trip_over_a_table(spark, library):
    df = spark.createDataFrame(list(enumerate(texts())), "id long, text string").withColumnRenamed("id", "doc_id")
    for r in bpe.round_trip_digests(df, PATH).collect():
        t = texts()[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    both = bpe.decode(bpe.encode(df, PATH, check_col="same"), PATH)
    assert both.columns == ["doc_id", "text", "ids", "same", "decoded"] and both.where("NOT same").count() == 0
    assert both.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.round_trip_digests(df.where("false"), PATH).collect() == []
    clash = bpe.decode(bpe.encode(df.selectExpr("*", "'x' AS IDS", "1 AS same", "2 AS decoded"), PATH, check_col="same"), PATH)
    assert clash.columns == ["doc_id", "text", "ids", "same", "decoded"] and clash.where("NOT same OR decoded <> coalesce(text, '')").count() == 0


def test_token_counts_and_cache(spark, library, tmp_path, monkeypatch):
    rows = list(enumerate(texts())) + [(5000 + i, "the same text") for i in range(40)] + [(0, "again"), (0, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    cache = f"file://{tmp_path}/cache"
    expected = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)

    def got(frame):
        out = tc.token_counts(frame, PATH, cache, limit=100).collect()
        assert all(r.over_limit == (r.n_tokens > 100) for r in out)
        return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in out)

    assert got(df) == expected
    mark = tc.tokenizer_digest(PATH)
    stored = tc.read_cache(spark, cache, mark).count()
    assert stored == len({t or "" for _, t in rows})
    # A warm cache encodes nothing more, and another tokenizer sees none of it.
    assert got(df) == expected and spark.read.parquet(*tc._complete_runs(spark, cache)).count() == stored
    assert tc.read_cache(spark, cache, tc.tokenizer_digest(public_tokenizers.path("piece_bpe_32k.model"))).count() == 0
    assert got(df.where("false")) == []
    # Runs that repeat digests, put into one.
    more = tc._complete_runs(spark, cache)
    spark.read.schema(tc.CACHE_SCHEMA).parquet(*more).write.parquet(f"{cache}/run-again")
    assert tc.compact_cache(spark, cache) == len(more) + 1 and len(tc._complete_runs(spark, cache)) == 1
    assert got(df) == expected and tc.read_cache(spark, cache, mark).count() == stored and tc.compact_cache(spark, f"{cache}-none") == 0


def test_unfinished_runs_are_not_read(spark, tmp_path):
    (tmp_path / "cache/run-dead").mkdir(parents=True)
    (tmp_path / "cache/run-dead/part-0.parquet").write_bytes(b"torn")
    df = spark.createDataFrame([(1, "abc")], SCHEMA)
    assert tc.token_counts(df, PATH, f"file://{tmp_path}/cache").first().n_tokens == 1


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()) if t and "\x00" not in t], SCHEMA)
    assert all(r.n_tokens == len(model.encode(texts()[r.doc_id])) for r in tc.token_counts(df, path).collect())


def test_pieces_count_as_whole_texts_do(library):
    rng = random.Random(5)
    blanks = [" ", " ", "  ", "\n", " \n", "\n ", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\r\n"]
    given = ["".join(rng.choice([*blanks, "a", "the", "'s", "'", "1", "!!", "é", "́", "漢", "😀", "<|endoftext|>"][: None if k % 5 == 0 else -1]) for _ in range(rng.randrange(30))) for k in range(4000)]
    given += [x for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.isprintable() or c.isspace() or ord(c) < 0x3100 for x in (f"a {c}", f"{c} b")]
    count = tc.load_counter(PATH)
    assert [n for at in range(0, len(given), 5000) for n in count(given[at : at + 5000])] == [len(x) for at in range(0, len(given), 5000) for x in library.encode_batch_fast(given[at : at + 5000], add_special_tokens=False)]


def test_the_library_gets_each_piece_once(monkeypatch):
    import tokenizers

    class Told:
        chars = 0
        from_file = classmethod(lambda cls, path: cls(Tokenizer.from_file(path)))

        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **more):
            Told.chars += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **more)

    rng = random.Random(6)
    given = [sentence(rng, 200) for _ in range(200)]
    library = Tokenizer.from_file(PATH)
    expected = [len(x) for x in library.encode_batch_fast(given, add_special_tokens=False)]
    monkeypatch.setattr(tokenizers, "Tokenizer", Told)
    tc.load_counter.cache_clear()
    count = tc.load_counter(PATH)
    tc.load_counter.cache_clear()
    assert count(given) == expected and Told.chars < sum(map(len, given)) / 2
    once, Told.chars = Told.chars, 0
    assert count(given) == expected and Told.chars < once / 2
    # A memory too small for the pieces costs work, nothing else.
    monkeypatch.setattr(tc, "KEEP_PIECES", 3)
    assert [n for t in given for n in count([t])] == expected
