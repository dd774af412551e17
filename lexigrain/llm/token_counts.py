"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a folder of Parquet runs with the columns ``content`` (SHA-256 of
the normalised text), ``tokenizer`` (SHA-256 of the vocabulary file and the
counting rule) and ``n_tokens``.  Counting joins the documents' digests with
it, encodes each distinct missing text once, appends the new counts as one run,
and joins again.  A run is named by a fresh identifier and counts only once
Spark has marked it complete, so a job that dies leaves nothing that is read;
two jobs may append the same digest, which the reader folds into one.
``compact_cache`` puts many runs into one.

Texts travel once, dealt by doc_id, and only where their digest is missing from
the cache; digests are reduced to one document each before that, so a text
with any number of copies is encoded once and no task holds a group of copies.

A byte-level vocabulary cuts a text before every blank that a non-blank follows,
wherever it stands.  Texts fall into pieces there, and a worker asks the library
for each distinct piece once as long as it remembers it.

Normalising must not change the count.  The byte-level vocabularies have no
normaliser, so the default one only turns null into the empty text.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that
repeat a doc_id are counted each on its own; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, delete_path
from .textkit import tidied

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"
#: Bytes of text handed to the tokenizer at once.
ENCODE_BYTES = 1 << 20
#: Pieces of texts, and their characters, whose counts a worker remembers.
KEEP_PIECES, KEEP_CHARS = 300_000, 4_000_000
#: Pieces handed to the tokenizer at once.
PIECES = 8192

#: Where pieces begin; blanks are all that Python calls so, which are those of the library and four more.
_BORDER, _BLANKS = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def _cuttable(path: str) -> bool:
    """Whether the vocabulary cuts texts as the pieces need it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not spec["normalizer"]
    return plain and model["type"] == "BPE" and not model.get("dropout") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])


def _by_pieces(count: Callable[[list[str]], list[int]], special: list[str]) -> Callable[[list[str]], list[int]]:
    """``count`` for texts by way of their pieces; texts with added tokens, at which the library starts anew, are counted whole."""
    known: dict[str, int] = {}
    chars = 0

    def run(texts: list[str]) -> list[int]:
        nonlocal chars
        whole = [any(s in t for s in special) for t in texts]
        # The first piece has no blank before it and is counted as it stands.
        split = [[t] if w else (_BORDER.split(t) if _BLANKS.search(t) else t.split(" ")) for t, w in zip(texts, whole, strict=True)]
        counts = count([pieces.pop(0) for pieces in split])
        distinct = set().union(*split)
        fresh = list(distinct.difference(known))
        more = sum(map(len, fresh))
        if len(known) + len(fresh) > KEEP_PIECES or chars + more > KEEP_CHARS:
            known.clear()
            fresh = list(distinct)
            chars, more = 0, sum(map(len, fresh))
        chars += more
        for at in range(0, len(fresh), PIECES):
            part = fresh[at : at + PIECES]
            known.update(zip(part, count([f" {p}" for p in part]), strict=True))
        get = known.__getitem__
        return [n + sum(map(get, pieces)) for n, pieces in zip(counts, split, strict=True)]

    return run


@functools.lru_cache(maxsize=4)
def load_counter(path: str):
    """A function from a list of texts to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    count = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _by_pieces(count, [t.content for t in model.get_added_tokens_decoder().values()]) if _cuttable(path) else count


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(b"count;no added tokens;" + hashlib.file_digest(f, "sha256").digest()).digest()


def normalised(text) -> F.Column:
    return F.coalesce(text, F.lit(""))


def _content(text) -> F.Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = load_counter(path), set()
        for batch in batches:
            # Rows that repeat a document wholly come to one task; their text is encoded once.
            fresh = [c not in seen and not seen.add(c) for c in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            texts, sizes = batch.column(1), pc.binary_length(batch.column(1).cast(pa.binary())).to_pylist()
            counts, at = [], 0
            while at < len(sizes):
                to, total = at, 0
                while to < len(sizes) and (to == at or total + sizes[to] <= ENCODE_BYTES):
                    total += sizes[to]
                    to += 1
                counts += count(texts.slice(at, to - at).to_pylist())
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return run


def _complete_runs(spark: SparkSession, cache: str) -> list[str]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(cache)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    runs = [f.getPath().toString() for f in fs.listStatus(root) if f.isDirectory()]
    return sorted(r for r in runs if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{r}/_SUCCESS")))


def read_cache(spark: SparkSession, cache: str, tokenizer: bytes) -> DataFrame:
    """(content, n_tokens), one row for each digest that has been counted with this tokenizer."""
    runs = _complete_runs(spark, cache)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(*runs) if runs else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == F.lit(bytearray(tokenizer))).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def compact_cache(spark: SparkSession, cache: str) -> int:
    """Put the runs of a cache into one, each digest once; returns the number of runs before.

    The new run is complete before the others go, so a job that dies here leaves repeated digests at worst; jobs that
    read the cache meanwhile may have to be started again.
    """
    runs = _complete_runs(spark, cache)
    if len(runs) > 1:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(*runs).groupBy("tokenizer", "content").agg(F.max("n_tokens").alias("n_tokens"))
        # In ranges of digests, whose least and greatest values then tell a reader which files it needs.
        merged = rows.select("content", "tokenizer", "n_tokens").repartitionByRange("tokenizer", "content").sortWithinPartitions("tokenizer", "content")
        merged.write.parquet(f"{cache}/run-{uuid.uuid4().hex}")
        for r in runs:
            delete_path(spark, r)
    return len(runs)


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; appends to ``cache``, by default a new one."""
    spark = docs.sparkSession
    cache = cache or Workspace(spark, "token-counts").path
    mark = tokenizer_digest(tokenizer_path)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), _content(F.col(text_col)).alias("content"), F.octet_length(normalised(F.col(text_col))).cast("long").alias("n_bytes")
    )
    missing = (
        rows.groupBy("content")
        .agg(F.min(F.struct("doc_id", "n_bytes")).alias("first"))
        .join(read_cache(spark, cache, mark).select("content"), "content", "left_anti")
        .select(F.col("first.doc_id").alias("doc_id"), "content")
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    # Only small rows are on the built side; the texts are streamed past it without being sorted.
    misses = texts.join(missing.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(missing["doc_id"])).select("content", "text")
    # A repeated doc_id brings texts of other digests along.
    misses = misses.where(F.col("content") == F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    counted = misses.mapInArrow(tidied(_count(tokenizer_path)), "content binary, n_tokens long")
    counted.select("content", F.lit(bytearray(mark)).alias("tokenizer"), "n_tokens").write.parquet(f"{cache}/run-{uuid.uuid4().hex}")
    return rows.join(read_cache(spark, cache, mark), "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
