"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if the document holds at least the given
share of the item's distinct five-word shingles, however long the document is.
Items are partitioned by set size (powers of two).  In each partition an item's
sketch is its m least shingle hashes under one fixed order, with m set from the
partition's greatest size u so that m > (1 - share) u: a containing document
then misses fewer shingles than the sketch has, and so holds one of them at
least.  Unlike a comparison of two MinHash signatures, this doesn't blur as the
document grows, and it loses nothing.  Documents are hashed once, shingles are
looked up among the sketch values, and each document and item that meet are
verified by counting the item's whole set in the document's whole set.

While the items' sets are proven to have at most ``BROADCAST_HASHES`` hashes,
they are broadcast and verified where the document is read, so documents never
travel.  Beyond that, documents' shingles pass a bit filter of fixed size, and
sketch and sets are found by equi-joins.

Defined results: words and sets as for near-duplicates (A-Z lowered, blanks and
09-0D as borders); null, empty and blank texts contain nothing and are in
nothing; an item of fewer than five words is one shingle and so is found only
as a document's whole text, not within a longer one; rows that repeat an id
count as one document or item with each of its texts tried, and report the text
with the greatest share (of these the larger set); null ids take no part; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, spread
from .textkit import shingle_sets, tidied

#: 16 MB of item shingles.
BROADCAST_HASHES = 2_000_000
FILTER_BITS = 26
_FOUND = "doc_id long, item_id long, n_common long, n_item long"


def sketch_size(n: int, percent: int) -> int:
    """Hashes in the sketch of an item of n shingles: enough for the largest item of its partition."""
    most = (1 << n.bit_length()) - 1
    return min(n, most - -(-most * percent // 100) + 1)


def _item_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            whole = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            # shingle_sets sorts by hash, so the least come first.
            least = pa.array([s[: sketch_size(len(s), percent)].view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), whole, least], names=["item_id", "n_item", "hashes", "sketch"])

    return run


def _search_here(items: list[tuple[int, np.ndarray]], percent: int):
    """Search and verify in the task that reads the document."""
    sizes = [sketch_size(len(h), percent) for _, h in items]
    values = np.concatenate([h[:m] for (_, h), m in zip(items, sizes, strict=True)]) if items else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(items)), sizes) if items else np.empty(0, np.int64)
    order = np.argsort(values, kind="stable")
    return values[order], owner[order], items


def _scan(index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owner, items = index.value
        distinct, first = np.unique(values, return_index=True)
        last = np.append(first[1:], len(values))
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for at in range(0, batch.num_rows, 256):
                for doc_id, s in zip(ids[at : at + 256], shingle_sets(batch.column(1).slice(at, 256).to_pylist()), strict=True):
                    if not len(s) or not len(distinct):
                        continue
                    spot = np.searchsorted(s, distinct)
                    spot[spot == len(s)] = 0
                    met = np.flatnonzero(s[spot] == distinct)
                    for i in {int(o) for k in met for o in owner[first[k] : last[k]]}:
                        item_id, h = items[i]
                        spot = np.searchsorted(s, h)
                        spot[spot == len(s)] = 0
                        common = int(np.count_nonzero(s[spot] == h))
                        if 100 * common >= percent * len(h):
                            rows.append((doc_id, item_id, common, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_common", "n_item"])

    return run


def _filtered(bits):
    """(doc_id, hash) of the documents' shingles that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, hashes = [], []
                for doc_id, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist()), strict=True):
                    spot = s >> np.uint64(64 - FILTER_BITS)
                    s = s[(words[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    ids.append(np.full(len(s), doc_id, dtype=np.int64))
                    hashes.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes))], names=["doc_id", "hash"])

    return run


def _bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of the hashes, at most 2^FILTER_BITS bits whatever their number."""
    spot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = hashes.select(F.shiftright(spot, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63))").alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, percent: int = 80, broadcast_hashes: int = BROADCAST_HASHES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_common, n_item) for every document that contains ``percent`` % or more of an item's shingles."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    work = Workspace(spark, "decontamination")
    sets = sets.mapInArrow(tidied(_item_sets(percent)), "item_id long, n_item long, hashes array<long>, sketch array<long>").where("n_item > 0")
    sets = work.write(sets, "items")
    total = sets.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    if total <= broadcast_hashes:
        known = sorted((r[0], r[1]) for r in sets.select("item_id", "hashes").collect())
        index = spark.sparkContext.broadcast(_search_here([(i, np.array(h, dtype=np.int64).view(np.uint64)) for i, h in known], percent))
        found = spread(texts).mapInArrow(tidied(_scan(index, percent)), _FOUND)
    else:
        found = _joined(work, texts, sets, percent)
    # An id that comes with several texts is reported with the most that one of them holds.
    best = F.max(F.struct((F.col("n_common") / F.col("n_item")).alias("share"), "n_item", "n_common")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_common", "best.n_item")


def _joined(work: Workspace, texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    spark = texts.sparkSession
    named = sets.withColumn("set_id", F.xxhash64("item_id", "hashes"))
    named = work.write(named, "sets")
    sketch = named.select("set_id", F.explode("sketch").alias("hash"))
    whole = named.select("set_id", "item_id", "n_item", F.explode("hashes").alias("hash"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    bits = spark.sparkContext.broadcast(_bit_filter(whole.select("hash")))
    hits = texts.select(F.col("row").alias("doc_id"), "text").mapInArrow(tidied(_filtered(bits)), "doc_id long, hash long")
    hits = work.write(hits.select(F.col("doc_id").alias("row"), "hash").distinct(), "hits")
    met = work.write(hits.join(sketch, "hash").select("row", "set_id").distinct(), "met")
    # Equal hashes of the pairs that met: whole sets against whole sets.
    common = met.join(hits, "row").join(whole, ["set_id", "hash"]).groupBy("row", "set_id").agg(F.count("*").alias("n_common"), F.first("item_id").alias("item_id"), F.first("n_item").alias("n_item"))
    common = common.where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return common.join(texts.select("row", "doc_id").distinct(), "row").select("doc_id", "item_id", "n_common", "n_item")


def clean(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of documents that contain no item."""
    found = contaminated(docs, items, percent, id_col=id_col, text_col=text_col)
    bad = found.select(F.col("doc_id").alias("bad_id")).distinct()
    # The table's own columns travel as one struct, so that no name of theirs can clash with ours.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    kept = rows.join(bad.hint("shuffle_hash"), F.col("own_id") == F.col("bad_id"), "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
