"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct five-word shingles.  Equal sets form one
class, found by a 128-bit digest of the set; from there on classes are compared,
never rows, so copies cost nothing and an id that comes with several texts takes
part with each of them.  Classes meet in the buckets of ``BANDS`` bands of
``ROWS`` MinHash values.

Two odd sketches, bitmaps in which every element flips one bit, judge a pair
before any text is fetched.  The first folds the ``SAMPLES`` MinHash values: the
population count of the XOR of two of them estimates how many samples differ,
and so the similarity, very precisely when it is high.  The second folds the
whole set: its count never exceeds the size of the symmetric difference, which
the sizes of two similar sets bound.  Pairs within both limits are confirmed on
the full sets, and nothing else is a link.

No bucket is expanded into its pairs.  First every class is compared with the
least class of its bucket, which joins the bulk of any large group.  Then, in
buckets that still hold several components, blocks of at most ``BLOCK`` sketches
(128 bytes each) are compared inside tasks.  A first round lets a block name
only pairs that would join two components, most similar ones first; in buckets
where some of these are refuted, a second round names every pair that is still
open.  Pairs of blocks that lie in one component together are left out.  Texts travel
for named pairs alone, and a class that is named with many others meets ``HUB``
of them at a time, so its text is sent once for so many.

A pair of similarity 0.85 shares none of 24 bands of 4 rows with a chance of
(1 - 0.85^4)^24 = 2e-8, and its estimate misses the margin with less than 1e-6.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows that repeat a doc_id share one component, whatever their texts,
and each keeps its row; a null doc_id links with nothing; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_roots
from .shared import Workspace, spread
from .textkit import mix64, shingle_sets, slices, tidied

BANDS, ROWS, SAMPLES, SKETCH_BITS = 24, 4, 160, 512
#: Sketches in a block, and classes that meet one copy of a text.
BLOCK, HUB = 4096, 64
#: Standard errors beyond the threshold that are still confirmed.
MARGIN = 5.0
_WORDS = SKETCH_BITS // 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SALTS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def minhash(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, _EMPTY, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[at : at + 1024, None] * _MULTIPLIERS).min(axis=0), out=out)
    return out


def _parities(hashes: np.ndarray) -> np.ndarray:
    """The bitmap in which every hash flips one bit, as 64-bit words."""
    place = (hashes % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples."""
    return _parities(mix64(samples ^ _SALTS))


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of the whole set."""
    return _parities(mix64(shingles ^ np.uint64(0x6A09E667F3BCC909)))


def estimated_similarity(odd: np.ndarray) -> np.ndarray:
    """Similarities from the population counts of XORed sketches of samples."""
    rest = np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9)
    return 1 + np.log(rest) * SKETCH_BITS / 2 / (2 * SAMPLES)


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - MARGIN * (t * (1 - t) / SAMPLES) ** 0.5


def greatest_distance(percent: int) -> int:
    """The population count of XORed sketches of samples from which on a pair is passed over."""
    return int(np.argmax(estimated_similarity(np.arange(SKETCH_BITS // 2 + 1)) < least_estimate(percent)))


def _difference_limit(total, percent: int, lib) -> tuple:
    """The most that the XORed sketches of two linked sets of ``total`` elements together can count: (surely, within the margin)."""
    most = lib.floor(total * (100 - percent) / (100 + percent))
    mean = SKETCH_BITS / 2 * (1 - lib.exp(-2.0 * most / SKETCH_BITS))
    spread = lib.sqrt(SKETCH_BITS / 4 * (1 - lib.exp(-4.0 * most / SKETCH_BITS)))
    return most, mean + MARGIN * spread + 1


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1024):
            n, digests, bands, sketches = [], [], [], []
            for s in shingle_sets(part.column(2).to_pylist()):
                n.append(len(s))
                if len(s):
                    m = minhash(s)
                    digests.append(hashlib.sha256(s.tobytes()).digest()[:16])
                    keys = np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + m[r * BANDS : (r + 1) * BANDS])
                    bands.append(keys.view(np.int64))
                    sketches.append(np.concatenate([odd_sketch(m), set_sketch(s)]).view(np.int64))
                else:
                    digests.append(None)
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"],
            )


_SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _links(found: list[tuple], names: tuple[str, ...] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names=list(names))


def _confirmed(percent: int):
    """Rows (hub, part, side, node, text) in order: the first of a part is the hub's text, the others are held against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            for part in slices(batch, 256):
                found = []
                keys, sides, nodes = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), part.column(2).to_pylist(), part.column(3).to_pylist()
                for k, side, node, s in zip(keys, sides, nodes, shingle_sets(part.column(4).to_pylist()), strict=True):
                    if side == 0:
                        key, hub = k, s
                    elif k == key and similar(hub, s, percent):
                        found.append((k[0], node))
                yield _links(found)

    return run


_NAMED = ("a", "b", "bucket")


def _named(bucket: int, rows: list[tuple[np.ndarray, ...]], percent: int, far: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, bucket) of the first and the second block (or within one) that may be links between components.

    rows: (side, node, component, size, sketch) of one pair of blocks.  Unless ``every``, a pair is named only if it
    joins what no pair before has joined, and nodes of any open pair come along as (node, null, null).
    """
    side, node, component, size = (np.concatenate([r[i] for r in rows]) for i in range(4))
    sketch = np.concatenate([r[4] for r in rows])
    label, open_ = component.copy(), np.zeros(len(node), dtype=bool)
    cross = bool(side.any())
    firsts, seconds = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(node)), None)
    found: list[tuple[int | None, ...]] = []
    for i in firsts:
        others = seconds if cross else np.arange(i + 1, len(node))
        odd = np.bitwise_count(sketch[others] ^ sketch[i])
        differ = odd[:, _WORDS:].sum(axis=1, dtype=np.int64)
        sure, likely = _difference_limit((size[others] + size[i]).astype(np.float64), percent, np)
        near = (odd[:, :_WORDS].sum(axis=1, dtype=np.int64) <= far) & (differ <= np.minimum(sure, likely))
        near &= (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])) & (component[others] != component[i])
        if not near.any():
            continue
        others, differ = others[near], differ[near] / (size[others][near] + size[i])
        if every:
            found += [(int(node[i]), int(node[j]), bucket) for j in others]
        else:
            open_[i] = open_[others] = True
            while (left := np.flatnonzero(label[others] != label[i])).size:
                j = others[left[np.argmin(differ[left])]]
                found.append((int(node[i]), int(node[j]), bucket))
                label[label == label[j]] = label[i]
        if len(found) >= 65_536:
            yield _links(found, _NAMED)
            found = []
    yield _links(found + [(int(x), None, None) for x in node[open_]], _NAMED)


def _blocks(percent: int, far: int, every: bool):
    """Walks block pairs, one group of sorted rows (bucket, one, two, side, node, component, size, sketch) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7)]
            sketch = batch.column(7).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if keys[start] != key:
                    if rows:
                        yield from _named(key[0], rows, percent, far, every)
                    key, rows = keys[start], []
                # Copies, as a batch's memory is handed back before its group may end.
                rows.append((*(x[start:end].copy() for x in numbers), sketch[start:end].copy()))
                start = end
        if rows:
            yield from _named(key[0], rows, percent, far, every)

    return run


class _Search:
    """The classes of one table and the links between them."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str):
        self.percent, self.far = percent, greatest_distance(percent)
        self.work = Workspace(docs.sparkSession, "near-duplicates")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
        self.signatures = self.work.write(spread(self.docs).mapInArrow(tidied(_signatures), _SIGNATURE), "signatures")
        usable = self.signatures.where("digest is not null and doc_id is not null")
        # A class of any size is one partial aggregate per task.  Nodes are numbered once, in the written table.
        first = F.min(F.struct("doc_id", "text_hash")).alias("first")
        classes = usable.groupBy("digest").agg(first, F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
        self.classes = self.work.write(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "size", "bands", "sketch"), "classes")
        repeated = usable.groupBy("doc_id", "text_hash").count().where("count > 1")
        self.repeated = self.work.write(repeated.select("doc_id", "text_hash"), "repeated")
        self.repeats = not self.repeated.isEmpty()

    def texts(self, nodes: DataFrame, name: str) -> DataFrame:
        """node, text of the given nodes."""
        wanted = nodes.select("node").distinct().join(self.classes.select("node", "first"), "node")
        wanted = wanted.select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
        # The ids are built into a hash table and the texts streamed past, not sorted.
        same = (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash"))
        out = self.work.write(self.docs.join(wanted.hint("shuffle_hash"), same).select("node", "text"), name)
        # Rows that repeat an id with its text are there several times.
        return out.dropDuplicates(["node"]) if self.repeats else out

    def confirm(self, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        # As (a, part) has one copy of a's text, b is the side that travels once a pair.
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB)).alias("parts"))
        dealt = pairs.join(parts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
        dealt = self.work.write(dealt, f"{name}-dealt")
        ones = dealt.join(texts, F.col("b") == F.col("node")).select("hub", "part", F.lit(1).alias("side"), "node", "text")
        hubs = dealt.select("hub", "part").distinct().join(texts, F.col("hub") == F.col("node")).select("hub", "part", F.lit(0).alias("side"), "node", "text")
        rows = hubs.unionAll(ones).repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
        links = self.work.write(rows.mapInArrow(tidied(_confirmed(self.percent)), "a long, b long").distinct(), name)
        self.work.drop(f"{name}-dealt")
        return links

    def shared_buckets(self) -> DataFrame:
        """bucket, node, centre (the least node) of the buckets with two nodes or more."""
        entries = self.classes.select("node", F.explode("bands").alias("bucket"))
        shared = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
        return self.work.write(entries.join(shared.select("bucket", "centre"), "bucket"), "buckets")

    def centre_pairs(self, buckets: DataFrame) -> DataFrame:
        """(a, b): centres and the nodes of their buckets that the sketches don't tell apart."""
        pairs = buckets.where("node <> centre").select("centre", "node").distinct()
        sketch = self.classes.select("node", "size", "sketch")
        rows = pairs.join(sketch, "node").join(sketch.select(F.col("node").alias("centre"), F.col("size").alias("n"), F.col("sketch").alias("s")), "centre")
        count = lambda at: sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("s", F.lit(i)))) for i in range(at, at + _WORDS)), F.lit(0))
        sure, likely = _difference_limit((F.col("size") + F.col("n")).cast("double"), self.percent, F)
        sizes = F.least("size", "n") * 100 >= F.greatest("size", "n") * self.percent
        rows = rows.where(sizes & (count(0) <= self.far) & (count(_WORDS) <= F.least(sure, likely)))
        return self.work.write(rows.select(F.col("centre").alias("a"), F.col("node").alias("b")), "centre-pairs")

    def open_pairs(self, buckets: DataFrame, roots: DataFrame, every: bool, name: str) -> DataFrame:
        """(a, b, bucket) named by the blocks of the buckets that hold several components."""
        labelled = buckets.select("bucket", "node").join(roots, "node", "left")
        labelled = self.work.write(labelled.select("bucket", "node", F.coalesce("root", "node").alias("component")), f"{name}-labelled")
        spans = labelled.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        active = labelled.join(spans.where("low < high").select("bucket", "size"), "bucket")
        # Large components fill blocks of their own; the small ones of a bucket share blocks.
        parts = active.groupBy("bucket", "component", "size").agg(F.count("*").alias("part"))
        alone = (F.col("part") * 2 > BLOCK) & (F.col("size") > BLOCK)
        parts = parts.withColumn("pure", F.when(alone, F.col("component")))
        mixed = parts.groupBy("bucket").agg(F.sum(F.when(F.col("pure").isNull(), F.col("part")).otherwise(0)).alias("mixed"))
        spread = lambda col, n: F.pmod(F.xxhash64(col), F.ceil(n / F.lit(BLOCK))).cast("string")
        block = (
            F.when(F.col("size") <= BLOCK, F.lit("all"))
            .when(F.col("pure").isNull(), F.concat(F.lit("mixed:"), spread("component", F.col("mixed"))))
            .otherwise(F.concat_ws(":", F.col("component").cast("string"), spread("node", F.col("part"))))
        )
        placed = active.join(parts.drop("size"), ["bucket", "component"]).join(mixed, "bucket").select("bucket", "node", "component", block.alias("block"), "pure")
        placed = self.work.write(placed, f"{name}-placed")
        blocks = placed.groupBy("bucket", "block").agg(F.first("pure").alias("pure"))
        other = blocks.select("bucket", F.col("block").alias("two"), F.col("pure").alias("pure_two"))
        meetings = (
            blocks.withColumnRenamed("block", "one")
            .join(other, "bucket")
            .where((F.col("one") <= F.col("two")) & ~F.coalesce(F.col("pure") == F.col("pure_two"), F.lit(False)))
            .select("bucket", "one", "two")
        )
        first = placed.join(meetings.withColumn("block", F.col("one")), ["bucket", "block"]).withColumn("side", F.lit(0))
        second = placed.join(meetings.where("one <> two").withColumn("block", F.col("two")), ["bucket", "block"]).withColumn("side", F.lit(1))
        rows = first.unionByName(second).join(self.classes.select("node", F.col("size"), "sketch"), "node")
        rows = rows.select("bucket", "one", "two", "side", "node", "component", "size", "sketch")
        dealt = rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
        out = self.work.write(dealt.mapInArrow(tidied(_blocks(self.percent, self.far, every)), "a long, b long, bucket long"), name)
        for part in ("labelled", "placed"):
            self.work.drop(f"{name}-{part}")
        return out

    def components(self) -> DataFrame:
        """(node, root) of all nodes with links."""
        work, buckets = self.work, self.shared_buckets()
        pairs = self.centre_pairs(buckets)
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), "centre-texts")
        links = self.confirm(pairs, texts, "centre-links")
        work.drop("centre-texts")
        roots = component_roots(links, work, "first")
        star = lambda df: df.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = self.open_pairs(buckets, roots, False, "open")
        named = found.where("b is not null")
        if not named.isEmpty():
            texts = self.texts(found.where("b is null").select(F.col("a").alias("node")), "open-texts")
            more = self.confirm(named.select("a", "b").distinct(), texts, "open-links")
            roots = component_roots(star(roots).unionAll(more), work, "second")
            refuted = work.write(named.join(more, ["a", "b"], "left_anti").distinct(), "refuted")
            # Where all that a bucket named was confirmed, whatever might be linked there is joined.
            doubtful = buckets.join(refuted.select("bucket").distinct(), "bucket", "left_semi")
            if not refuted.isEmpty():
                rest = self.open_pairs(doubtful, roots, True, "rest").select("a", "b").distinct()
                rest = work.write(rest.join(refuted.select("a", "b").distinct(), ["a", "b"], "left_anti"), "rest-pairs")
                if not rest.isEmpty():
                    last = self.confirm(rest, texts, "rest-links")
                    if not last.isEmpty():
                        roots = component_roots(star(roots).unionAll(last), work, "third")
            work.drop("open-texts")
        work.drop("buckets")
        return roots

    def rows(self) -> DataFrame:
        """doc_id, text_hash, n_shingles, first (the least doc_id of the texts linked with the row's), kept (one row of these; null where nothing can link)."""
        node = self.classes.select("node", "digest", "first").join(self.components(), "node", "left").withColumn("root", F.coalesce("root", "node"))
        groups = node.groupBy("root").agg(F.min("first").alias("keeper"))
        of_class = node.join(groups, "root").select("digest", "keeper")
        can = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
        linked = self.signatures.where(can).select("doc_id", "text_hash", "n_shingles", "digest").join(of_class, "digest")
        own = (F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
        linked = linked.select("doc_id", "text_hash", "n_shingles", F.col("keeper.doc_id").alias("first"), own.alias("kept"))
        rest = self.signatures.where(~can).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("first"), F.lit(None).cast("boolean").alias("kept"))
        out = self.work.write(linked.unionAll(rest), "rows")
        for name in ("signatures", "classes"):
            self.work.drop(name)
        return out


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; links where the sets' similarity is ``percent`` % or more."""
    search = _Search(docs, percent, id_col, text_col)
    rows = search.rows()
    # Only an id that comes with several texts can tie groups together.
    ties = rows.groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
    ties = search.work.write(ties.select("doc_id", "low"), "ties")
    component = F.col("first")
    if not ties.isEmpty():
        edges = rows.select("doc_id", "first").join(ties, "doc_id").select("first", "low")
        roots = component_roots(edges, search.work, "ids")
        rows = rows.join(roots.select(F.col("node").alias("first"), "root"), "first", "left")
        component = F.coalesce("root", "first")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first_of_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that come first among the texts linked with theirs; one row of those that repeat an id and its text.

    An id that comes with unrelated texts keeps one row for each of them.  Rows without words or with a null id all stay.
    """
    search = _Search(docs, percent, id_col, text_col)
    drop = search.rows().where("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    names = docs.columns
    # Columns of our own are put under names that the table can't hold beside its own.
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_hash"))
    same = (F.col("own_id") == F.col("id")) & (F.col("own_hash") == F.col("hash"))
    # The ids are built into a hash table and the texts streamed past, not sorted.
    first = plain.join(drop.hint("shuffle_hash"), same, "left_anti")
    if search.repeats:
        again = search.repeated.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        once = first.join(again.hint("shuffle_hash"), same, "left_anti")
        first = once.unionByName(first.join(again.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["own_id", "own_hash"]))
    return first.select(*(F.col(f"row.`{c}`").alias(c) for c in names))
