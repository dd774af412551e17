"""Ordinal quality classifier: cumulative-link regression on hashed text.

Graded ratings are modelled as P(grade <= k) = sigmoid(cut[k] - score(text)),
with one shared weight vector for the score and ordered cut points.  The score
is the sum of the weights of the text's distinct hashed features: its words in
lower case (runs of letters and digits), their beginnings, and its style, that is, how large a
part of the text each shape of token and repeated words are.  The model gives every document an expected grade and the probability of
reaching a grade, which decides the selection.

The labelled rows for the fit are a sample of at most ``SAMPLE`` documents with
``SAMPLE_FEATURES`` feature numbers together, the first in the order of a hash
of their id; everything else (features, scores, selection) covers all rows.
Only grades and feature numbers of the sample come to the driver.

Defined results: null, empty and blank texts have no features and get the
model's intercept; labels without a document, with a null or with two grades
for one id aren't fitted; with fewer than two grades to fit, every document
gets the one grade there is (0 without any) and is kept; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread
from .textkit import hash_words, mix64, slices, text_chunks, tidied, word_bounds

BITS = 20
#: The most labelled documents that are fitted.
SAMPLE = 12_000
#: The most feature numbers of these together (4 bytes each).
SAMPLE_FEATURES = 50_000_000
#: The sample comes to the driver in 2^PART_BITS parts.
PART_BITS = 6
#: Bytes of a longer word that are a feature of their own.
STEMS = (4, 5)
EPOCHS, BATCH, RATE, CUT_RATE, PENALTY, BALANCE = 12, 32, 2.0, 0.3, 2.0, 0.3

_LETTER, _CAPITAL, _DIGIT, _MARK = 1, 2, 4, 8
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = _LETTER
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _CAPITAL
_KIND[[ord(c) for c in "0123456789"]] = _DIGIT
_KIND[128:] = _LETTER
_INNER = (_KIND != _MARK).astype(np.int8)


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits."""
    step = np.diff(_INNER[data], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    for begin, end in text_chunks(raw):
        part = raw[begin:end]
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        small = np.frombuffer(b"\n".join(t.lower() for t in part) + b"\n", dtype=np.uint8)
        starts, ends = _runs(data)
        words = hash_words(small, starts, ends)
        stems = [np.where(ends - starts > n, hash_words(small, starts, np.minimum(starts + n, ends)) ^ np.uint64(n), words) for n in STEMS]
        spots, stops = word_bounds(data)
        # Every other range is a token, those between are the blanks; the text's last byte is a blank.
        kinds = np.bitwise_or.reduceat(_KIND[data], np.column_stack([spots, stops]).ravel())[::2] if len(spots) else np.empty(0, np.uint8)
        # The token's kinds of characters, and whether it starts and ends in a mark.
        shapes = kinds.astype(np.int64) << 2 | (_KIND[data[spots]] == _MARK).astype(np.int64) << 1 | (_KIND[data[stops - 1]] == _MARK)
        limits = np.cumsum([len(t) + 1 for t in part])
        at = seen = 0
        for to, upto in zip(np.searchsorted(starts, limits), np.searchsorted(spots, limits), strict=True):
            w, n = words[at:to], upto - seen
            # Style: how common each shape and repeated words are, in eighths of the text.
            style = np.bincount(shapes[seen:upto], minlength=64)
            style = np.append(style, [np.count_nonzero(w[1:] == w[:-1]), len(w) - len(np.unique(w))]) * 8 // max(n, 1)
            own = mix64((np.arange(66) * 64 + np.minimum(style, 63)).astype(np.uint64)[style > 0] + np.uint64(0x5A17 << 32))
            yield np.unique((np.concatenate([w, own, *(x[at:to] for x in stems)]) >> np.uint64(64 - BITS)).astype(np.int64))
            at, seen = to, upto


@dataclass
class OrdinalModel:
    """Shared weights, ordered cuts between the grades, and the grades."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: list[int]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: list[int]) -> OrdinalModel:
    """Maximum likelihood by follow-the-regularised-leader with an absolute penalty, in a fixed order.

    The penalty leaves features out that tell nothing, so long texts don't gather noise.
    """
    levels = sorted(set(grades))
    if len(levels) < 2:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.empty(0), levels or [0])
    y = np.searchsorted(levels, grades)
    order = np.random.default_rng(7).permutation(len(rows))
    # Rare grades weigh more, though not as much as common ones altogether.
    share = (len(y) / (len(levels) * np.bincount(y))) ** BALANCE
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    at_most = np.cumsum(np.full(len(levels), 1 / len(levels)))[:-1]
    cuts, cut_n = np.log(at_most / (1 - at_most)), np.full(len(levels) - 1, 1e-2)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for _ in range(EPOCHS):
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            ids, who = np.concatenate([rows[i] for i in batch]), np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            s, k = np.bincount(who, w[ids], minlength=len(batch)), y[batch]
            edge = np.concatenate([[-1e9], cuts, [1e9]])
            upper, lower = sig(edge[k + 1] - s), sig(edge[k] - s)
            p = np.maximum(upper - lower, 1e-9)
            du, dl, each = upper * (1 - upper) / p, lower * (1 - lower) / p, share[k]
            hit, back = np.unique(ids, return_inverse=True)
            g = np.bincount(back, (each * (du - dl))[who], minlength=len(hit)) / len(batch)
            step = (np.sqrt(n[hit] + g * g) - np.sqrt(n[hit])) / RATE
            z[hit] += g - step * w[hit]
            n[hit] += g * g
            zero = np.maximum(np.abs(z[hit]) - PENALTY, 0)
            w[hit] = -np.sign(z[hit]) * zero * RATE / (1 + np.sqrt(n[hit]))
            g = np.bincount(k, -each * du, minlength=len(levels))[:-1] + np.bincount(k, each * dl, minlength=len(levels))[1:]
            g /= len(batch)
            cut_n += g * g
            cuts = np.sort(cuts - CUT_RATE * g / np.sqrt(cut_n))
    return OrdinalModel(w.astype(np.float32), cuts, levels)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        ids = pa.array([i.astype(np.int32) for i in features(batch.column(2).to_pylist())], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["place", "grade", "ids"])


def train(docs: DataFrame, labels: DataFrame, grade, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit the column expression ``grade`` of ``labels`` on the documents of the same id."""
    rated = labels.select(F.col(id_col).alias("rated_id"), grade.cast("int").alias("grade")).where("rated_id is not null and grade is not null")
    rated = rated.groupBy("rated_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("top")).where("grade = top").drop("top")
    picked = rated.withColumn("place", F.xxhash64("rated_id")).orderBy("place", "rated_id").limit(sample)
    # At most ``sample`` ids and grades: proven small.
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    known = texts.join(F.broadcast(picked), F.col("own_id") == F.col("rated_id")).select("place", "grade", "own_text")
    rows = spread(known).mapInArrow(tidied(_features_of), "place long, grade int, ids array<int>")
    # In the order of the hashes, a part of the sample at a time: the hashes' leading bits number the partitions.
    part = (F.shiftright("place", 64 - PART_BITS) + (1 << (PART_BITS - 1))).cast("int")
    rows = rows.repartitionById(1 << PART_BITS, part).sortWithinPartitions("place", "grade", "ids")
    got, held = [], 0
    for r in rows.toLocalIterator():
        ids = np.asarray(r["ids"], np.int32)
        held += len(ids)
        if got and held > SAMPLE_FEATURES:
            break
        got.append((r["grade"], ids))
    # Sorted, so that the fit doesn't hang on the order in which tasks end.
    got.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit([i for _, i in got], [g for g, _ in got])


def _scorer(docs: DataFrame, model: OrdinalModel, least_grade: int, least_probability: float):
    """In a task, makes a function from texts to expected grades, tail probabilities and decisions."""
    # 4 MB of weights, whatever the corpus.
    weights, cuts, grades = docs.sparkSession.sparkContext.broadcast(model.weights), model.cuts, np.array(model.grades, dtype=float)
    cut = int(np.searchsorted(grades, least_grade))

    def judge():
        m = OrdinalModel(weights.value, cuts, list(grades))

        def decide(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s = np.array([float(m.weights[i].sum(dtype=np.float64)) for i in features(texts)])
            tails = m.tails(s) if len(s) else np.empty((0, len(cuts)))
            tail = tails[:, cut - 1] if 0 < cut <= len(cuts) else np.full(len(s), 1.0 if cut == 0 or not len(cuts) else 0.0)
            return grades[0] + tails @ np.diff(grades), tail, tail >= least_probability

        return decide

    return judge


def score(docs: DataFrame, model: OrdinalModel, least_grade: int, least_probability: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept): kept where P(grade >= least_grade) reaches the probability."""
    judge = _scorer(docs, model, least_grade, least_probability)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, decide(batch.column(1).to_pylist()))], names=["doc_id", "expected_grade", "tail_probability", "kept"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(tidied(run), f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def accepted(docs: DataFrame, model: OrdinalModel, least_grade: int, least_probability: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` keeps; rows are filtered where they are read."""
    judge = _scorer(docs, model, least_grade, least_probability)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for batch in (part for whole in batches for part in slices(whole)):
            yield batch.filter(pa.array(decide(batch.column(at).to_pylist())[2], pa.bool_()))

    return spread(docs).mapInArrow(tidied(run), docs.schema)


def rating():
    """The grade of a row of ``labels``: 0 poor, 1 well written but toxic, 2 well written and clean."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
