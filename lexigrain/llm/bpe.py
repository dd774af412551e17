"""Byte-pair encoding over a trie of distinct words, and decoding.

In a byte-pair vocabulary the encoding of a text ends in one particular token,
and dropping that token leaves the encoding of the rest.  So one token, the
last one, is the whole state of a prefix.  The distinct words of a batch are
inserted into a trie; a depth-first walk gives each node its last token from
its ancestors' last tokens; nodes that words share are computed once.  A word's
encoding is then read off backwards from its node.

The last token of a node is the one vocabulary entry that ends there and may
follow the last token of the node where it begins.  Whether a token may follow
another is decided from the two merge trees alone and remembered.

Texts are first cut at added special tokens, then into words by the
vocabulary's own pattern; both follow the tokenizers library exactly.

Defined results: null and empty texts have no tokens and decode to the empty
text; ids outside the vocabulary decode to nothing; invalid byte sequences
decode to U+FFFD; other columns pass through untouched, but a column that has the name
of a new one is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import spread
from .textkit import slices, tidied

#: Bytes of text whose distinct words share one trie.
TRIE_BYTES = 4 << 20
#: Word encodings that a task keeps from batch to batch.
KEEP_WORDS = 400_000
#: Decisions on pairs of tokens that a task keeps.
KEEP_PAIRS = 400_000
#: Rows that are held as Python objects at once.
ROWS = 2048

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        letters = _byte_letters()
        spelled = lambda s: bytes(letters[c] for c in s)
        ids = {spelled(s): i for s, i in model["vocab"].items()}
        self.left, self.right, self.rank, merges = {}, {}, {}, {}
        for rank, m in enumerate(model["merges"]):
            a, b = (spelled(x) for x in (m.split(" ") if isinstance(m, str) else m))
            whole = ids[a + b]
            merges.setdefault((ids[a], ids[b]), (rank, whole))
            if whole not in self.rank:
                self.left[whole], self.right[whole], self.rank[whole] = ids[a], ids[b], rank
        self.merges = merges
        # Only tokens that their own bytes encode to can ever come out.
        self.ids = {s: i for s, i in ids.items() if len(s) == 1 or (i in self.rank and self._whole(i))}
        self.longest = max(map(len, self.ids))
        self.pieces = dict(zip(ids.values(), ids, strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.pieces |= {i: b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in s) for s, i in self.special.items()}
        size = max(self.pieces) + 1
        self.table = [self.pieces.get(i, b"") for i in range(size)]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS).findall
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _whole(self, token: int) -> bool:
        return self._may_follow(self.left[token], self.right[token], self.rank[token])

    def _may_follow(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether merging leaves the border between a and b alone (up to merges of rank ``below``).

        Undo the latest merge on either side of the border again and again.  The pair of tokens that
        then touch there existed until that merge took place; had their own merge come first, the
        border would be gone.  Equal ranks go from left to right.
        """
        merges, rank = self.merges, self.rank
        until = (1 << 60) if below is None else 2 * below  # half steps: a merge to the left goes before an equal one
        while True:
            if (m := merges.get((a, b))) is not None and 2 * m[0] < until:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = min(until, 2 * ra), self.right[a]
            else:
                until, b = min(until, 2 * rb + 1), self.left[b]

    def _decide(self, key: int) -> bool:
        """Decide whether the token key % 2^32 may follow key // 2^32, and remember it."""
        if len(self.pairs) >= KEEP_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self._may_follow(key >> 32, key & 0xFFFFFFFF)
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The packed ids (little-endian, 32 bits) of distinct words.

        Sorted words arrive in the depth-first order of their trie, so the path from the root to the
        word before holds every node that the next word shares; new nodes are put below it.
        """
        ids, longest, pairs, decide = self.ids, self.longest, self.pairs, self._decide
        out = {}
        path, last, begin = b"", [-1], [0]  # of each node on the path: its last token and where that begins
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            shared, most = 0, min(len(path), len(raw))
            while shared < most and path[shared] == raw[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                # Only one start can be right, so the likeliest goes first: the token before, longer by a byte.
                start = begin[-1] if end > 1 else 0
                token = ids.get(raw[start:end]) if end - start <= longest else None
                if token is not None and (start == 0 or (ok := pairs.get(key := last[start] << 32 | token)) or (ok is None and decide(key))):
                    last.append(token)
                    begin.append(start)
                    continue
                for start in range(max(0, end - longest), end):
                    token = ids.get(raw[start:end])
                    if token is not None and (start == 0 or (ok := pairs.get(key := last[start] << 32 | token)) or (ok is None and decide(key))):
                        last.append(token)
                        begin.append(start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, tokens, at = raw, [], len(raw)
            while at:
                tokens.append(last[at])
                at = begin[at]
            tokens.reverse()
            out[word] = array("I", tokens).tobytes()
        return out

    def segments(self, text: str) -> list[str]:
        """The text between special tokens, and these, in turn."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split, fresh, known = [], set(), self.known
        for text in texts:
            parts = [self.words(s) if i % 2 == 0 else s for i, s in enumerate(self.segments(text))]
            split.append(parts)
            for p in parts[::2]:
                fresh.update(p)
        if len(known) > KEEP_WORDS:
            known.clear()
        known.update(self.encode_words(fresh.difference(known)))
        packed = {s: array("I", [i]).tobytes() for s, i in self.special.items()}
        get = known.__getitem__
        return [b"".join(b"".join(map(get, p)) if i % 2 == 0 else packed[p] for i, p in enumerate(parts)) for parts in split]

    def forget(self) -> None:
        """Give back what a task has remembered; workers live on between tasks."""
        self.known, self.pairs = {}, {}

    def decode(self, ids: Iterable[int]) -> str:
        table, size = self.table, len(self.table)
        try:
            raw = b"".join(map(table.__getitem__, ids))
        except IndexError:
            raw = b"".join(table[i] for i in ids if 0 <= i < size)
        return raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > TRIE_BYTES:
            yield texts[at:i]
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield texts[at:]


def _with_columns(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*names, *new])


def _without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in whatever case."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """Adds ``ids_col`` (array<int>), the ids of the whole text, and with ``check_col`` whether they decode to it again."""
    df = _without(df, ids_col, *([check_col] if check_col else []))
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    if check_col:
        schema = schema.add(check_col, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in (part for whole in batches for part in slices(whole, ROWS)):
            texts = [t or "" for t in batch.column(columns.index(text_col)).to_pylist()]
            packed = [x for part in _pieces(texts) for x in bpe.encode_batch(part)]
            ends, total = [0], 0
            for p in packed:
                ends.append(total := total + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(packed))])
            new = {ids_col: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
            if check_col:
                new[check_col] = pa.array([bpe.decode(array("I", p)) == t for p, t in zip(packed, texts, strict=True)], pa.bool_())
            yield _with_columns(batch, columns, new)
        bpe.forget()

    return spread(df).mapInArrow(tidied(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``, the text that the ids stand for, special tokens included; null ids give the empty text."""
    df = _without(df, text_col)
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in (part for whole in batches for part in slices(whole, ROWS)):
            # One row's ids at a time become Python numbers.
            rows = (x.values if x.is_valid else pa.array([], pa.int32()) for x in batch.column(columns.index(ids_col)))
            texts = [bpe.decode(x.drop_null().to_numpy(zero_copy_only=False).tolist()) for x in rows]
            yield _with_columns(batch, columns, {text_col: pa.array(texts, pa.string())})

    return spread(df).mapInArrow(tidied(run), schema)


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in (part for whole in batches for part in slices(whole, ROWS)):
            texts, n, ids, back = [t or "" for t in batch.column(1).to_pylist()], [], [], []
            for part in _pieces(texts):
                for packed in bpe.encode_batch(part):
                    tokens = array("I", packed)
                    n.append(len(tokens))
                    ids.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(tokens).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, F.col(text_col))).mapInArrow(tidied(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
