"""Part-of-speech tags as numbers: the high half byte is the group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUPS = {
    "PUNCT": 0x00, "VERB": 0x10, "NOUN": 0x20, "ADJ": 0x30, "PROPN": 0x40, "ADV": 0x50, "DET": 0x60, "PRON": 0x70, "CONJ": 0x80, "ADP": 0x90, "NUM": 0xA0, "INTJ": 0xB0, "X": 0xF0,
}


def in_group(tag: Column, group: str) -> Column:
    return tag.bitwiseAND(0xF0) == GROUPS[group]


@dataclass(frozen=True)
class TagSet:
    """A set of tags out of 256, as an immutable value."""

    tags: frozenset[int] = frozenset()

    def with_tag(self, tag: int) -> TagSet:
        return TagSet(self.tags | {tag})

    def without_tag(self, tag: int) -> TagSet:
        return TagSet(self.tags - {tag})

    def with_group(self, group: str) -> TagSet:
        return TagSet(self.tags | set(range(GROUPS[group], GROUPS[group] + 16)))

    def without_group(self, group: str) -> TagSet:
        return TagSet(self.tags - set(range(GROUPS[group], GROUPS[group] + 16)))

    def cardinality(self, include: TagSet | None = None, exclude: TagSet | None = None) -> int:
        tags = self.tags if include is None else self.tags & include.tags
        return len(tags if exclude is None else tags - exclude.tags)

    def test(self, tag: Column) -> Column:
        return tag.isin(sorted(self.tags)) if self.tags else F.lit(False)
