"""Kinds and roles of a document table's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KINDS = ("text", "number", "category", "facet", "vector", "stored")


@dataclass(frozen=True)
class FieldSpec:
    """A column and what it is; roles are found from these."""

    name: str
    kind: str

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")


def inferred(schema: T.StructType, texts: tuple[str, ...] = ("text",), stored: tuple[str, ...] = ()) -> dict[str, FieldSpec]:
    """The kind of every column: named texts, numbers, arrays of strings as facets, arrays of numbers as vectors, other strings as categories."""
    out = {}
    for f in schema.fields:
        kind = f.dataType
        if f.name in stored:
            what = "stored"
        elif isinstance(kind, T.StringType):
            what = "text" if f.name in texts else "category"
        elif isinstance(kind, T.ArrayType):
            what = "facet" if isinstance(kind.elementType, T.StringType) else "vector" if isinstance(kind.elementType, T.NumericType) else "stored"
        elif isinstance(kind, T.NumericType):
            what = "number"
        else:
            what = "stored"
        out[f.name] = FieldSpec(f.name, what)
    return out


def role(fields: dict[str, FieldSpec], name: str, configured: str | None = None) -> str | None:
    """The column of the role ``content`` or ``year``: the configured one, one of the usual name, or the first of its kind."""
    kind, usual = {"content": ("text", ("text", "content")), "year": ("number", ("year",))}[name]
    if configured is not None:
        if configured not in fields or fields[configured].kind != kind:
            raise ValueError(f"{configured!r} can't be the {name} column")
        return configured
    for candidate in usual:
        if candidate in fields and fields[candidate].kind == kind:
            return candidate
    return next((f.name for f in fields.values() if f.kind == kind), None)
