"""XML ingestion: books, chapters and typed fields to one table of documents."""

from __future__ import annotations

import glob
import re
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A document as the grammar delivers it: fields are (name, kind, value), in their order.
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("book_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("fields", T.ArrayType(FIELD))])
KINDS = ("text", "int", "store", "category", "facet")
_ID = "{http://www.w3.org/XML/1998/namespace}id"


@dataclass
class IngestConfig:
    """What to read: glob patterns, those left out, and derived text fields as {new name: source name}."""

    inputs: list[str]
    exclude: list[str] = field(default_factory=list)
    derived: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> IngestConfig:
        """From a file of ``entry`` elements with keys ``tei`` (required) and ``exclude``, one pattern a line."""
        entries = {e.get("key"): (e.text or "").split() for e in ElementTree.parse(path).getroot().iter("entry")}
        if not entries.get("tei"):
            raise ValueError("the key tei is missing")
        return cls(entries["tei"], entries.get("exclude", []))

    def files(self) -> list[str]:
        """The files in order, each once, hidden ones left out."""
        out = {f for p in self.inputs for f in glob.glob(p, recursive=True)} - {f for p in self.exclude for f in glob.glob(p, recursive=True)}
        return sorted(f for f in out if not re.search(r"(^|/)[._][^/]*$", f))


def _fields(node: ElementTree.Element) -> list[dict]:
    out = []
    for f in node.findall("{*}field"):
        kind = f.get("type", "store")
        if kind not in KINDS:
            raise ValueError(f"unknown field type {kind!r}")
        value = f.get("value")
        if value is None:
            value = (f.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in f)
        out.append({"name": f.get("name"), "kind": kind, "value": value})
    return out


def parse_documents(xml: bytes, stem: str) -> list[dict]:
    """The documents of one file: a book comes before its chapters, unnamed chapters are numbered."""
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("document type definitions aren't allowed")
    root, out = ElementTree.fromstring(xml), []
    local = lambda n: n.tag.rpartition("}")[2]
    nodes = list(root) if local(root) == "set" else [root]
    for node in nodes:
        kind = local(node)
        if kind == "book":
            book = node.get(_ID) or stem
            out.append({"id": book, "book_id": book, "type": "book", "ord": 0, "file": stem, "fields": _fields(node)})
            for i, c in enumerate(node.findall("{*}chapter"), 1):
                out.append({"id": c.get(_ID) or f"{book}-{i:02d}", "book_id": book, "type": "chapter", "ord": i, "file": stem, "fields": _fields(c)})
        elif kind in ("article", "document"):
            out.append({"id": node.get(_ID) or stem, "book_id": None, "type": "article", "ord": 0, "file": stem, "fields": _fields(node)})
        elif kind not in ("field",):
            raise ValueError(f"unexpected element {kind!r}")
    return out


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All documents of the files, one file to a task's row; Spark's reader opens them in whatever store they are."""
    files = spark.read.format("binaryFile").load(paths)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)

    return parsed(files.select("content", stem.alias("stem")))


def parsed(files: DataFrame) -> DataFrame:
    """All documents of rows (content, stem), XML as bytes and the name it is known by."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [d for c, s in zip(pdf["content"], pdf["stem"], strict=True) for d in parse_documents(bytes(c), s)]
            yield pd.DataFrame(rows, columns=DOCUMENT.fieldNames())

    return files.select("content", "stem").mapInPandas(run, DOCUMENT)


def typed(docs: DataFrame, name: str, kind: str) -> Column:
    """A field as a column: the first value of a category or stored field, all values of a facet, a number or NULL, texts joined."""
    values = F.transform(F.filter("fields", lambda f: f["name"] == name), lambda f: f["value"])
    if kind == "facet":
        return F.array_distinct(values)
    if kind == "int":
        return F.get(values, F.lit(0)).try_cast("int")
    if kind == "text":
        return F.array_join(values, "\n")
    return F.get(values, F.lit(0))


def corpus_table(docs: DataFrame, fields: dict[str, str], derived: dict[str, str] | None = None) -> DataFrame:
    """id, book_id, type, ord, file and one column per field; a derived field takes its source's text under its own name."""
    columns = [typed(docs, n, k).alias(n) for n, k in fields.items()]
    columns += [typed(docs, source, "text").alias(n) for n, source in (derived or {}).items()]
    return docs.select("id", "book_id", "type", "ord", "file", *columns)
