"""Word vectors in the binary word2vec format, and as Parquet."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_binary(df: DataFrame, path: str, word: str = "name", vector: str = "coords") -> int:
    """Write (word, vector) rows in their order, streamed through the driver; blanks in words become underscores."""
    n, dim = df.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    with open(path, "wb") as f:
        f.write(f"{n} {dim}\n".encode())
        for row in df.select(word, vector).toLocalIterator():
            f.write("_".join(row[0].split()).encode() + b" " + np.asarray(row[1], dtype="<f4").tobytes() + b"\n")
    return n


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a binary file that fits the driver; use Parquet for larger models."""
    data = Path(path).read_bytes()
    head, _, body = data.partition(b"\n")
    n, dim = map(int, head.split())
    rows, at = [], 0
    for _ in range(n):
        end = body.index(b" ", at)
        rows.append((body[at:end].decode(), np.frombuffer(body, "<f4", dim, end + 1).tolist()))
        at = end + 1 + 4 * dim
        if body[at : at + 1] == b"\n":
            at += 1
    return spark.createDataFrame(rows, "word string, vector array<float>")
