"""The registered highlight marks what its statement marks; the operator marks every match."""

from __future__ import annotations

import duckdb

from lexigrain.operators import concord
from lexigrain.plans import spans as sp
from lexigrain.plans.queries import ORACLES, QUERIES, corpus


def test_highlight_of_neighbours_equals_the_statement(spark, tmp_path):
    texts = ["Reth reth", "a reth reth RETH reth.", "reth  reth,reth x reth reth", "reth - reth", "rethe reth", "none"]
    spark.createDataFrame([(i, t, "fr", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.doc_id, r.html) for r in QUERIES["highlight"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["highlight"]).fetchall())
    c = corpus(spark, str(tmp_path))
    every = {r.doc_id: r.html for r in concord.highlighted(c, sp.find(c, "reth")).collect()}
    assert every[0] == "<mark>Reth</mark> <mark>reth</mark>" and every[1].count("<mark>") == 4
