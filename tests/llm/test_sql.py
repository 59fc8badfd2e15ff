"""Queries against their DuckDB SQL, on the given tables and on documents made for it."""

import random

import duckdb
import pandas as pd
import pytest

from symquarry.llm import secrets
from symquarry.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def canon(frame):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def same(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canon(ours) == canon(theirs)
    return ours


@pytest.mark.parametrize("name,tables", [("op1_mixing", ["documents"]), ("op6_secrets", ["documents"]), ("op8_decontaminate", ["documents", "benchmark"]), ("op9_warc", ["pages"])])
def test_given_tables(spark, name, tables):
    same(spark, name, SF, tables)


def test_made_secrets(spark, tmp_path):
    rng = random.Random(21)
    words = ["password", "Secret", "api_key", "token", "AKIA", "example", "EXAMPLE", "some", "Path", "I", "x"]
    signs = ["=", ":", " ", "'", '"', "/", "-", "_", "+", ".", "\n", "é", " : "]

    def piece():
        kind = rng.randint(0, 5)
        if kind == 0:
            return rng.choice(words)
        if kind == 1:
            return rng.choice(signs)
        alphabet = (secrets.HEX_CHARS, secrets.KEY_CHARS, "ABCDEF0123456789", "abcdefgh")[rng.randint(0, 3)]
        return "".join(rng.choice(alphabet) for _ in range(rng.choice([3, 8, 19, 20, 24, 40])))

    texts = ["".join(piece() for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "123e4567-e89b-12d3-a456-426614174000", "ab/" * 20_000 + "1", "abcdefgh" * 2000 + "1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "parts"))
    spark.read.parquet(str(tmp_path / "parts")).toPandas().to_parquet(tmp_path / "documents.parquet")
    found = same(spark, "op6_secrets", str(tmp_path), ["documents"])
    assert found.spans.str.contains("entropy").sum() > 50 and found.n_hex.sum() > 20 and found.n_access.sum() and found.n_assign.sum()
