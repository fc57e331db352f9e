"""Queries whose results DuckDB makes from their SQL, on the given tables and on awkward ones."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from terracell.llm import registry

SF = "/root/testdata/sf0.001"
NAMES = ("op6_ngram_join", "op11_importance_resampling", "op12_minhash_dedup")
LINE = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, None), (2, ""), (3, " \t\r\n\v\f "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "one two three"), (9, "één twee ÉÉN 中 \U0001f600 three"),
    (10, LINE), (11, LINE.upper()), (12, LINE), (12, LINE), (13, LINE + " more"), (14, LINE + " some more words than before"), (15, "x" * 30_000), (16, "again and again " * 3_000), (17, "again and again " * 3_001),
    (None, LINE + " none"), (None, "no id here " * 30), (None, "no id here " * 30), (None, None), (18, "a-b_c.d,e " * 9), (19, "a b c d e " * 9), (20, "tab\tand\x0bvertical tab\x1cand a separator" * 5),
    *((100 + i, f"copy of many words that all say nearly the same thing again number {i % 4} " + LINE) for i in range(30)),
]


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    root = tmp_path_factory.mktemp("awkward")
    docs = pa.table({"doc_id": pa.array([i for i, _ in DOCS], pa.int64()), "text": pa.array([t for _, t in DOCS], pa.string())})
    pq.write_table(docs, f"{root}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, None], pa.int64()), "text": ["one two three", "copy of many words", None]}), f"{root}/benchmark.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), f"{root}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), f"{root}/benchmark.parquet")
    return str(root)


def agree(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expect, got = con.execute(registry.oracle_sql()[name]), registry.queries()[name](spark, folder)
    assert [d[0] for d in expect.description] == got.columns
    rows = got.collect()
    assert sorted(map(tuple, rows), key=str) == sorted(expect.fetchall(), key=str)
    return len(rows)


@pytest.mark.parametrize("name", NAMES)
def test_given_table(spark, name):
    assert agree(spark, name, SF) == 200


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, name):
    assert agree(spark, name, awkward) == len(DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert agree(spark, name, empty) == 0
