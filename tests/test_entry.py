import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        out.append(tuple(f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00") for v in (r[i] for i in order)))
    return sorted(columns), sorted(out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_every_query_is_callable_and_every_oracle_has_one():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(map(callable, entry.queries().values()))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_evidence_link_wants_whole_items(spark, tmp_path):
    item = "in the beginning of this item there are many words that a text may hold, but not its very end"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, item[:70]), (2, f"so {item}.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in queries.QUERIES["evidence_link"](spark, str(tmp_path)).collect()] == [(1, 2)]
