"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = tables.sql(catalog.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_searches_run_every_query(spark, tables):
    every = {r[0] for r in tables.sql("select vec_id from embeddings where vec_id % 50 = 0").fetchall()}
    assert len(every) > 1 and {r.query_id for r in catalog.QUERIES["dense_topk"](spark, SF).collect()} == every
    items = tables.sql("select count(distinct item_id) from benchmark b join documents d on contains(d.text, b.text)").fetchall()[0][0]
    assert catalog.QUERIES["recall_and_mrr"](spark, SF).first()["cases"] == items


def test_whole_tables_reach_the_operators(spark, tables):
    edges = "select distinct l_orderkey, l_partkey from lineitem where l_returnflag <> 'R'"
    for name, sql in (
        ("dependents_of", edges),
        ("dependencies_of", "from lineitem"),
        ("route_callers", "from lineitem"),
        ("declaration_overlap", "from orders"),
        ("staleness_flag", "from documents"),
        ("modal_density", "from documents"),
    ):
        assert catalog.QUERIES[name](spark, SF).count() == len(tables.sql(sql).fetchall()), name


@pytest.mark.parametrize("name", ["fitted_vectors", "matryoshka_truncate", "reprojected_points"])
def test_rounding_keeps_the_sign_of_zero(spark, tmp_path, name):
    rows = [(1, [-0.000001, 0.000001, -0.0, 0.0, 1.0] + [0.1] * 59), (2, [0.25, -0.75, -0.0000004] + [0.5] * 61)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(catalog.SQL[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda r: str(sorted(r.items()))  # tells -0.0 from 0.0
    assert sorted(key(r.asDict()) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(map(key, want)) and "-0.0," in str(want)


def test_sentences_keep_the_digits_of_their_place(spark, tmp_path):
    rows = [(1, "Version 2.00. " + "1 word 1. " * 3 + "word " * 100 + "2. 3" + "y" * 30), (2, "0. 1. 2. 3"), (3, None)]
    rows += [(10 + i, "x" * i + "0. " + "word " * 99 + "b. c") for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(catalog.SQL["text_pack"])
    got = catalog.QUERIES["text_pack"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
