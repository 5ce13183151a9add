"""Every query with SQL against DuckDB over the smallest tables, and row checks of the others."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from quireflow.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, datetime.date):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in SQL:
        rel = duck.sql(SQL[name])
        at = rel.columns
        assert sorted(at) == cols
        assert rows == sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in rel.limit(10**9).fetchall()), key=repr)


#: Titles with white space of many kinds, and (kind, ident, lexical) of each.
ODD_TITLES = {
    "제2장\u202f남은 화면": ("chapter", "2", "남은 화면"),
    "3장\u2005\u3000색인\xa0폴더\u2009": ("chapter", "3", "색인\xa0폴더"),
    "제4장\t끝": ("chapter", "4", "\t끝"),
    "A.1\xa0나무": ("section", "A.1", "나무"),
    "\xa0제5장 잎\u202f": ("chapter", "5", "잎"),
    "Chapter\x0b6 Wood": ("plain", None, "Chapter\x0b6 Wood"),
    "Wood *\u2028": ("plain", None, "Wood *\u2028"),
    "Wood\t|": ("plain", None, "Wood\t"),
    "| 연습 문제 |": ("plain", None, "연습문제"),
    "내 연습문제|": ("plain", None, "내 연습문제|"),
    "\u3000": ("plain", None, ""),
}


def test_heading_identity_of_odd_titles(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD_TITLES)), "entry_id long, title string").selectExpr(
        "*", *[f"CAST(NULL AS STRING) AS {c}" for c in "run_id doc_key toc_page printed_page folio_style folio_value kind ident chapter raw_rank page".split()]
    ).write.parquet(f"{tmp_path}/entries.parquet")
    want = [(k, *v) for k, v in enumerate(ODD_TITLES.values())]
    con = duckdb.connect()
    con.sql(f"create view entries as select * from '{tmp_path}/entries.parquet/*.parquet'")
    assert sorted(con.sql(SQL["heading_identity"]).fetchall()) == want
    assert sorted(map(tuple, QUERIES["heading_identity"](spark, str(tmp_path)).collect())) == want
