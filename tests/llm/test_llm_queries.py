"""The registered queries: against SQL where there is some, and by their own rules on the smallest tables where not."""

import zlib
from collections import defaultdict

import duckdb
import pytest

from platewright.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    values = pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()
    return cols, sorted(str(tuple(map(plain, r))) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_all_rows_come_back(spark, duck):
    n = {t: duck.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("documents", "pages")}
    for name, q in QUERIES.items():
        got = q(spark, SF)
        if name.startswith("op6"):
            assert got.select("doc_id").distinct().count() == n["documents"]
        else:
            assert got.count() == n["pages" if name.split("_")[0] in ("op3", "op9") else "documents"], name


def test_toxicity_contract(spark):
    out = QUERIES["op5_toxicity"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_sharding_contract(spark):
    out, slots = QUERIES["op8_sharding"](spark, SF).collect(), defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
