import pytest

from tests.oracle import compare
from vigilake.plans import catalog

SLOW = ("rules_", "classify_mixed", "parse_", "helper_ip")
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith(SLOW)])
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", ["rules_okta", "rules_slack", "parse_alb", "parse_vpcflow", "parse_s3access", "parse_aurora", "parse_cloudtrail_roundtrip"])
def test_slower_query_equals_its_sql(spark, small, name):
    compare(spark, small, catalog.queries()[name], SQL[name])


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1


def test_slack_escaping_covers_whole_texts(spark, small):
    escaped = {r.doc_id: r.safe for r in catalog.queries()["helper_slack_text_whole"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert any(set("&<>") & set((r.text or "")[60:]) for r in rows)
    assert escaped == {r.doc_id: r.text and r.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for r in rows}


def test_full_join_covers_whole_tables(spark, small):
    got = catalog.queries()["sql_join_full_whole"](spark, small).collect()
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        assert sorted(r[key] for r in got if r[key] is not None) == sorted(r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect())
    assert any(r.s_suppkey is None for r in got)
