"""All registered queries against their SQL, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (float, Decimal)):
        return round(float(value), 9)
    return value


@pytest.mark.parametrize("name", sorted(set(entry().queries()) & set(entry().oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = entry().queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(entry().oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    spark.catalog.clearCache()
    assert got == want


def test_appended_texts_are_whole(spark):
    from collections import defaultdict

    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want, begin = defaultdict(str), {}
    for r in turns:
        if r.role == "user" and r.text:
            begin[r.conv_id] = r.turn
        if r.conv_id in begin:
            want[r.conv_id, begin[r.conv_id]] += r.text or ""
    got = {(r.conv_id, r.turn): r.said for r in entry().queries()["text_append"](spark, SF).collect()}
    assert got == want and max(map(len, got.values())) > 255


@pytest.mark.parametrize("name", ["drawing_kinds", "payload_files", "hotspot_files", "snapshot_fields", "decode_reports"])
def test_written_files_are_not_listed_by_the_driver(spark, name):
    """A file a document: a plan that lists them grows with the documents, in memory and in tasks of a few files each."""
    found = entry().queries()[name](spark, SF)
    assert not [f for f in found.inputFiles() if not f.endswith(".parquet")]
    assert found.count() == spark.read.parquet(f"{SF}/part.parquet").count()


@pytest.mark.parametrize("made", ["_mixed", "_celled"])
def test_documents_of_a_small_table_are_made_in_many_tasks(spark, made):
    from glyphlake.plans import element_queries

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert getattr(element_queries, made)(spark, SF).rdd.getNumPartitions() == n > 1


def test_entry(spark):
    df = entry().entry(spark)
    assert df.count() > 0 and "source_tag" in df.columns


def test_sql_has_queries():
    assert set(entry().oracle_sql()) <= set(entry().queries())
