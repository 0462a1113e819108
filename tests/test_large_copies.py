"""Queries against their SQL on tables as they are repeated with shifted keys, and with equal places."""

import duckdb
import pytest

from gridmark.plans import registry
from tests.test_queries import plain


def same_as_sql(spark, name, path):
    con = duckdb.connect()
    for t in ("supplier", "events"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    cur = con.execute(registry.ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)
    assert want
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("copies")
    spark.createDataFrame([(n,) for n in (0, 899, 900, 9899, 9900, 9901, 59998, 59999, 123456)], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    # of each page, titles that stand at the same place in an order that is not that of their numbers
    kinds = ["signup", "signup", "click", "view"]
    rows = [((7 * i) % 4001 * 1000 + i % 3 * 250, i % 5, kinds[i % 4], float(i % 11) * 30.0) for i in range(4001)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(5).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["read_plan_beams", "read_shop_beams"])
def test_beams_of_suppliers_with_long_numbers(spark, copies, name):
    same_as_sql(spark, name, copies)


def test_titles_at_the_same_place_in_order_of_their_numbers(spark, copies):
    same_as_sql(spark, "widest_gap_split", copies)
