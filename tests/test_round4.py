"""Nearest targets: tasks follow the rows, and unknown distances come last as in SQL."""

import duckdb

from stormframe import queries, session


def test_ambiguity_links_deal_tasks_by_rows(spark, tmp_path, monkeypatch):
    spark.range(900).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    items = ["id % 1000 AS l_orderkey", "CAST(id % 7 AS int) AS l_linenumber", "IF(id % 11 = 0, NULL, CAST(id * id % 53 AS double)) AS l_quantity"]
    spark.range(3500).selectExpr(*items).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["ambiguity_links"]).fetchall(), key=str)
    assert len(want) > 300
    for rows in (session.ROWS, 100):
        monkeypatch.setattr(session, "ROWS", rows)
        out = queries.ambiguity_links(spark, str(tmp_path))
        assert sorted((tuple(x) for x in out.collect()), key=str) == want
    assert out.rdd.getNumPartitions() == 44
