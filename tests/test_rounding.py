"""Ratios that are ties in decimal but not in binary, against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from graphloom import oracles, queries


def test_ratios_near_ties(spark, tmp_path):
    days = [(f"2024-{1 + k % 12:02d}-01", f"{1 + k // 12}-P", 640.0 + k) for k in range(60)]
    orders = spark.createDataFrame([(k, 0, d, p, t) for k, (d, p, t) in enumerate(days)], "o_orderkey long, o_custkey long, day string, o_orderpriority string, o_totalprice double")
    orders.withColumn("o_orderdate", F.to_timestamp("day")).drop("day").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "A")], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = {(r[1], r[2]): r[4] for r in con.execute(oracles.oracle_sql()["normalised_times"]).fetchall()}
    got = {(r["method"], r["run"]): r["normal"] for r in queries.QUERIES["normalised_times"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 60
    assert want[("1", 2024 * 12 + 2)] == 1.001562  # 641 / 640 = 1.0015625
