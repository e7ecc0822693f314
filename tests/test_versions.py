"""Reads as of a sequence number for each key."""

import duckdb

from tidelog.operators import reads
from tidelog.plans import catalogue


def test_each_probe_reads_its_own_version(spark):
    log = spark.createDataFrame([("a", "1", 0, 1), ("a", None, 1, 4), ("a", "3", 0, 6), ("b", "4", 0, 3)], "key string, value string, op int, seq long")
    probes = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("a", 3), ("a", 4), ("a", 9), ("b", 2), ("b", 3), ("c", 9), (None, 1)], "key string, seq long")
    got = sorted((r.key or "", r.seq, r.status, r.value) for r in reads.multi_get_as_of(log, probes).collect())
    assert got == [("", 1, 2, None), ("a", 0, 2, None), ("a", 1, 0, "1"), ("a", 3, 0, "1"), ("a", 3, 0, "1"), ("a", 4, 1, None), ("a", 9, 0, "3"),
                   ("b", 2, 2, None), ("b", 3, 0, "4"), ("c", 9, 2, None)]


def test_pages_that_share_an_address(spark, tmp_path):
    rows = [(i, f"http://x/{i // 3}", f"<p>{i}</p>") for i in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["key", "status", "n_bytes", "value_md5"]
    want = con.sql(catalogue.ORACLES["page_store_get"]).select(*columns).fetchall()
    got = catalogue.QUERIES["page_store_get"](spark, str(tmp_path)).select(*columns).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(want)
