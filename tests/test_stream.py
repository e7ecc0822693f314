from tidelog.operators.reads import latest
from tidelog.streaming import ingest

LOG = "key string, value string, op int, seq long"


def test_late_and_repeated_operations_lose(spark, tmp_path):
    rows = [[("a", "new", 0, 9), ("b", "x", 0, 2)], [("a", "old", 0, 1), ("b", None, 1, 3)], [("a", "new", 0, 9)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for run, how in enumerate((ingest.append_newest, ingest.append_changes)):
        out = str(tmp_path / f"out{run}")
        how(ingest.source(spark, str(tmp_path / "in")), out, str(tmp_path / f"checkpoint{run}")).awaitTermination()
        assert sorted(map(tuple, latest(spark.read.parquet(out)).collect())) == [("a", "new", 0, 9), ("b", None, 1, 3)]
        # a second run finds nothing new
        how(ingest.source(spark, str(tmp_path / "in")), out, str(tmp_path / f"checkpoint{run}")).awaitTermination()
        assert latest(spark.read.parquet(out)).count() == 2
