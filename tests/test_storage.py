import time
from pathlib import Path

from pyspark.sql import functions as F

from corvane.functions import storage


def test_shuffle_files_go_once_a_table_is_written(spark, monkeypatch):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    at = list(env.blockManager().diskBlockManager().localDirsString())
    held = lambda: {p for d in at for p in Path(d).rglob("shuffle_*.data")}
    before = held()
    monkeypatch.setattr(storage, "COLLECT_EVERY", 3600)
    storage.materialize(spark.range(1000).repartition(3, "id"), "once")
    first = held() - before
    assert first
    monkeypatch.setattr(storage, "COLLECT_EVERY", 0)
    storage.materialize(spark.range(1000).repartition(3, "id"), "twice")
    until = time.time() + 20
    while held() & first and time.time() < until:
        time.sleep(0.2)
    assert not held() & first


def test_rows_are_counted_by_the_run_that_writes_them(spark):
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = ran()
    table, n, even = storage.counted(spark.range(1000).repartition(3, "id"), "counted", F.col("id") % 2 == 0)
    assert (n, even) == (1000, 500) and ran() - before == 1
    assert table.count() == 1000
    assert storage.counted(table.where("id < 0"), "none", F.col("id") % 2 == 0)[1:] == (0, 0)
    assert storage.counted(spark.createDataFrame([], "id long"), "none")[1] == 0
