from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from waymark.operators.manifest import ManifestTable
from waymark.runtime import Files, cut, spread


def test_spread(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.range(1000, numPartitions=9)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 1000
    assert spread(many) is many


def test_files(spark, tmp_path):
    f = Files(spark, str(tmp_path))
    assert f.write_once(f"{tmp_path}/a/x", "one") and not f.write_once(f"{tmp_path}/a/x", "two") and f.read(f"{tmp_path}/a/x") == "one"
    assert [n for n in f.list(f"{tmp_path}/a") if not n.startswith(".")] == ["x"]
    with ThreadPoolExecutor(8) as pool:  # of many writers one wins, and its text is there whole
        won = list(pool.map(lambda i: i if Files(spark, str(tmp_path)).write_once(f"{tmp_path}/a/y", f"writer {i}" * 1000) else None, range(8)))
    assert f.read(f"{tmp_path}/a/y") == f"writer {[w for w in won if w is not None][0]}" * 1000 and sum(w is not None for w in won) == 1
    assert f.list(f"{tmp_path}/none") == [] and not f.exists(f"{tmp_path}/none")


def test_manifests(spark, tmp_path):
    t = ManifestTable(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.read("data") is None
    df = spark.range(3)
    assert t.commit({"data": [t.stage("data", df)]}, 0) == 1 and t.commit({"data": [t.stage("data", df)]}, 1) == 2
    assert t.read("data").count() == 6 and t.read("data", 1).count() == 3  # an older version stays readable
    t.commit({"data": [t.stage("data", df)]}, 2, replace=True)
    assert t.read("data").count() == 3 and cut(df).count() == 3
