from pyspark.sql import functions as F

from tidemark.session import staged


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in files.split() if "/shuffle_" in f}


def test_a_staged_frame_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    got = staged(spark.range(1000).groupBy((F.col("id") % 700).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert got.count() == 700 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
