"""Tables dealt out over all cores."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.plans import ALL_QUERIES
from velaria.plans.registry import spread


def _rows_by_task(df):
    counts = dict(df.groupBy(F.spark_partition_id()).count().collect())
    return [counts.get(i, 0) for i in range(df.rdd.getNumPartitions())]


def test_one_file_in_many_splits_is_dealt_out(spark, tmp_path):
    # One row group: whatever the splits, a single task would read all rows.
    spark.range(5000).withColumn("c_name", F.concat(F.lit("Customer "), F.repeat(F.col("id").cast("string"), 9))).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.parquet(str(tmp_path / "customer.parquet"))
        assert sorted(_rows_by_task(df))[-2:] == [0, 5000]
        dealt = _rows_by_task(spread(df))
        assert len(dealt) >= spark.sparkContext.defaultParallelism and max(dealt) < 2500
        assert max(_rows_by_task(ALL_QUERIES["d07_iban"](spark, str(tmp_path)))) < 2500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
