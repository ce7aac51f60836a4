"""Batches of rows numbered over range partitions."""

from pyspark.sql import functions as F

from sheaf.operators.encode import Encoder


def test_batches_of_many_rows(spark):
    """Two evaluations of a range partitioning cut different bounds once the sample is smaller than the table."""
    rows = spark.range(0, 600_000, 1, 6).select((F.col("id") * 7919 % 600_011).alias("k"))
    found = Encoder().batches(rows, 1000, ["k"]).select("_batch", F.size("rows").alias("n"), F.get("rows", F.lit(0)).alias("first")).collect()
    keys = sorted(i * 7919 % 600_011 for i in range(600_000))
    assert sorted((r._batch, r.n, r.first) for r in found) == [(b, 1000, str(keys[b * 1000])) for b in range(600)]
