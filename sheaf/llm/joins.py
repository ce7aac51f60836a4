"""Joins and components that stay even when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.storage import Scratch

#: Most bytes of a broadcast side, by its counted rows; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: A key is hot with this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lookup(rows: DataFrame, key: str, index: DataFrame, index_key: str, weight: str, size: int, total: int, row_bytes: int = 96, how: str = "left") -> DataFrame:
    """Join rows with a table of one row a key; ``weight`` is the key's number of rows out of ``total``.

    A small index is broadcast. Otherwise hot keys are looked up in a broadcast of at most 1 / HOT_SHARE keys and only
    the others are shuffled, so no key's rows meet in one task.
    """
    index = index.withColumnRenamed(index_key, "__lookup")
    on = F.col(key) == F.col("__lookup")
    if size * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(index), on, how).drop("__lookup")
    hot = F.col(weight) >= total * HOT_SHARE
    first = rows.join(F.broadcast(index.filter(hot)), on, "left")
    rest = first.filter(F.col("__lookup").isNull()).select(rows.columns).join(index.filter(~hot), on, how)
    return first.filter(F.col("__lookup").isNotNull()).unionByName(rest).drop("__lookup")


def hinted(written: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are few enough."""
    return broadcast_if_small(written, written.count(), row_bytes)


def in_company(rows: DataFrame, key: str, many: str | None = None) -> DataFrame:
    """The rows whose key other rows have too. They are shuffled by the key once, for counting and filtering alike.

    ``many`` names a column that keeps how many rows have the key.
    """
    counted = rows.withColumn(many or "__rows", F.count("*").over(Window.partitionBy(key))).filter(F.col(many or "__rows") > 1)
    return counted if many else counted.drop("__rows")


def components(edges: DataFrame, into: Scratch) -> DataFrame:
    """(node, label) for all nodes of edges (x, y), written; a label is the smallest node of its component.

    Smallest labels spread over edges, and labels of labels are followed, until nothing changes.
    """
    own, last = Scratch(edges.sparkSession), None
    x, y = F.col("x"), F.col("y")
    both = own.kept(edges.select(F.explode(F.array(F.struct(x, y), F.struct(y.alias("x"), x.alias("y")), F.struct(x, x.alias("y")), F.struct(y.alias("x"), y))).alias("e")).select("e.*").distinct(), "edges")
    labels = own.kept(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")), "labels")
    few = labels.count() * 32 <= BROADCAST_BYTES
    while True:
        side = F.broadcast(labels) if few else labels
        near = both.join(side, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("next"))
        jump = side.select(F.col("node").alias("at"), F.col("label").alias("far"))
        was = side.select(F.col("node").alias("same"), F.col("label").alias("was"))
        moved = near.join(jump, F.col("next") == F.col("at")).join(was, F.col("node") == F.col("same"))
        step = Scratch(edges.sparkSession)
        labels = step.kept(moved.select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("was")).alias("changed")), "labels")
        if last:
            last.drop()
        last = step
        if labels.filter("changed").isEmpty():
            own.drop()
            into.paths += last.paths
            return labels.select("node", "label")
