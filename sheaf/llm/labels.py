"""Labelled rows for the operators that learn: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def remainder(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; rows with 0 are held out. A null id counts as an empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(id_col: str | Column) -> Column:
    return remainder(id_col) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int] | None, total: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``per_class[label]`` rows of each label, or ``total`` rows, that are not held out.

    Rows are chosen by a hash of the id, so the same rows come out whatever the partitions. Only the chosen ids, a
    bounded number, are broadcast to the documents.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
    known = known.filter(F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id"))
    order = [F.xxhash64("__id"), F.col("__id"), F.col("__label")]
    if total is not None:
        known = known.orderBy(*order).limit(total)
    else:
        known = known.filter("__label = 1").orderBy(*order).limit(per_class[1]).unionByName(known.filter("__label = 0").orderBy(*order).limit(per_class[0]))
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("text", F.col("__label").alias("label"))
