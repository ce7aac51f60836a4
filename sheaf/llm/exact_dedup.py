"""Exact duplicates by a log-structured merge index of text digests.

Each task gathers ``(digest, id)`` in a memtable; a full memtable is folded, sorted by digest and flushed as one run.
Runs are Parquet files with Bloom filters on the digest. Compaction merges runs by digest and keeps the winning id (the
smallest, or the largest where asked) with the number of rows. Digests that occur once need nothing more; the texts
behind repeated digests (hits) are then compared byte by byte by grouping on the text itself.

Defined results: a null text counts as empty, and empty texts equal each other. Rows with a null id count in their
group; the id that stays is null only if all ids are. Of repeated rows with the id that stays, one row stays. An empty
table gives an empty result. Other columns, whatever their names, are ignored or passed on untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.joins import lookup
from sheaf.storage import fresh_path, kept

MEMTABLE_ROWS = 100_000
RUN_SCHEMA = "digest binary, id long, n long"
INDEX_SCHEMA = RUN_SCHEMA + ", n_id long"


def normalised(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text with A-Z lower-cased; null as empty."""
    data, offsets = tk.text_buffers(texts)
    low = tk.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def digest_of(texts: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())


def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold ``(__id, __text)`` batches into runs sorted by digest, each of at most about MEMTABLE_ROWS rows."""

    def run(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held).group_by(["digest", "id"]).aggregate([([], "count_all")])
        table = table.select(["digest", "id", "count_all"]).rename_columns(["digest", "id", "n"]).sort_by("digest")
        return table.combine_chunks().to_batches()[0]

    held, n = [], 0
    for batch in batches:
        for part in tk.slices(batch, "__text"):
            held.append(pa.table({"digest": digest_of(normalised(tk.texts_of(part, "__text"))), "id": tk.texts_of(part, "__id")}))
            n += part.num_rows
            if n >= MEMTABLE_ROWS:
                yield run(held)
                held, n = [], 0
    if n:
        yield run(held)


class DigestIndex:
    """Sorted digest runs in a folder that all executors see."""

    def __init__(self, spark: SparkSession, keep: str = "min", path: str | None = None, runs: list[str] | None = None):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.keep = spark, keep
        self.path, self.runs = path or fresh_path(spark, "digests"), list(runs or [])
        self.compacted: str | None = None

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
        """Add the rows of a table as level-0 runs, one for each memtable."""
        rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
        self._write(rows.mapInArrow(memtables, RUN_SCHEMA), f"{self.path}/runs-{len(self.runs)}")
        self.runs.append(f"{self.path}/runs-{len(self.runs)}")
        return self

    def compact(self) -> DigestIndex:
        """Merge all runs by digest; equal digests fold to the id that stays."""
        runs = self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs)
        by_id = runs.groupBy("digest", "id").agg(F.sum("n").alias("n"))
        # Null ids lose against any other.
        order = F.coalesce(F.col("id") if self.keep == "max" else -F.col("id"), F.lit(-(1 << 63)))
        merged = by_id.groupBy("digest").agg(F.max_by("id", order).alias("id"), F.sum("n").alias("n"), F.max_by("n", order).alias("n_id"))
        self.compacted = f"{self.path}/level-1-{len(self.runs)}"
        self._write(merged.sortWithinPartitions("digest"), self.compacted)
        return self

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)

    def entries(self) -> DataFrame:
        """One row for each digest: the id that stays, the rows with that digest, and those of them with that id."""
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.compacted or self.compact().compacted)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame has not got, however it compares names."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all that a row holds, for ties between rows; of any column types."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def with_digest(docs: DataFrame, text_col: str, name: str, text_name: str | None = None) -> DataFrame:
    """All columns, the digest, and if asked the normalised text as bytes."""
    index = docs.columns.index(text_col)
    added = [name, text_name] if text_name else [name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                texts = normalised(part.column(index))
                new = [digest_of(texts), pa.array(texts, pa.binary())][: len(added)]
                yield pa.RecordBatch.from_arrays(part.columns + new, part.schema.names + added)

    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.BinaryType()) for c in added])
    return docs.mapInArrow(add, schema)


def decided(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, which must not be named like those added, with ``__digest``, ``__keep_id``, ``__n`` (rows of the group) and ``__kept``."""
    spark = docs.sparkSession
    entries = DigestIndex(spark, keep).flush(docs, id_col, text_col).entries()
    index = entries.filter("n > 1").select("digest", F.col("id").alias("__keep_id"), F.col("n").alias("__n"), F.col("n_id").alias("__n_id"))
    total, size = entries.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    own = F.col(id_col).cast("long")

    # Hits receive byte verification: rows with repeated digests are grouped by the text itself.
    slim = docs.select(own.alias("__id"), F.col(text_col).alias("__t"))
    hits = lookup(with_digest(slim, "__t", "__digest", "__text").drop("__t"), "__digest", index, "digest", "__n", size, total, how="inner")
    order = F.coalesce(F.col("__id") if keep == "max" else -F.col("__id"), F.lit(-(1 << 63)))
    texts = hits.groupBy("__digest", "__text").agg(F.max_by("__id", order).alias("__keep_id"), F.count("*").alias("__n"))
    clashes = kept(texts.groupBy("__digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("__digest"), "clashes")

    rows = lookup(with_digest(docs, text_col, "__digest"), "__digest", index, "digest", "__n", size, total)
    if not clashes.isEmpty():  # SHA-256 collided: each text is a group of its own
        apart = texts.join(clashes, "__digest", "left_semi")
        again = with_digest(docs, text_col, "__digest", "__text").join(apart, ["__digest", "__text"]).withColumn("__n_id", F.lit(2)).select(rows.columns)
        rows = rows.join(clashes, "__digest", "left_anti").select(again.columns).unionByName(again)
    one = F.col("__n").isNull()
    rows = rows.withColumns({"__keep_id": F.when(one, own).otherwise(F.col("__keep_id")), "__n": F.coalesce("__n", F.lit(1)).cast("long")})
    wins = own.eqNullSafe(F.col("__keep_id"))
    if index.filter("__n_id <> 1").isEmpty() and clashes.isEmpty():
        return rows.withColumn("__kept", wins).drop("__n_id")
    # Several rows have the id that stays: the one with the least hash of all it holds stays, of wholly equal rows any one.
    tied = wins & (F.coalesce("__n_id", F.lit(1)) > 1)
    ties = kept(rows.filter(tied).withColumns({"__hash": row_hash(docs), "__place": F.monotonically_increasing_id()}), "ties")
    best = ties.groupBy("__digest", "__keep_id").agg(F.min(F.struct("__hash", "__place")).alias("b")).select(F.col("b.__place").alias("__best"))
    ties = ties.join(best, F.col("__place") == F.col("__best"), "left").withColumn("__kept", F.col("__best").isNotNull())
    return rows.filter(~tied).withColumn("__kept", wins).drop("__n_id").unionByName(ties.drop("__n_id", "__hash", "__place", "__best"))


def duplicate_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, keep_id, group_size, kept and the text's SHA-256."""
    rows = decided(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), keep, "id", "text")
    return rows.select("id", F.col("__keep_id").alias("keep_id"), F.col("__n").alias("group_size"), F.col("__kept").alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns, whatever their names; one of each group."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = decided(docs.toDF(*names), keep, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)])
    return rows.filter("__kept").select(*names).toDF(*docs.columns)
