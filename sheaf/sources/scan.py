"""Files and texts to raw records.

Three ways to read, with the same result wherever more than one of them applies:

- exact: everything in the format is allowed. Documents in columns are split whole, a row each; files are read in blocks of
  lines and never whole (see ``sheaf.sources.files``).
- lines: splittable; for data without line ends inside quotes.
- native: Spark's own reader, splittable and fastest; for UTF-8 without blank lines, CRLF inside quotes and the like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import text as X

#: Charsets that Spark decodes without a setting.
COMMON = frozenset(("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"))

# Byte order marks and what they mean, in the order in which they are tried.
MARKS = (("FFFE0000", 4, "UTF-32"), ("0000FEFF", 4, "UTF-32"), ("EFBBBF", 3, "UTF-8"), ("FEFF", 2, "UTF-16BE"), ("FFFE", 2, "UTF-16LE"))


def allow_charset(spark: SparkSession, encoding: str) -> None:
    if encoding.upper() not in COMMON:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def decoded(content: Column, encoding: str = "UTF-8") -> Column:
    """Text of a document's bytes; a byte order mark overrides the encoding and is dropped."""
    start = F.hex(F.substring(content, 1, 4))
    marked = None
    for mark, size, charset in MARKS:
        body = content if charset == "UTF-32" else F.substring(content, F.lit(size + 1), F.length(content))
        arm = F.decode(body, charset)
        marked = F.when(start.startswith(mark), arm) if marked is None else marked.when(start.startswith(mark), arm)
    return F.regexp_replace(marked.otherwise(F.decode(content, encoding)), "^﻿", "")


def documents(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", some: list[str] | None = None) -> DataFrame:
    """(src, content) of files, or of ``some`` of them."""
    allow_charset(spark, encoding)
    files, src = spark.read.format("binaryFile").load(path), F.col("_metadata.file_path")
    if some is not None:
        files = files.filter(src.isin(some))
    return files.select(src.alias("src"), decoded(F.col("content"), encoding).alias("content"))


def texts(df: DataFrame, text_col: str, src: Column | None = None) -> DataFrame:
    """(src, content) of a column of documents."""
    return df.select((src if src is not None else F.monotonically_increasing_id().cast("string")).alias("src"), F.regexp_replace(F.col(text_col), "^﻿", "").alias("content"))


def records(docs: DataFrame, delimiter: str = ",") -> DataFrame:
    """(src, row, raw, fields, closed): records numbered from 1; ``fields`` as written, quotes included.

    A document with an unclosed quote ends in a record that is not ``closed`` and holds the rest.
    """
    rows = found(docs, delimiter).select("src", F.posexplode("__found").alias("at", "record"))
    return fielded(rows.withColumn("row", (F.col("at") + 1).cast("long")), delimiter)


def found(docs: DataFrame, delimiter: str, last: Column | None = None) -> DataFrame:
    """The documents with ``__found``, an array of their records (raw, closed). Where not ``last``, an empty last line counts."""
    split = docs.withColumn("__split", X.split(F.col("content"), delimiter)).withColumn("__used", X.consumed(F.col("__split")))
    whole, used = X.records(F.col("__split")), F.col("__used")
    if last is not None:
        whole = F.when(last, whole).otherwise(F.slice("__split", F.lit(1), F.size("__split") - 1))
    rest = F.substring(F.col("content"), used + 1, F.length("content"))
    good = F.transform(whole, lambda r: F.struct(r.alias("raw"), F.lit(True).alias("closed")))
    bad = F.when(used < F.length("content"), F.array(F.struct(rest.alias("raw"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<raw:string,closed:boolean>>"))
    return split.withColumn("__found", F.concat(good, bad)).drop("__split", "__used")


def fielded(rows: DataFrame, delimiter: str) -> DataFrame:
    """(src, row, raw, fields, closed) of (src, row, record)."""
    raw = F.regexp_replace("record.raw", r"(?:\r\n|\n|\r)\z", "")
    return rows.select("src", "row", F.when(F.col("record.closed"), raw).otherwise(F.col("record.raw")).alias("raw"), X.raw_fields(F.col("record.raw"), delimiter).alias("fields"), F.col("record.closed").alias("closed"))


def lines(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The same from splittable text files, one record a line; ``row`` is null, for lines have no order across splits."""
    read = spark.read.option("encoding", encoding).text(path)
    line = F.regexp_replace("value", "^﻿", "")
    return read.select(F.col("_metadata.file_path").alias("src"), F.lit(None).cast("long").alias("row"), line.alias("raw"), X.raw_fields(line, delimiter).alias("fields"), F.lit(True).alias("closed"))


def native(spark: SparkSession, path: str | list[str], names: list[str], delimiter: str = ",", has_headers: bool = True, multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text by Spark's reader; an empty quoted field is an empty text, an empty one null."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"header": has_headers, "sep": delimiter, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\0", "multiLine": multi_line, "encoding": encoding, "enforceSchema": True}
    return spark.read.schema(schema).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).csv(path)


def approximate_rows(docs: DataFrame) -> DataFrame:
    """The number of line feeds in all documents."""
    return docs.agg(F.coalesce(F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))), F.lit(0)).cast("long").alias("lines"))
