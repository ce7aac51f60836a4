"""Files of any records, read in blocks of lines; ``records`` of ``sheaf.sources.scan`` gives the same from whole documents.

One pass over the lines finds out how each file may be read and how many lines each of its blocks has:

- where every line is one record, blocks are read on their own, and no row is moved: what the
  pass found is a constant of the plan, looked up by task;
- where records have line ends inside, the lines of a file are put together in their order, sorted with spilling;
- only files whose line feeds are not the byte 0A (UTF-16 and the like, by mark or by option) are read whole.

So but for the last, a row holds one line or one record. The driver sees a row of numbers for each block.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.sources import scan

#: Starts of files whose line feeds are not the byte 0A.
WIDE_MARKS = (b"\xfe\xff", b"\xff\xfe", b"\x00\x00")
UTF8_MARK = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Part:
    """Files whose first records have the fields ``header`` (all files, if headers are not asked for), and their records."""

    header: list[str]
    records: DataFrame


def splittable(encoding: str) -> bool:
    """Whether the byte 0A is a line feed and nothing else."""
    return encoding.upper().startswith(("US-ASCII", "ISO-8859-", "UTF-8", "WINDOWS-125"))


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(src, start, size, id, content, line): what lies between line feeds; ids ascend within the block at ``start``."""
    scan.allow_charset(spark, encoding)
    m, content = F.col("_metadata"), F.col("value").cast("binary")
    line = F.decode(content, encoding)
    if encoding.upper() == "UTF-8":
        line = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(line)
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(m["file_path"].alias("src"), m["file_block_start"].alias("start"), m["file_size"].alias("size"), F.monotonically_increasing_id().alias("id"), content.alias("content"), line.alias("line"))


def _unmarked(line: Column) -> Column:
    """Without a byte order mark, and without the one that may follow it."""
    return F.when(line.startswith("\ufeff"), F.regexp_replace(line, "^\ufeff{1,2}", "")).otherwise(line)


def _task(number: Column) -> Column:
    return F.shiftright(number, 33)


def _starts_with(content: Column, *marks: bytes) -> Column:
    return F.substring(content, 1, len(marks[0])).isin(*[F.lit(bytearray(x)) for x in marks])


def parts(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "UTF-8", headers: bool = True) -> list[Part]:
    """The records of files as (src, row, raw, fields, closed), by header."""
    if not splittable(encoding):
        return _grouped(scan.records(scan.documents(spark, path, encoding), delimiter), headers)
    lines, line, number = _lines(spark, path, encoding), F.col("line"), F.col("id")
    single = X.is_record(line, delimiter) & F.when(line.startswith("\ufeff"), X.is_record(_unmarked(line), delimiter)).otherwise(True)
    wide = _starts_with(F.col("content"), *WIDE_MARKS)
    if encoding.upper() != "UTF-8":
        wide |= _starts_with(F.col("content"), UTF8_MARK)
    blocks = lines.groupBy("src", "start", F.xxhash64("src", "start").alias("key"), _task(number).alias("task")).agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size"), F.sum(F.octet_length("content") + F.lit(1)).alias("bytes"),
        F.every(single).alias("single"), F.max_by(line.isin("", "\r"), "id").alias("blank"), F.min_by(wide, "id").alias("wide"), F.min_by(F.xxhash64("line"), "id").alias("head"),
    )
    files: dict[str, list] = {}
    for block in sorted(blocks.collect(), key=lambda b: (b.src, b.start)):
        files.setdefault(block.src, []).append(block)
    whole, joined, ended, plain, index = [], [], [], {}, {}
    for src, its in files.items():
        if its[0].wide:
            whole.append(src)
        elif all(b.single for b in its):
            plain.setdefault(its[0].head if headers else None, []).append(src)
            before = 0
            for b in its:
                index.setdefault(b.task, []).append({"key": b.key, "first": b.first, "n": b.n, "before": before, "blank": b is its[-1] and b.blank})
                before += b.n
        else:
            joined.append(src)
            if sum(b.bytes for b in its) == its[0].size:
                ended.append(src)

    def of(rows: DataFrame, some: list[str]) -> DataFrame:
        return rows if len(some) == len(files) else rows.filter(F.col("src").isin(some))

    out: list[Part] = []
    if plain:
        table = json.dumps([index.get(i, []) for i in range(max(index) + 1)])
        for some in plain.values():
            first = lines.filter((F.col("src") == some[0]) & (F.col("start") == 0)).limit(1)
            header = first.select(F.transform(X.raw_fields(_unmarked(line), delimiter), X.unescaped).alias("f")).first().f if headers else []
            out.append(Part(list(header), _plain(of(lines, some), table, delimiter)))
    if joined:
        out += _grouped(_joined(of(lines, joined), ended, delimiter), headers)
    if whole:
        docs = scan.documents(spark, path, encoding, None if len(whole) == len(files) else whole)
        out += _grouped(scan.records(docs, delimiter), headers)
    same: dict[tuple, list[DataFrame]] = {}
    for part in out:
        same.setdefault(tuple(part.header), []).append(part.records)
    merged = []
    for header, found in same.items():
        records = found[0]
        for more in found[1:]:
            records = records.unionByName(more)
        merged.append(Part(list(header), records))
    return merged


def _grouped(records: DataFrame, headers: bool) -> list[Part]:
    """Records by the first of their files; an unclosed one is a header of one empty field."""
    if not headers:
        return [Part([], records)]
    fields = F.when(F.col("closed"), F.transform("fields", X.unescaped)).otherwise(F.array(F.lit("")))
    by: dict[tuple, list[str]] = {}
    for r in records.filter("row = 1").select("src", fields.alias("f")).collect():
        by.setdefault(tuple(r.f), []).append(r.src)
    return [Part(list(f), records if len(by) == 1 else records.filter(F.col("src").isin(some))) for f, some in sorted(by.items())]


def _plain(lines: DataFrame, blocks: str, delimiter: str) -> DataFrame:
    """A record a line; ``blocks`` has each task's blocks. One that the pass before did not see like this is an error: the files changed."""
    table = F.from_json(F.lit(blocks), "array<array<struct<key:bigint,first:bigint,n:bigint,before:bigint,blank:boolean>>>")
    own, here = F.xxhash64("src", "start"), F.col("id")
    found = F.filter(F.get(table, _task(here).cast("int")), lambda b: (b["key"] == own) & (here >= b["first"]) & (here < b["first"] + b["n"]))
    rows = lines.withColumn("block", F.get(found, F.lit(0)))
    at = F.col("id") - F.col("block.first") + 1
    rows = rows.filter(F.coalesce(~F.col("block.blank") | (at < F.col("block.n")), F.lit(True)))
    row = F.coalesce(F.col("block.before") + at, F.raise_error(F.concat(F.lit("read otherwise than before: "), "src")).cast("long"))
    raw = F.when(row == 1, _unmarked(F.col("line"))).otherwise(F.col("line"))
    rows = rows.select("src", row.alias("row"), F.when(raw.endswith("\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw).alias("raw"))
    return rows.select("src", "row", "raw", X.raw_fields(F.col("raw"), delimiter).alias("fields"), F.lit(True).alias("closed"))


def _joined(lines: DataFrame, ended: list[str], delimiter: str) -> DataFrame:
    """Lines put together until no quoted field is open, then split like documents.

    Of each line it is known where it ends if it begins outside of quotes and where if inside; ends that do not depend on
    the begin are fixed points, between which the lines that change sides are counted.
    """
    order = Window.partitionBy("src").orderBy("start", "id")
    begin = F.when(F.row_number().over(order) == 1, _unmarked(F.col("line"))).otherwise(F.col("line"))
    rows = lines.select("src", "start", "id", begin.alias("line"))
    rows = rows.withColumns({"__out": X.closes(F.col("line"), delimiter, False), "__in": X.closes(F.col("line"), delimiter, True)})
    same = F.col("__out") == F.col("__in")
    rows = rows.withColumn("__turns", F.sum(F.when(~same & F.col("__in"), 1).otherwise(0)).over(order))
    fixed = F.when(same, F.when(F.col("__out"), 0).otherwise(1) + F.col("__turns"))
    rows = rows.withColumn("__open", (F.coalesce(F.last(fixed, True).over(order), F.lit(0)) + F.col("__turns")) % 2)
    rows = rows.withColumn("__chunk", F.sum(F.when(F.lag("__open", 1, 0).over(order) == 0, 1).otherwise(0)).over(order))
    texts = F.array_sort(F.collect_list(F.struct("start", "id", "line")))
    chunks = rows.groupBy("src", "__chunk").agg(F.array_join(F.transform(texts, lambda x: x["line"]), "\n").alias("content"))
    chunks = chunks.withColumn("__last", F.lead("__chunk").over(Window.partitionBy("src").orderBy("__chunk")).isNull())
    fed = ~F.col("__last") | F.col("src").isin(ended) if ended else ~F.col("__last")
    found = scan.found(chunks.withColumn("content", F.when(fed, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))), delimiter, F.col("__last"))
    before = F.sum(F.size("__found")).over(Window.partitionBy("src").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    found = found.select("src", F.coalesce(before, F.lit(0)).alias("before"), "__found")
    rows = found.select("src", "before", F.posexplode("__found").alias("at", "record"))
    return scan.fielded(rows.withColumn("row", (F.col("before") + F.col("at") + 1).cast("long")), delimiter)
