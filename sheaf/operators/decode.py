"""Delimited text to typed tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import errors as E
from sheaf import keys as K
from sheaf import schema as S
from sheaf.functions import text as X
from sheaf.functions import values as V
from sheaf.options import DecodeOptions, ParallelOptions
from sheaf.sources import files, scan

UNTERMINATED = "Unterminated quoted field"
UNESCAPED = "Quote character in unquoted field"


@dataclass(frozen=True)
class Decoder:
    """Reads documents as tables of a schema; immutable and free of state, so one serves many uses."""

    options: DecodeOptions = field(default_factory=DecodeOptions)

    # -- sources ---------------------------------------------------------------------------------------------------

    def read(self, spark: SparkSession, path: str | list[str], schema: T.StructType | type | str, tier: str = "exact", parallel: ParallelOptions | None = None, keep_row: bool = False) -> DataFrame:
        """Files as a table. ``tier`` is exact, lines or native (see ``sheaf.sources.scan``)."""
        schema = S.as_schema(schema)
        if tier == "native":
            return self._native(spark, path, schema)
        if tier == "lines":
            records = scan.lines(spark, path, self.options.delimiter, self.options.encoding)
            header = self._first_line(spark, path)
            if self.options.has_headers:
                records = self._without_headers(records, header[1])
            return self._typed(records, schema, self._columns(schema, header[0]), keep_row)
        tables = []
        for part in self._parts(spark, path):
            records = part.records
            if parallel and parallel.parallelism:
                records = records.repartition(parallel.parallelism)
            tables.append(self._below_header(records, schema, self._columns(schema, part.header), keep_row))
        if not tables:
            return self.documents(scan.documents(spark, path, self.options.encoding), schema, keep_row, self._columns(schema, []))
        return reduce(DataFrame.unionByName, tables)

    def _parts(self, spark: SparkSession, path: str | list[str]) -> list[files.Part]:
        headers = self.options.has_headers and not self.options.index_mapping
        return files.parts(spark, path, self.options.delimiter, self.options.encoding, headers)

    def parse(self, df: DataFrame, text_col: str, schema: T.StructType | type | str, keep_row: bool = False) -> DataFrame:
        """Documents in a text column as a table."""
        return self.documents(scan.texts(df, text_col), S.as_schema(schema), keep_row)

    def parse_text(self, spark: SparkSession, text: str, schema: T.StructType | type | str, keep_row: bool = False) -> DataFrame:
        return self.parse(spark.createDataFrame([(text,)], "text string"), "text", schema, keep_row)

    def parse_bytes(self, spark: SparkSession, data: bytes, schema: T.StructType | type | str, keep_row: bool = False) -> DataFrame:
        scan.allow_charset(spark, self.options.encoding)
        one = spark.createDataFrame([(bytearray(data),)], "content binary")
        return self.documents(one.select(F.lit("0").alias("src"), scan.decoded(F.col("content"), self.options.encoding).alias("content")), S.as_schema(schema), keep_row)

    def rows(self, df: DataFrame, map_col: str, schema: T.StructType | type | str) -> DataFrame:
        """Named rows (a map of texts) as a table; header options do not apply."""
        schema = S.as_schema(schema)
        cell = lambda name: F.try_element_at(map_col, F.lit(name))
        plain = replace(self, options=replace(self.options, has_headers=False))
        return plain._project(df.withColumn("__row", F.lit(None).cast("long")), schema, None, cell, lambda name: F.map_contains_key(map_col, F.lit(name)), [], False, drop=["__row"], keep=[])

    def records(self, spark: SparkSession, path: str | list[str]) -> DataFrame:
        """(src, row, raw, fields, quoted): records as text, no typing."""
        found = files.parts(spark, path, self.options.delimiter, self.options.encoding, headers=False)
        if not found:
            return self.raw(scan.documents(spark, path, self.options.encoding))
        return self._quoted(reduce(DataFrame.unionByName, [part.records for part in found]))

    def raw(self, docs: DataFrame) -> DataFrame:
        """The same from (src, content); ``fields`` are unescaped."""
        return self._quoted(scan.records(docs, self.options.delimiter))

    @staticmethod
    def _quoted(found: DataFrame) -> DataFrame:
        return found.select("src", "row", "raw", F.transform("fields", X.unescaped).alias("fields"), F.transform("fields", lambda x: x.startswith('"')).alias("quoted"))

    def pull(self, df: DataFrame, batch_size: int | None = None) -> Iterator:
        """Rows one after another on the driver, or lists of them, without holding them all."""
        if batch_size is None:
            yield from df.toLocalIterator()
            return
        batch: list = []
        for row in df.toLocalIterator():
            batch.append(row)
            if len(batch) >= batch_size:
                yield batch
                batch = []
        if batch:
            yield batch

    # -- header ----------------------------------------------------------------------------------------------------

    def headers(self, docs: DataFrame) -> tuple[Column, list[list[str]]]:
        """The fields of a document's first record, as an expression, and the distinct ones of documents that have any text."""
        first = F.transform(X.raw_fields(F.regexp_extract("content", X.record_pattern(self.options.delimiter), 1), self.options.delimiter), X.unescaped)
        rows = docs.filter(F.length("content") > 0).select(first.alias("f")).distinct().collect()
        return first, sorted(list(row.f) for row in rows)

    @staticmethod
    def _without_headers(records: DataFrame, header: str) -> DataFrame:
        """One row that is like the header less in each file that has some; where there are more, those are records."""
        more = records.filter(F.col("raw") == F.lit(header)).groupBy("src", "row", "raw", "fields", "closed").agg(F.count("*").alias("n")).filter("n > 1")
        more = more.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("n"))))
        return records.filter(F.col("raw") != F.lit(header)).unionByName(more.drop("n"))

    def _first_line(self, spark: SparkSession, path: str | list[str]) -> tuple[list[str], str]:
        read = spark.read.option("encoding", self.options.encoding).text(path).limit(1)
        line = F.regexp_replace("value", "^﻿", "")
        row = read.select(line.alias("raw"), F.transform(X.raw_fields(line, self.options.delimiter), X.unescaped).alias("f")).first()
        return (list(row.f), row.raw) if row else ([], "")

    def _columns(self, schema: T.StructType, first: list[str]) -> list[str]:
        fields = [name for name, _, _ in S.leaves(schema, self.options.nested.separator)] if self.options.nested.kind == "flatten" else [S.column_name(f) for f in schema.fields]
        return K.resolved(first if self.options.has_headers else None, fields, len(first), self.options)

    # -- projection ------------------------------------------------------------------------------------------------

    def documents(self, docs: DataFrame, schema: T.StructType, keep_row: bool = False, names: list[str] | None = None) -> DataFrame:
        """(src, content) as a table. ``names`` gives the columns where no document may be looked at, as in a stream."""
        if names is None and self.options.has_headers and not self.options.index_mapping:
            first, found = self.headers(docs)
            if len(found) > 1:  # files of several layouts: each has its columns where its own header says
                parts = [self.documents(docs.filter(first == F.array(*[F.lit(x) for x in names])), schema, keep_row, self._columns(schema, names)) for names in found]
                return reduce(DataFrame.unionByName, parts)
            names = self._columns(schema, found[0] if found else [])
        elif names is None:
            names = self._columns(schema, [])
        return self._below_header(scan.records(docs, self.options.delimiter), schema, names, keep_row)

    def _below_header(self, records: DataFrame, schema: T.StructType, names: list[str], keep_row: bool) -> DataFrame:
        if self.options.has_headers:
            records = records.filter((F.col("row") > 1) | ~F.col("closed"))
        return self._typed(records, schema, names, keep_row)

    def _typed(self, records: DataFrame, schema: T.StructType, names: list[str], keep_row: bool) -> DataFrame:
        where = K.positions(names, self.options.duplicate_headers)
        rows = records.withColumnsRenamed({"row": "__row", "fields": "__fields"})

        def cell(name: str) -> Column | None:
            return F.get("__fields", F.lit(where[name])) if name in where else None

        def present(name: str) -> Column:
            return F.size("__fields") > where[name] if name in where else F.lit(False)

        return self._project(rows, schema, [F.col("src")], lambda n: None if cell(n) is None else X.unescaped(cell(n)), present, names, keep_row, structure=self._structure())

    def _structure(self) -> list[Column]:
        """Errors of the record as a whole."""
        row = F.col("__row")
        found = [F.when(~F.col("closed"), E.parsing_error(UNTERMINATED, row))]
        if self.options.mode == "strict":
            loose = F.exists("__fields", lambda x: ~x.startswith('"') & x.contains('"'))
            torn = F.col("raw") != F.concat_ws(self.options.delimiter, "__fields")
            found.append(F.when(F.col("closed") & (loose | torn), E.parsing_error(UNESCAPED, row)))
            if self.options.expected_field_count is not None:
                n = self.options.expected_field_count
                found.append(F.when(F.col("closed") & (F.size("__fields") != n), E.parsing_error(f"Expected {n} fields", row)))
        return found

    def _project(self, rows: DataFrame, schema: T.StructType, src, cell, present, names: list[str], keep_row: bool, drop=(), keep=(), structure: list[Column] | None = None) -> DataFrame:
        levels: list[dict[str, Column]] = []  # named expressions, each of which may mention those of levels before
        broken = F.filter(F.array(*structure), lambda e: e.isNotNull()) if structure else F.array().cast(T.ArrayType(E.ERROR))
        whole = F.lit(True)
        if structure:
            levels.append({"__broken": broken})
            broken = F.col("__broken")
            whole = F.size(broken) == 0
        failures: list[Column] = []
        columns = [self._column(f, (), cell, present, names, failures, whole, levels).alias(f.name) for f in schema.fields]
        for level in levels:
            rows = rows.withColumns(level)
        row = [F.col("__row").alias("_row")] if keep_row else []
        if not failures and not structure:
            return rows.select(*columns, *row)
        if self.options.on_error == "permissive":
            errors = F.filter(F.array(*failures), lambda e: e.isNotNull()).cast(T.ArrayType(E.ERROR)) if failures else F.array().cast(T.ArrayType(E.ERROR))
            return rows.select(*columns, *row, F.concat(broken.cast(T.ArrayType(E.ERROR)), errors).alias("_errors"))
        first = F.coalesce(*([F.try_element_at(broken, F.lit(1))["message"]] if structure else []), *[x["message"] for x in failures])
        checked = F.when(first.isNotNull(), F.raise_error(first)).otherwise(columns[0])
        return rows.select(checked.alias(schema.fields[0].name), *columns[1:], *row)

    def _column(self, f: T.StructField, path: tuple[str, ...], cell, present, names: list[str], failures: list[Column], whole: Column, levels: list[dict[str, Column]], prefix: str = "") -> Column:
        name = prefix + S.column_name(f)
        if isinstance(f.dataType, T.StructType):
            kind = self.options.nested.kind
            if kind == "error":
                raise E.UnsupportedType(f"nested field '{name}' needs a nested strategy")
            if kind == "flatten":
                inner = name + self.options.nested.separator
                if not names or name not in names or any(n.startswith(inner) for n in names):
                    parts = [self._column(g, (*path, f.name), cell, present, names, failures, whole, levels, inner).alias(g.name) for g in f.dataType.fields]
                    made = F.struct(*parts)
                    if f.nullable:
                        return F.when(F.greatest(*[present(n) for n, _, _ in S.leaves(f.dataType, self.options.nested.separator, inner)], F.lit(False)), made)
                    return made
        raw = cell(name)
        row = F.col("__row")
        missing = E.key_not_found(name, row, path, names)
        if raw is None:
            if not f.nullable:
                failures.append(F.when(whole, missing))
            return F.lit(None).cast(f.dataType)
        depth = 0

        def bind(x: Column) -> Column:
            nonlocal depth
            if depth == len(levels):
                levels.append({})
            own = f"__{depth}_{len(levels[depth])}"
            levels[depth][own] = x
            depth += 1
            return F.col(own)

        text = bind(X.trimmed(raw) if self.options.trim_whitespace else raw)
        if isinstance(f.dataType, T.StringType) and not f.nullable and f.metadata.get(S.KIND) is None:
            null = text.isNull()  # an empty text is a text
        else:
            null = text.isNull() | V.is_null(text, self.options.nils)
        found = F.when(~null, V.value(text, f, self.options, bind))
        plain_string = isinstance(f.dataType, T.StringType) and not f.metadata.get(S.KIND) and S.VALUES not in f.metadata
        if not plain_string:
            found = bind(found)
        if not f.nullable:
            failures.append(F.when(whole & text.isNull(), missing))
        expected, named = V.expected_name(f.dataType, f.metadata.get(S.KIND), self.options.dates)
        if not plain_string:
            wrong = text.isNotNull() & found.isNull() & (~null if f.nullable else F.lit(True))
            failures.append(F.when(whole & wrong, E.type_mismatch(expected, text, row, name, path, named)))
        return found

    def _native(self, spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
        first, _ = self._first_line(spark, path)
        names = self._columns(schema, first)
        rows = scan.native(spark, path, first, self.options.delimiter, self.options.has_headers, encoding=self.options.encoding)
        where = K.positions(names, self.options.duplicate_headers)
        rows = rows.withColumn("__row", F.lit(None).cast("long"))
        cell = lambda n: F.coalesce(F.col(f"c{where[n]}"), F.lit("")) if n in where and where[n] < len(first) else None
        return self._project(rows, schema, None, cell, lambda n: F.lit(n in where), names, False)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A permissive result as good rows and bad rows."""
    bad = F.size("_errors") > 0
    return df.filter(~bad).drop("_errors"), df.filter(bad)


def batches(df: DataFrame, size: int) -> DataFrame:
    """The rows with ``_batch``, from their ``_row``: batches of ``size`` records in order."""
    return df.withColumn("_batch", F.floor((F.col("_row") - 1) / size).cast("long"))
