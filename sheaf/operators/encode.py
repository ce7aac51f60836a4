"""Typed tables to delimited text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import keys as K
from sheaf import schema as S
from sheaf.errors import UnsupportedType
from sheaf.functions import format as W
from sheaf.functions import text as X
from sheaf.options import EncodeOptions
from sheaf.storage import kept

_FIRST_OF_PARTITION = (1 << 33) - 1


@dataclass(frozen=True)
class Encoder:
    """Writes tables as records; immutable and free of state."""

    options: EncodeOptions = field(default_factory=EncodeOptions)

    # -- columns ---------------------------------------------------------------------------------------------------

    def _cells(self, schema: T.StructType, at=None, prefix: str = "") -> list[tuple[str, Column]]:
        """(column name, text) of each leaf; null as the options have it."""
        get = at or F.col
        out: list[tuple[str, Column]] = []
        for f in schema.fields:
            name, x = prefix + S.column_name(f), get(f"`{f.name}`") if at is None else get(f.name)
            if isinstance(f.dataType, T.StructType) and self.options.nested.kind != "json":
                if self.options.nested.kind == "error":
                    raise UnsupportedType(f"nested field '{name}' needs a nested strategy")
                out += self._cells(f.dataType, x.getField, name + self.options.nested.separator)
                continue
            out.append((name, F.coalesce(W.text(x, f, self.options), F.lit(self._nil()))))
        return out

    def _nil(self) -> str:
        kind = self.options.nils.kind
        return "null" if kind == "literal" else self.options.nils.values[0] if kind == "custom" else ""

    def headers(self, schema: T.StructType | type | str) -> list[str]:
        """The header names of a schema."""
        return [K.encoded_key(name, self.options.keys) for name, _ in self._cells(S.as_schema(schema))]

    def header_row(self, schema: T.StructType | type | str) -> str:
        d = self.options.delimiter
        quoted = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in (d, '"', "\r", "\n")) else n
        return d.join(map(quoted, self.headers(schema)))

    def row(self, schema: T.StructType) -> Column:
        """The record of a row, without its line end."""
        return self._joined([x for _, x in self._cells(schema)], self._bare(schema))

    def _bare(self, schema: T.StructType) -> list[bool]:
        """Of each cell whether it has digits, signs, points and the letters of NaN, Infinity and E at most, and no delimiter."""
        if len(self._cells(schema)) != len(schema.fields) or self.options.delimiter in "+-." or self.options.delimiter.isalnum() or self.options.nils.kind == "custom":
            return [False] * len(self._cells(schema))
        plain = self.options.numbers.kind not in ("custom", "locale")
        return [isinstance(f.dataType, T.IntegralType) or plain and isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in schema.fields]

    def _joined(self, texts: list[Column], bare: list[bool]) -> Column:
        cells = [x if as_is else X.escaped(x, self.options.delimiter) for x, as_is in zip(texts, bare)]
        if len(cells) == 1:  # a blank line would be lost
            return F.when(cells[0] == "", F.lit('""')).otherwise(cells[0])
        return F.concat_ws(self.options.delimiter, *cells)

    def dictionary(self, schema: T.StructType) -> Column:
        """A row as a map of header names to unescaped texts."""
        cells = self._cells(schema)
        return F.map_from_arrays(F.array(*[F.lit(K.encoded_key(n, self.options.keys)) for n, _ in cells]), F.array(*[x for _, x in cells]))

    # -- results ---------------------------------------------------------------------------------------------------

    def rows(self, df: DataFrame, into: str = "row") -> DataFrame:
        """A table of records as text."""
        return df.select(self.row(df.schema).alias(into))

    def lines(self, df: DataFrame, into: str = "line") -> DataFrame:
        """Records with their line ends."""
        return df.select(F.concat(self.row(df.schema), F.lit(self.options.line_ending)).alias(into))

    def dictionaries(self, df: DataFrame, into: str = "row") -> DataFrame:
        return df.select(self.dictionary(df.schema).alias(into))

    def documents(self, df: DataFrame, by: list[str], order: list[str], into: str = "text") -> DataFrame:
        """One document for each group of rows, in order; for groups that fit in a row."""
        body = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("__record").alias("r")))), lambda x: x["r"])
        columns = [f.name for f in df.schema.fields if f.name not in by]
        inner = df.select(*by, *columns)
        rows = inner.withColumn("__record", self.row(T.StructType([df.schema[c] for c in columns])))
        text = F.array_join(body, self.options.line_ending)
        if self.options.has_headers:
            text = F.concat(F.lit(self.header_row(T.StructType([df.schema[c] for c in columns])) + self.options.line_ending), text)
        if self.options.includes_trailing_newline:
            text = F.concat(text, F.lit(self.options.line_ending))
        return rows.groupBy(*by).agg(text.alias(into))

    def to_string(self, df: DataFrame) -> str:
        """A small table as one text, in its order; empty without a header if there are no rows."""
        found = [r.row for r in self.rows(df).collect()]
        if not found:
            return ""
        if self.options.has_headers:
            found.insert(0, self.header_row(df.schema))
        return self.options.line_ending.join(found) + (self.options.line_ending if self.options.includes_trailing_newline else "")

    def to_bytes(self, df: DataFrame) -> bytes:
        return self.to_string(df).encode()

    def pull(self, df: DataFrame) -> Iterator[str]:
        """The header's and each record's line, one after another on the driver."""
        first = True
        for r in self.lines(df).toLocalIterator():
            if first and self.options.has_headers:
                yield self.header_row(df.schema) + self.options.line_ending
            first = False
            yield r.line

    def batches(self, df: DataFrame, size: int, order: list[str]) -> DataFrame:
        """(_batch, rows): arrays of at most ``size`` records, numbered in the given order.

        Ranks come from a count of rows for each range partition, so no task sees all rows.
        """
        rows = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], self.row(df.schema).alias("__record"))
        keys = [f"__o{i}" for i in range(len(order))]
        ranked = numbered(rows, keys)
        batch = F.floor(F.col("__n") / size).cast("long").alias("_batch")
        return ranked.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__record"))), lambda x: x["__record"]).alias("rows"))

    def write(self, df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False, order: list[str] | None = None) -> None:
        """Files of records, one for each partition and each with the header; ``single`` for one file."""
        if single:
            df = df.coalesce(1) if not order else df.repartition(1).sortWithinPartitions(*order)
        # Cells have names, so that each is computed once, however often a record mentions it.
        names = [f"__c{i}" for i in range(len(self._cells(df.schema)))]
        row = self._joined([F.col(n) for n in names], self._bare(df.schema))
        cells = df.select(*[x.alias(n) for n, (_, x) in zip(names, self._cells(df.schema))])
        if self.options.has_headers:
            first = F.monotonically_increasing_id().bitwiseAND(_FIRST_OF_PARTITION) == 0
            row = F.when(first, F.concat(F.lit(self.header_row(df.schema) + self.options.line_ending), row)).otherwise(row)
        cells.select(row.alias("value")).write.mode(mode).option("lineSep", self.options.line_ending).text(path)

    def write_native(self, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
        """The same through Spark's CSV writer, for LF line ends."""
        if self.options.line_ending != "\n":
            raise ValueError("the native writer changes line feeds in fields where lines end with CRLF")
        cells = [x.alias(K.encoded_key(n, self.options.keys)) for n, x in self._cells(df.schema)]
        options = {"header": str(self.options.has_headers).lower(), "sep": self.options.delimiter, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        df.select(*cells).write.mode(mode).options(**options).csv(path)


def numbered(df: DataFrame, keys: list[str], into: str = "__n") -> DataFrame:
    """The rows numbered from 0 in the order of the keys, by range partitions; ties go by all columns.

    The partitions are written once: each evaluation of a range partitioning draws a sample and cuts bounds of its own,
    so counts of one do not fit the rows of another.
    """
    parted = kept(df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("__p").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ties = [c for c in df.columns if c not in keys]
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*keys, *ties)) - 1
    return parted.withColumn("__i", inside).join(F.broadcast(before.select("__p", "__before")), "__p").withColumn(into, F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")
