"""Decoding and encoding in Structured Streaming, with the semantics of the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sheaf import keys as K
from sheaf import schema as S
from sheaf.operators.decode import Decoder
from sheaf.operators.encode import Encoder
from sheaf.options import MemoryOptions
from sheaf.sources import scan

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, schema: T.StructType | type | str, decoder: Decoder | None = None, header: list[str] | None = None, max_files: int | None = None, memory: MemoryOptions | None = None, keep_row: bool = False) -> DataFrame:
    """Files of a folder, as they arrive, as a table.

    A stream looks at no data while it is planned: ``header`` names the columns of all files, by default those of the
    schema in its order. Nothing is dropped when a consumer is slow; ``max_files`` or a memory budget bound a trigger.
    """
    decoder = decoder or Decoder()
    schema = S.as_schema(schema)
    scan.allow_charset(spark, decoder.options.encoding)
    reader = spark.readStream.format("binaryFile").schema(_FILES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif memory is not None:
        reader = reader.option("maxBytesPerTrigger", memory.bytes_per_trigger)
    docs = reader.load(path).select(F.col("path").alias("src"), scan.decoded(F.col("content"), decoder.options.encoding).alias("content"))
    names = K.resolved(header, [S.column_name(f) for f in schema.fields], len(schema.fields), decoder.options)
    return decoder.documents(docs, schema, keep_row, names)


def write_stream(df: DataFrame, path: str, checkpoint: str, encoder: Encoder | None = None, trigger: dict | None = None, on_batch: Callable[[int, int, int], None] | None = None) -> StreamingQuery:
    """Append each micro-batch as files of records; ``on_batch`` gets (batch, rows, bytes) of each.

    A batch goes to a folder of its own that is overwritten when it is run again, so each row is written once.
    """
    encoder = encoder or Encoder()

    def put(batch: DataFrame, number: int) -> None:
        seen = Observation()
        size = F.octet_length(encoder.row(batch.schema)) + len(encoder.options.line_ending)
        encoder.write(batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), f"{path}/batch={number:08d}", mode="overwrite")
        if on_batch:
            found = seen.get
            on_batch(number, found["rows"], found["bytes"])

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Progress:
    rows: int
    estimated_rows: int | None = None
    bytes_processed: int = 0
    total_bytes: int | None = None

    @property
    def fraction(self) -> float | None:
        return None if not self.total_bytes else min(1.0, self.bytes_processed / self.total_bytes)


def decode_with_progress(spark: SparkSession, path: str, schema: T.StructType | type | str, handler: Callable[[Progress], None], decoder: Decoder | None = None) -> Callable[[DataFrame], None]:
    """(table, report): after an action over the table, ``report`` tells the handler what was read."""
    decoder = decoder or Decoder()
    docs = scan.documents(spark, path, decoder.options.encoding)
    total, estimate = docs.agg(F.sum(F.octet_length("content")), F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))))).first()
    seen = Observation()
    table = decoder.documents(docs, S.as_schema(schema)).observe(seen, F.count(F.lit(1)).alias("rows"))
    return table, lambda: handler(Progress(seen.get["rows"], estimate, total or 0, total or 0))


def encode_with_progress(df: DataFrame, path: str, encoder: Encoder | None = None, mode: str = "errorifexists") -> Progress:
    """Write a table; the rows and bytes of its records."""
    encoder = encoder or Encoder()
    seen = Observation()
    size = F.octet_length(encoder.row(df.schema)) + len(encoder.options.line_ending)
    encoder.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), path, mode)
    return Progress(seen.get["rows"], seen.get["rows"], seen.get["bytes"], seen.get["bytes"])


class ProgressListener(StreamingQueryListener):
    """Reports rows read so far, over all batches of a streaming query."""

    def __init__(self, handler: Callable[[Progress], None]):
        self.handler, self.rows = handler, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.handler(Progress(self.rows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
