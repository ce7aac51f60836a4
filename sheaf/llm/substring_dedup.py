"""Repeated passages, found through a count-min sketch.

A window is ``window`` consecutive words. Each window is represented by its minimizer, the word k-gram with the least
hash in it (the first of equals): equal windows have equal minimizers at equal places, so a window that occurs twice has
a minimizer that occurs twice, at two places even where the occurrences overlap. Tasks sketch the minimizers of their
texts; merging the sketches by cell overestimates counts, never underestimates them. Cells counted once are dropped and
the others come back as one bitmap per row of the sketch, of a fixed size, that is broadcast to the second pass. That
pass hashes the windows whose minimizer is estimated repeated in every row, and groups them exactly, by 96 bits from two
hashes that are independent from the words' bytes on; windows that occur more than once then mark the words they cover. A fuller sketch only lets more windows through to the exact
grouping; it never loses one.

Defined results: words are runs without ASCII white space, unchanged; a null, empty or blank text has none; texts
shorter than a window keep all words. Windows are judged on the input. Repeated rows repeat each other's windows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import textkit as tk
from sheaf.llm.joins import broadcast_if_small
from sheaf.storage import kept

WINDOW = 50
GRAM = 8
#: Rows of the sketch, and the least and most bits of a row; a row has about CELLS cells a minimizer up to the most.
ROWS = 2
CELLS = 8
LEAST_BITS, MOST_BITS = 16, 27
#: Cells of a row come back in blocks of 2**BLOCK_BITS.
BLOCK_BITS = 20
ROW_BYTES = 48


def gram_size(window: int) -> int:
    return max(1, min(GRAM, window // 2))


def minimizers(words: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, first word of its minimizer, and the hashes of all k-grams by first word."""
    k = gram_size(window)
    first, grams = tk.windows(words.hash, words.doc, k)
    span = window - k + 1
    n = len(words.hash)
    by_word = np.full(n + span, np.iinfo(np.uint64).max, dtype=tk.U64)
    by_word[first] = grams
    starts = np.flatnonzero(words.doc[: max(0, n - window + 1)] == words.doc[window - 1 :]) if n >= window else np.empty(0, dtype=np.int64)
    # Doubling: the place of the least hash in 1, 2, 4, ... k-grams from each word on, the first of equals.
    least, size = np.arange(n + span), 1
    while 2 * size <= span:
        a, b = least[:-size], least[size:]
        least = np.where(by_word[b] < by_word[a], b, a)
        size *= 2
    a, b = least[starts], least[starts + span - size]
    return starts, np.where(by_word[b] < by_word[a], b, a), by_word


def cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each k-gram in each row of the sketch."""
    return [(tk.mix(grams ^ tk.U64(r + 1)) >> tk.U64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def sketch(slim: DataFrame, window: int) -> tuple[int, list[np.ndarray]]:
    """Bits of a row, and for each row of the merged sketch the bitmap of cells counted more than once."""
    words = slim.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // 5
    expected = max(1, 2 * words // (window - gram_size(window) + 2))
    bits = min(MOST_BITS, max(LEAST_BITS, int(CELLS * expected).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                _, least, by_word = minimizers(tk.words_of(part.column(0)), window)
                grams = by_word[np.unique(least)]
                for r, cell in enumerate(cells(grams, bits)):
                    cell, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell + (r << MOST_BITS), pa.int32()), pa.array(np.minimum(n, 2), pa.int32())], ["cell", "n"])

    merged = slim.select("text").mapInArrow(count, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    blocks = merged.groupBy(F.shiftright("cell", BLOCK_BITS).alias("block")).agg(F.collect_list(F.col("cell").bitwiseAND((1 << BLOCK_BITS) - 1)).alias("cells"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in zip(batch.column(0).to_pylist(), range(batch.num_rows)):
                bitmap = np.zeros(1 << BLOCK_BITS, dtype=bool)
                bitmap[batch.column(1)[row].values.to_numpy()] = True
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bitmap).tobytes()])], ["block", "bits"])

    maps = [np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8) for _ in range(ROWS)]
    size = 1 << (BLOCK_BITS - 3)
    for block, packed in blocks.mapInArrow(pack, "block int, bits binary").toLocalIterator():
        row, at = block >> (MOST_BITS - BLOCK_BITS), (block & ((1 << (MOST_BITS - BLOCK_BITS)) - 1)) * size
        got = np.frombuffer(packed, dtype=np.uint8)[: len(maps[row]) - at]
        maps[row][at : at + len(got)] = got
    return bits, maps


def estimated(words: tk.Words, window: int, bits: int, maps: list[np.ndarray]) -> np.ndarray:
    """First words of the windows that the sketch cannot rule out."""
    starts, least, by_word = minimizers(words, window)
    if not len(starts):
        return starts
    places, which = np.unique(least, return_inverse=True)
    maybe = np.ones(len(places), dtype=bool)
    for bitmap, cell in zip(maps, cells(by_word[places], bits)):
        maybe &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return starts[maybe[which]]


def _window_rows(slim: DataFrame, window: int, shared) -> DataFrame:
    """(h, tail, id, row): the hash of each window that may be repeated, the rest of its hash with its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, maps = shared.value
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                words = tk.words_of(part.column(2))
                at = estimated(words, window, bits, maps)
                doc = words.doc[at]
                first, one = tk.windows(words.hash, words.doc, window)
                _, two = tk.windows(tk.hash_words(words.data, words.start, words.end, 1), words.doc, window, 1)
                place = np.searchsorted(first, at)
                tail = (two[place] >> tk.U64(32) << tk.U64(32)) | (at - words.first[doc]).astype(tk.U64)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([tk.signed(one[place]), tk.signed(tail), part.column(0).take(take), part.column(1).take(take)], ["h", "tail", "id", "row"])

    return slim.mapInArrow(run, "h long, tail long, id long, row long")


RESULT = "id long, n_words long, n_removed long, kept string"


def _result(ids: pa.Array, words: tk.Words, gone: np.ndarray) -> pa.RecordBatch:
    """Counts and the words that stay, joined by one space."""
    rows = len(words.per_doc)
    stay = np.flatnonzero(~gone)
    cut = np.searchsorted(words.doc[stay], np.arange(rows + 1))
    data = words.data.tobytes()
    a, b = words.start[stay].tolist(), words.end[stay].tolist()
    texts = [b" ".join([data[i:j] for i, j in zip(a[cut[d] : cut[d + 1]], b[cut[d] : cut[d + 1]])]).decode() for d in range(rows)]
    removed = words.per_doc - np.diff(cut)
    return pa.RecordBatch.from_arrays([ids, pa.array(words.per_doc.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])


def _parted(slim: DataFrame, window: int, shared) -> tuple[DataFrame, DataFrame]:
    """Results of the texts in which the sketch rules out every window, and the other rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        bits, maps = shared.value
        for batch in batches:
            for part in tk.slices(batch, "text"):
                words = tk.words_of(part.column(2))
                maybe = np.zeros(part.num_rows, dtype=bool)
                maybe[words.doc[estimated(words, window, bits, maps)]] = True
                yield part, maybe

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, maybe in rows(batches):
            part = part.filter(pa.array(~maybe))
            words = tk.words_of(part.column(2), hashed=False)
            yield _result(part.column(0), words, np.zeros(len(words.start), dtype=bool))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, maybe in rows(batches):
            yield part.filter(pa.array(maybe))

    return slim.mapInArrow(done, RESULT), slim.mapInArrow(left, slim.schema)


def _finish(joined: DataFrame, window: int) -> DataFrame:
    """Results of texts with the first words of their repeated windows in ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                words = tk.words_of(part.column(2), hashed=False)
                lists = part.column(3)
                cover = np.zeros(len(words.start) + 1, dtype=np.int64)
                many = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], many)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                yield _result(part.column(0), words, np.cumsum(cover)[:-1] > 0)

    return joined.mapInArrow(run, RESULT)


def repeated_windows(slim: DataFrame, window: int, shared) -> DataFrame:
    """(id, row, starts): the first words of each text's windows that occur more than once, written."""
    rows = _window_rows(slim, window, shared).select("h", F.shiftright("tail", 32).cast("int").alias("g"), "id", "row", F.col("tail").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))
    # Written, so that the join below shuffles both sides itself and Spark may split a window that very many texts share.
    counted = kept(rows.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g"), "windows")
    found = rows.join(counted, ["h", "g"]).groupBy("id", "row").agg(F.collect_set("at").alias("starts"))
    return kept(found, "repeated")


def remove_repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of each document; ``kept`` has the words that stay, joined by one space."""
    slim = _slim(docs, id_col, text_col)
    shared = slim.sparkSession.sparkContext.broadcast(sketch(slim, window))
    found = repeated_windows(slim, window, shared).withColumnsRenamed({"id": "__id", "row": "__row"})
    found = broadcast_if_small(found, found.agg(F.coalesce(F.sum(F.size("starts") + F.lit(4)), F.lit(0)).alias("n")).first().n, 8)
    clear, rest = _parted(slim, window, shared)
    joined = rest.join(found, F.col("id").eqNullSafe(F.col("__id")) & F.col("row").eqNullSafe(F.col("__row")), "left")
    return clear.unionByName(_finish(joined.select("id", "row", "text", "starts"), window))
