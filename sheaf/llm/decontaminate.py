"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ``window`` consecutive words (a shorter item is one window). A window's tokens are its
``SHINGLE``-word shingles. Containment of the whole window needs every token, so the necessary prefix, once tokens are
ordered by how rare they are in the corpus, is the single rarest one. Documents are probed with those prefix tokens
alone; a probe that matches at some word gives the only place where the window can lie (positional bound), which must
fit inside the document (length bound); it then counts if all words are equal, byte for byte.

Benchmarks are handled in blocks of at most ``BLOCK_BYTES`` of text, so the broadcast index has a fixed bound and a
larger benchmark means more passes, not a larger broadcast. Documents are never shuffled.

Defined results: a null or wordless document has no words and no hits; null and wordless items have no windows; null
item ids are read as the empty string; repeated items count once; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import unused
from sheaf.storage import kept

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
])


def _words(texts: pa.Array) -> tk.Words:
    return tk.words_of(texts, tk.ALNUM, lower=True)


def shingles(words: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and token of each run of ``size`` words."""
    return tk.windows(words.hash + tk.U64(size), words.doc, size)


def flat_bytes(words: tk.Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words one after another, and each word's length."""
    size = words.end[index] - words.start[index]
    before = np.cumsum(size) - size
    return words.data[np.repeat(words.start[index] - before, size) + np.arange(size.sum())], size


@dataclass
class Probe:
    """Windows of one block of items, by prefix token; ``sizes`` are the shingle sizes that occur."""

    words: tk.Words
    names: list[str]
    first: np.ndarray  # of each window, its first word in ``words``
    length: np.ndarray
    item: np.ndarray
    tokens: dict[int, np.ndarray]  # by shingle size: each window's tokens' hashes, flat
    owner: dict[int, np.ndarray]  # the window of each token
    offset: dict[int, np.ndarray]  # the token's place in its window
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    @classmethod
    def of(cls, ids: list[str], texts: pa.Array, window: int) -> Probe:
        words = _words(texts)
        start = words.first
        first, length, item = [], [], []
        for i, n in enumerate(words.per_doc.tolist()):
            size = min(n, window)
            at = np.arange(start[i], start[i] + (n - size + 1 if n else 0))
            first.append(at)
            length.append(np.full(len(at), size))
            item.append(np.full(len(at), i))
        none = [np.empty(0, dtype=np.int64)]
        first, length, item = (np.concatenate(x or none) for x in (first, length, item))
        out = cls(words, ids, first, length, item, {}, {}, {})
        for size in sorted({min(SHINGLE, int(n)) for n in np.unique(length)}):
            at, token = shingles(words, size)
            by_word = np.zeros(len(words.hash) + 1, dtype=tk.U64)
            by_word[at] = token
            mine = np.flatnonzero(np.minimum(SHINGLE, length) == size)
            many = length[mine] - size + 1
            out.owner[size] = np.repeat(mine, many)
            out.offset[size] = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.tokens[size] = by_word[first[out.owner[size]] + out.offset[size]]
        return out

    def vocabulary(self) -> dict[int, np.ndarray]:
        return {size: np.unique(x) for size, x in self.tokens.items()}

    def order(self, seen: dict[int, dict[int, int]]) -> Probe:
        """Choose each window's rarest token; ties go to the smaller hash."""
        self.prefix = {}
        for size, token in self.tokens.items():
            counts = seen.get(size, {})
            rarity = np.array([counts.get(x, 0) for x in token.view(np.int64).tolist()], dtype=np.int64)
            order = np.lexsort((token, rarity, self.owner[size]))
            lead = order[np.concatenate(([True], np.diff(self.owner[size][order]) != 0))] if len(order) else order
            lead = lead[np.argsort(token[lead], kind="stable")]
            self.prefix[size] = (token[lead], self.owner[size][lead], self.offset[size][lead])
        self.tokens, self.owner, self.offset = {}, {}, {}
        return self

    def occurrences(self, doc: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """First document word and window of every occurrence of a window."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        begin = doc.first
        for size, (token, owner, offset) in self.prefix.items():
            at, hashes = shingles(doc, size)
            hit = member(hashes, token)
            at, hashes = at[hit], hashes[hit]
            low, high = np.searchsorted(token, hashes, "left"), np.searchsorted(token, hashes, "right")
            many = high - low
            probe = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window = owner[probe]
            start = np.repeat(at, many) - offset[probe]
            text = np.repeat(doc.doc[at], many)
            fits = (start >= begin[text]) & (start + self.length[window] <= begin[text + 1])
            found.append(self.verified(doc, start[fits], window[fits]))
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def verified(self, doc: tk.Words, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose words are all equal: by hash first, then by bytes."""
        for k in range(int(self.length.max(initial=0))):
            inside = k < self.length[window]
            same = doc.hash[np.where(inside, start + k, 0)] == self.words.hash[np.where(inside, self.first[window] + k, 0)]
            start, window = start[same | ~inside], window[same | ~inside]
        many = self.length[window]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ours, size = flat_bytes(doc, np.repeat(start, many) + step)
        theirs, other = flat_bytes(self.words, np.repeat(self.first[window], many) + step)
        if len(ours) == len(theirs) and np.array_equal(size, other) and np.array_equal(ours, theirs):
            return start, window
        good = np.array([all(doc.bytes_of(a + k) == self.words.bytes_of(self.first[w] + k) for k in range(self.length[w])) for a, w in zip(start, window)], dtype=bool)
        return start[good], window[good]


def member(hashes: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` that are among the keys; a small bit table settles nearly all others."""
    if not len(sorted_keys) or not len(hashes):
        return np.empty(0, dtype=np.int64)
    bits = min(24, max(12, int(len(sorted_keys)).bit_length() + 5))
    table = np.zeros(1 << bits, dtype=bool)
    table[sorted_keys >> tk.U64(64 - bits)] = True
    maybe = np.flatnonzero(table[hashes >> tk.U64(64 - bits)])
    at = np.minimum(np.searchsorted(sorted_keys, hashes[maybe]), len(sorted_keys) - 1)
    return maybe[sorted_keys[at] == hashes[maybe]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Probe]:
    """The items on the driver, in blocks of at most about BLOCK_BYTES of text each, one at a time."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        got = rows.filter(block == b).toArrow()
        yield Probe.of(got.column("id").to_pylist(), got.column("text").combine_chunks(), window)


def rarity(docs: DataFrame, text_col: str, probe: Probe) -> dict[int, dict[int, int]]:
    """How often each token of the items occurs in all documents; at most one count a token comes back."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(probe.vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = {size: np.zeros(len(keys), dtype=np.int64) for size, keys in known.items()}
        for batch in batches:
            for part in tk.slices(batch, "text"):
                words = _words(part.column(0))
                for size, keys in known.items():
                    _, hashes = shingles(words, size)
                    total[size] += np.bincount(np.searchsorted(keys, hashes[member(hashes, keys)]), minlength=len(keys))
        for size, keys in known.items():
            some = total[size] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), size, dtype=np.int32)), tk.signed(keys[some]), pa.array(total[size][some])], ["size", "token", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "size int, token long, n long").groupBy("size", "token").agg(F.sum("n").alias("n"))
    seen: dict[int, dict[int, int]] = {}
    for size, token, n in rows.toLocalIterator():
        seen.setdefault(size, {})[token] = n
    return seen


def _lists(values: pa.Array, per_row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32()), values)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", into: str = "contamination") -> DataFrame:
    """All rows and columns, and a struct: n_words, n_hit, items that occur, and first and past-last words hit.

    ``into`` names the struct; a trailing ``_`` is added where the name is taken.
    """
    into = unused(docs, into)
    out, index = docs, None
    for probe in item_blocks(items, id_col, item_text, window):  # no enumerate: it would hold the block before
        first = index is None
        if not first:
            out = kept(out, "decontaminated")
            index.unpersist()
        seen = rarity(docs, text_col, probe)
        index = docs.sparkSession.sparkContext.broadcast(probe.order(seen))
        del probe, seen
        out = _scan(out, text_col, index, into, first)
    return out


def _scan(docs: DataFrame, text_col: str, index, into: str, first: bool) -> DataFrame:
    column = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe: Probe = index.value
        names = np.array(probe.names, dtype=object)
        for batch in batches:
            for part in tk.slices(batch, text_col):
                words = _words(part.column(column))
                begin = words.first
                start, window = probe.occurrences(words)
                end = start + probe.length[window]
                pairs = np.unique(np.stack((words.doc[start], probe.item[window])), axis=1)
                rows, ids = pairs[0], names[pairs[1]].tolist()
                if not first:
                    old = part.column(part.num_columns - 1)
                    many = old.field("starts").value_lengths().to_numpy(zero_copy_only=False)
                    base = np.repeat(begin[:-1], many)
                    start = np.concatenate((start, old.field("starts").flatten().to_numpy() + base))
                    end = np.concatenate((end, old.field("ends").flatten().to_numpy() + base))
                    rows = np.concatenate((rows, np.repeat(np.arange(part.num_rows), old.field("items").value_lengths().to_numpy(zero_copy_only=False))))
                    ids += old.field("items").flatten().to_pylist()
                cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, end, -1)
                hit = np.cumsum(cover)[:-1] > 0
                n_hit = np.bincount(words.doc[hit], minlength=part.num_rows)
                step = np.diff(hit.astype(np.int8), prepend=0)
                step[begin[:-1][words.per_doc > 0]] = hit[begin[:-1][words.per_doc > 0]]
                opens = np.flatnonzero(step == 1)
                closing = np.zeros(len(hit), dtype=bool)
                if len(hit):
                    closing[:-1] = hit[:-1] & (~hit[1:] | (words.doc[:-1] != words.doc[1:]))
                    closing[-1] = hit[-1]
                closes = np.flatnonzero(closing) + 1
                owner = words.doc[opens]
                per_row = np.bincount(owner, minlength=part.num_rows)
                unique = sorted(set(zip(rows.tolist(), ids)))
                result = pa.StructArray.from_arrays(
                    [
                        pa.array(words.per_doc.astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)),
                        _lists(pa.array([x for _, x in unique], pa.string()), np.bincount([r for r, _ in unique], minlength=part.num_rows) if unique else np.zeros(part.num_rows, dtype=np.int64)),
                        _lists(pa.array((opens - begin[owner]).astype(np.int32)), per_row),
                        _lists(pa.array((closes - begin[owner]).astype(np.int32)), per_row),
                    ],
                    RESULT.names,
                )
                own = part.columns if first else part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, result], [*part.schema.names[: len(own)], into])

    fields = docs.schema.fields if first else docs.schema.fields[:-1]
    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField(into, RESULT)]))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents without a hit, with their columns."""
    into = unused(docs, "contamination")
    return contamination(docs, items, window, text_col=text_col, into=into).filter(F.col(into)["n_hit"] == 0).drop(into)
