"""Word boundaries and word hashes of whole Arrow text columns, computed with numpy.

A column of texts is cut into blocks of about ``BLOCK_BYTES`` so that the byte-level temporaries stay small however
long a text is; only word-level arrays (16 bytes a word) are kept for a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
U64 = np.uint64

#: Odd multipliers, one for each independent hash.
BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
#: Keeps the first n bytes of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Word bytes of ``[^\x20\x09-\x0D]+``: whatever is not ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all that is not ASCII.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values land far apart."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def joined(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of what ``a`` stands for followed by what ``b`` stands for."""
    h = a * BASES[which]
    h += b
    return mix(h)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash the bytes of each word: every eight bytes are mixed with a key of their place, and the results summed.

    Each eight bytes pass a bijection of their own before they meet the others, so no arithmetic pattern in a long word
    cancels out. Different ``which`` are independent from the bytes on.
    """
    if not len(start):
        return np.empty(0, dtype=U64)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    seed = BASES[which]
    total = mix((at[start] & MASKS[np.minimum(size, 8)]) ^ seed)
    long = np.flatnonzero(size > 8)
    if len(long):
        many = (size[long] - 1) // 8
        first = np.cumsum(many) - many
        place = np.arange(1, int(many.sum()) + 1) - np.repeat(first, many)
        left = np.repeat(size[long], many) - 8 * place
        rest = at[np.repeat(start[long], many) + 8 * place] & MASKS[np.minimum(left, 8)]
        total[long] += np.add.reduceat(mix(rest ^ mix(place.astype(U64) * seed)), first)
    return mix(total + size.astype(U64) * seed)


@dataclass
class Words:
    """Words of a run of texts: bytes of each word in ``data`` (already lower-cased if asked), ``doc`` its text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.per_doc)))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0 or texts.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = False, which: int = 0, hashed: bool = True) -> Words:
    """Cut texts into maximal runs of ``keep`` bytes and hash each run."""
    raw, offsets = text_buffers(texts)
    data = LOWER[raw] if lower else raw
    n = len(data)
    starts, ends, hashes = [], [], []
    at = 0
    while at < n:
        to = min(n, at + BLOCK_BYTES)
        while to < n and keep[data[to - 1]] and keep[data[to]]:
            step = data[to : to + 4096]
            gap = np.flatnonzero(~keep[step])
            to += int(gap[0]) if len(gap) else len(step)
        inside = keep[data[at:to]]
        cuts = offsets[(offsets > at) & (offsets < to)] - at
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[cuts] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if hashed:
            hashes.append(hash_words(data[at:to], s, e, which))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    none = np.empty(0, dtype=np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    per_doc = np.diff(np.searchsorted(start, offsets))
    return Words(data, start, end, np.repeat(np.arange(len(per_doc)), per_doc), per_doc, np.concatenate(hashes) if hashes else np.empty(0, dtype=U64))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``size`` consecutive words inside one text.

    Hashes of 1, 2, 4, ... words are joined pair by pair; a run is put together from those that ``size`` is the sum of.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
    level, span, done, run = hashes, 1, 0, None
    while True:
        if size & span:
            part = level[done : done + n]
            run = part if run is None else joined(run, part, which)
            done += span
        if done == size:
            break
        level = joined(level[:-span], level[span:], which)
        span *= 2
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return first, mix(run[first] + U64(size))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts reach about ``most`` bytes; a longer text stands alone."""
    index = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(lengths):
        if i > at and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def signed(h: np.ndarray) -> pa.Array:
    """A hash column as Spark has it."""
    return pa.array(h.view(np.int64))


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))
