"""Quality classifier: supervised subword embeddings.

Words and character n-grams (of the UTF-8 bytes, spaces included) are hashed into buckets, and so is the mark of a word
that repeats the one before it. Each bucket has a learned vector; a document is the average of its features' vectors,
and a softmax over two classes follows. Vectors and output weights are trained together by plain numpy stochastic
gradient descent on the driver, over a sample of at most ``SAMPLE`` labelled rows whose features are computed on the
executors. The softmax of two classes is linear in the average, so scoring folds vectors and output weights into one
number a bucket; all documents are scored whole, where they lie, without a shuffle.

Defined results: null and empty texts have no features and score the learned bias; without any labelled row every score
is 0.5. Repeated rows get equal scores. Other columns are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import unused
from sheaf.llm.labels import sample

#: Most labelled rows that training takes; the rest of the labels is not needed.
SAMPLE = 2500
BITS = 17
GRAMS = (3, 4)
DIM = 8
#: Steps of gradient descent, one document each: a smaller sample is gone through more often.
STEPS = 12_500
RATE = 1.0
THRESHOLD = 0.3
SHIFT = tk.U64(64 - BITS)
#: The bucket of "repeats the word before".
AGAIN = tk.mix(np.array([1], dtype=tk.U64))[0] >> SHIFT


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (text's index, bucket), over all features of all texts."""
    words = tk.words_of(texts)
    yield words.doc, (words.hash >> SHIFT).astype(np.int64)
    if len(words.hash) > 1:
        same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]))
        yield words.doc[same], np.full(len(same), AGAIN, dtype=np.int64)
    data, offsets = tk.text_buffers(texts)
    for at in range(0, len(data), tk.BLOCK_BYTES):
        block = data[at : at + tk.BLOCK_BYTES + max(GRAMS) - 1].astype(tk.U64)
        owner = np.searchsorted(offsets, np.arange(at, at + len(block)), "right") - 1
        for n in GRAMS:
            count = min(tk.BLOCK_BYTES, len(block) - n + 1)
            if count <= 0:
                continue
            gram = block[:count].copy()
            for k in range(1, n):
                gram <<= tk.U64(8)
                gram |= block[k : k + count]
            bucket = ((gram + tk.U64(n)) * tk.BASES[0]) >> SHIFT
            whole = owner[:count] == owner[n - 1 : n - 1 + count]
            yield owner[:count][whole], bucket[whole].astype(np.int64)


@dataclass
class Model:
    """``weight`` has one number a bucket; ``bias`` is the score of no features, before the logistic function."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for doc, bucket in features(texts):
            total += np.bincount(doc, self.weight[bucket], minlength=len(texts))
            n += np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -60, 60)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            n = np.zeros(1 << BITS, dtype=np.int32)
            for _, bucket in features(one.column(0)):
                n += np.bincount(bucket, minlength=1 << BITS).astype(np.int32)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([one.column(1), pa.array([some.astype("<i4").tobytes()]), pa.array([n[some].astype("<f4").tobytes()])], ["label", "bucket", "n"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out."""
    bags = []
    for row in sample(docs, labels, label, None, rows).mapInArrow(_bags, "label int, bucket binary, n binary").collect():
        n = np.frombuffer(row.n, dtype="<f4")
        bags.append((row.label, np.frombuffer(row.bucket, dtype="<i4"), n / max(1.0, float(n.sum()))))
    bags.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))  # any order of arrival gives one model
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    epochs = -(-steps // len(bags)) if bags else 0
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in draw.permutation(len(bags)):
            label_, bucket, share = bags[i]
            rate, step = RATE * (1 - step / steps), step + 1
            hidden = share @ vectors[bucket] if len(bucket) else np.zeros(DIM, dtype=np.float32)
            z = hidden @ out + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[label_] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            vectors[bucket] -= rate * np.outer(share, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns, and the probability of label 1; ``into`` gets a trailing ``_`` where the name is taken."""
    into = unused(docs, into)
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col, 1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column(column)))], [*part.schema.names, into])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
