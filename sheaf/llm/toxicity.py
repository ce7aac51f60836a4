"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents and look-alike letters of other scripts to Latin letters, digits and symbols
that stand for letters to those letters, the letters i, l and the strokes like them to i, anything else to a space.
Lexicon terms are word beginnings (or whole words) that the labels show to be much commoner in toxic documents; a
term's weight is its log odds. Exception phrases take the matches inside them away: a fixed list, and whole words that
clean labelled documents use although they begin like a term. The sum of weights over the text's length in words goes
through a logistic function fitted on the labelled sample.

Labels are learned from samples of at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows. All documents are scored whole, where they lie.

Defined results: null and empty texts have no match and score the lowest score; without labels the fixed seed terms are
used with equal weights. Repeated rows get equal scores. Other columns are passed on untouched.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import unused
from sheaf.llm.labels import sample

#: Most toxic labelled rows that the lexicon and the logistic function are learned from; of clean ones three times that.
TOXIC_ROWS = 2000
CLEAN_ROWS = 3 * TOXIC_ROWS
LENGTHS = range(4, 11)
#: Most candidate terms that come to the driver, by how many toxic documents of the sample have them.
CANDIDATES = 20_000
LEAST_DOCS = 4
LEAST_WEIGHT = 2.0
THRESHOLD = 0.5

# Terms for corpora without labels, and phrases in which such words are harmless.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "imbecile", "retard", "bastard", "bitch", "asshole", "fuck", "shithead", "whore", "slut")
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bag", "trash bin", "trash collection", "stupid mistake", "sore loser", "pathetic fallacy", "retard the", "retardant", "retardation of", "scum layer", "pond scum", "class clown", "circus clown")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "ß": "b",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "¡": "i"}
INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    ranges = [*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2500)]
    known = {**LOOKALIKES, **DIGITS}
    for c in [*range(128), *ranges, *map(ord, known)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        base = "".join(known.get(x, x) for x in base) if base else ""
        if base and base.isalnum() and len(base) <= 2:
            table[c] = base.replace("l", "i")
    table |= {c: None for c in [*map(ord, INVISIBLE), *range(0x0300, 0x0370)]}
    table |= {c: " " for c in (*range(0x80, 0xC0), *range(0x2000, 0x2070)) if c not in table}
    return table


FOLD = _fold_table()


def folded(text: str | None) -> list[str]:
    """The words of a text after folding."""
    return (text or "").lower().translate(FOLD).split()


def terms_of(words: set[str]) -> set[str]:
    """Candidate terms: word beginnings as they are, whole words with a space after them."""
    return {w[:n] for w in words for n in LENGTHS if len(w) >= n} | {f"{w} " for w in words if len(w) >= 3}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    bias: float = -1.0
    _matcher: object = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    def matcher(self):
        """Terms start at a word's start; an automaton is built once in each worker."""
        if self._matcher is None:
            found: dict[str, tuple[float, int]] = {f" {t}": (w, len(t) + 1) for t, w in self.weights.items()}
            for phrase in self.exceptions:
                found[f" {phrase} "] = (0.0, len(phrase) + 2)
            machine = ahocorasick.Automaton()
            for key, value in found.items():
                machine.add_word(key, value)
            machine.make_automaton()
            self._matcher = machine
        return self._matcher

    def matches(self, words: list[str]) -> tuple[float, list[int]]:
        """Sum of the weights that no exception covers, and where they start in the joined text."""
        if not self.weights or not words:
            return 0.0, []
        hits, spared = [], []
        for end, (weight, size) in self.matcher().iter(f" {' '.join(words)} "):
            (hits if weight else spared).append((end - size + 1, end, weight))
        if spared:
            hits, spared, reach, at = sorted(hits), sorted(spared), -1, 0
            free = []
            for hit in hits:  # reach: how far the phrases go that start no later
                while at < len(spared) and spared[at][0] <= hit[0]:
                    reach, at = max(reach, spared[at][1]), at + 1
                if hit[1] > reach:
                    free.append(hit)
            hits = free
        return sum(h[2] for h in hits), [h[0] for h in hits]

    def density(self, words: list[str]) -> float:
        """Length-normalised weight on a log scale, 0 without matches."""
        return float(np.log1p(1000 * self.matches(words)[0] / (len(words) + 20)))

    def score(self, words: list[str]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.density(words) + self.bias, -60, 60))))


def _counted(pick):
    """Count (term, label) over the documents of a task; ``pick`` gives a document's terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((term, label) for term in pick(folded(text)))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "label", "n"])

    return count


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one feature, classes weighed equally, with a light penalty on the slope."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    slope, bias = 1.0, -1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(slope * x + bias)))
        g = np.array([(share * (p - y) * x).sum() + 1e-4 * slope, (share * (p - y)).sum() + 1e-4 * bias])
        w = share * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-4, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-4]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, bias = slope - move[0], bias - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(slope), float(bias)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Lexicon:
    """Lexicon, exceptions and logistic function from labelled rows that are not held out."""
    rows = sample(docs, labels, label, (clean_rows, toxic_rows))
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    exceptions = [" ".join(folded(x)) for x in EXCEPTIONS]
    seeds = {folded(x)[0]: 3.0 for x in SEEDS}
    if not toxic or not clean:
        return Lexicon(seeds, exceptions)
    schema = "term string, label int, n long"
    common = rows.filter("label = 1").mapInArrow(_counted(lambda words: terms_of(set(words))), schema).groupBy("term").agg(F.sum("n").alias("n"))
    least = max(LEAST_DOCS, toxic // 200)
    bad = {r.term: r.n for r in common.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(bad))
    good = {r.term: r.n for r in rows.filter("label = 0").mapInArrow(_counted(lambda words: terms_of(set(words)) & wanted.value), schema).groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def weight(term: str) -> tuple[float, float]:
        a, b = bad.get(term, 0), good.get(term, 0)
        if not a:
            return 0.0, 0.0
        expected = (a + b) * toxic / (toxic + clean), (a + b) * clean / (toxic + clean)
        g2 = 2 * (a * np.log(a / expected[0]) + (b * np.log(b / expected[1]) if b else 0))
        return float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))), float(g2)

    # Significant among so many candidates: less than one term is expected by chance.
    least_g2 = 2 * np.log(2 * max(1, len(bad)))
    chosen: dict[str, float] = {}
    for term, (w, g2) in sorted(((t, weight(t)) for t in bad), key=lambda x: (-x[1][0], -len(x[0]), x[0])):
        if w >= LEAST_WEIGHT and g2 >= least_g2 and not any(t.startswith(term) or term.startswith(t) for t in chosen):
            chosen[term] = w
    for term, w in seeds.items():  # unless the labels know better
        if weight(term)[0] >= 0 and not any(t.startswith(term) or term.startswith(t) for t in chosen):
            chosen[term] = w
    lexicon = Lexicon(chosen, exceptions)

    def matched(words: list[str]) -> set[str]:
        joined = " " + " ".join(words) + " "
        return {joined[at + 1 : joined.index(" ", at + 1)] for at in lexicon.matches(words)[1]}

    uses: dict[str, list[int]] = {}
    for r in rows.mapInArrow(_counted(matched), schema).groupBy("term", "label").agg(F.sum("n").alias("n")).collect():
        uses.setdefault(r.term, [0, 0])[r.label] = r.n
    lexicon.exceptions += sorted(w for w, (b, a) in uses.items() if b >= 2 and b / clean > a / toxic)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(folded(x)) for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["x", "y"])

    at = rows.mapInArrow(densities, "x double, y int").toPandas().sort_values(["x", "y"])
    if (at["x"] > 0).any():  # else the defaults stand: no match, not toxic
        lexicon.slope, lexicon.bias = _fit(at["x"].to_numpy(), at["y"].to_numpy())
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns, and the score; ``into`` gets a trailing ``_`` where the name is taken."""
    into = unused(docs, into)
    shared, column = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                scores = [shared.value.score(folded(x)) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, into])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
