"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units that no piece crosses; each new unit of a batch is encoded once. Units of equal length advance
together, one character a step: hashes of all substrings that end there probe the sorted hashes of the pieces, and
vectorised maxima over the piece's length store the best score and a backpointer for each unit.

A unigram model's best path has the greatest sum of scores. A BPE model's path is the one its merges give; it is the
only path in which each two adjacent pieces are what their own text is merged to, so a step admits only pieces that are
compatible in that sense with the piece the backpointer ends in. Compatibility of two pieces is worked out once, by going
back through the merges on either side of the cut, and remembered. Characters without a piece become byte pieces (or the unknown piece).

The model file is read on the driver and broadcast (its size is fixed by the model). Only models without a normaliser
other than the marking of spaces are accepted.

Defined results: null and empty texts have no pieces; decoding gives the text back, exactly, for models with byte
pieces; only the space mark itself, where a text has it, comes back as a space. Repeated rows give repeated results. Other columns are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import unused

SPACE = "▁"
#: Units remembered by a worker before it starts afresh.
MEMORY = 400_000
NONE = -1
NEVER = -1e18


class PieceModel:
    """Pieces, scores and kinds of a model, as plain arrays that can be broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], byte: list[bool], special: list[bool], unknown: int, merges: bool, prefix: bool = True):
        self.pieces, self.unknown, self.merges, self.prefix = pieces, unknown, merges, prefix
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]}
        usable = [i for i in range(len(pieces)) if not byte[i] and not special[i] and pieces[i]]
        self.score = np.array(scores, dtype=np.float64)
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        self.ids = np.array(usable, dtype=np.int64)
        self.table = KeyTable(hashes_of([pieces[i] for i in usable]), self.ids)
        self.bytes = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if special[i] and i != unknown else " ⁇ ".encode() if i == unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: Characters inside longer pieces; any other stands alone, and a text is cut around it.
        joined = {c for i in usable if len(pieces[i]) > 1 for c in pieces[i]}
        self.inside = "".join(sorted(joined - {SPACE}))
        self.inner_space = any(SPACE in pieces[i].lstrip(SPACE) for i in usable)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_coder"}

    def coder(self) -> Coder:
        """One for each worker process: later tasks find what it has learned."""
        if "_coder" not in self.__dict__:
            self._coder = Coder(self)
        return self._coder

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        kind = _fields(data)
        if kind["normaliser"] not in ("", "identity") or kind["remove_extra"]:
            raise ValueError(f"{path}: only models without a normaliser are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = range(sp.get_piece_size())
        return cls(
            [sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], [sp.is_byte(i) for i in n],
            [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in n], sp.unk_id(), kind["model_type"] == 2, kind["prefix"],
        )


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _messages(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _fields(data: bytes) -> dict:
    """Model type and normaliser, from the model's public protocol buffer layout."""
    out = {"model_type": 1, "normaliser": "", "prefix": True, "remove_extra": True}
    for number, value in _messages(data):
        if number == 2:
            out |= {"model_type": v for k, v in _messages(value) if k == 3}
        elif number == 3:
            for k, v in _messages(value):
                if k == 1:
                    out["normaliser"] = v.decode()
                elif k in (3, 4):
                    out["prefix" if k == 3 else "remove_extra"] = bool(v)
    return out


def step_hash(before: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The hash of a text and one more character."""
    return tk.joined(before, point + tk.U64(1))


def hashes_of(texts: list[str]) -> np.ndarray:
    out, size = np.zeros(len(texts), dtype=tk.U64), np.array([len(t) for t in texts])
    for at in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > at)
        out[some] = step_hash(out[some], np.array([ord(texts[i][at]) for i in some], dtype=tk.U64))
    return out


class KeyTable:
    """Sorted 64-bit keys behind a table of their leading bits, which nearly all keys that are not there miss."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = tk.U64(64 - min(24, max(8, len(keys).bit_length() + 4)))
        self.have = np.zeros(1 << int(tk.U64(64) - self.shift), dtype=bool)
        self.have[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` of those that are in the table, and their values."""
        at = np.flatnonzero(self.have[keys >> self.shift])
        some = keys[at]
        place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        good = self.keys[place] == some
        return at[good], self.values[place[good]]


class Pairs:
    """What is known of pairs of pieces: an open-addressed table of a fixed size, emptied when it is three quarters full."""

    def __init__(self, bits: int = 20):
        self.bits, self.used = bits, 0
        self.keys, self.ok = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=bool)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix(keys.astype(tk.U64)) >> tk.U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is known, and whether it is good."""
        slot = self._slots(keys)
        known, ok = self.keys[slot] == keys, self.ok[slot]
        open_ = np.flatnonzero(~known & (self.keys[slot] != -1))
        while len(open_):  # the slot has another pair: try the next one
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            known[open_], ok[open_] = self.keys[at] == keys[open_], self.ok[at]
            open_ = open_[~known[open_] & (self.keys[at] != -1)]
        return known, ok

    def put(self, keys: list[int], ok: list[bool]) -> None:
        if self.used + len(keys) > 3 << self.bits - 2:
            self.keys[:], self.used = -1, 0
        self.used += len(keys)
        for key, good, slot in zip(keys, ok, self._slots(np.array(keys, dtype=np.int64)).tolist()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ok[slot] = key, good


class Coder:
    """Encodes and decodes; holds what it has learned about units and pairs of pieces."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.memory: dict[str, bytes] = {}
        self.pairs = Pairs()
        self.split: dict[int, tuple[int, int] | None] = {}
        self.irregular: set[int] = set()
        self.by_text = {model.pieces[i]: int(i) for i in model.ids}
        chars = re.escape(model.inside)
        # A unit: a run of spaces and what follows, as long as pieces can join it; or one lone character.
        self.units = re.compile(f"{SPACE}+[{chars}]*|[{chars}]+|[^{chars}{SPACE}]" if not model.inner_space else r"(?s).+")

    def prepared(self, text: str) -> str:
        return (SPACE if self.m.prefix and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str, but: int = NONE) -> list[int]:
        """Merge adjacent symbols, the best score first and the leftmost of equals; never to the piece ``but``."""
        symbols = list(text)
        while len(symbols) > 1:
            best = None
            for i in range(len(symbols) - 1):
                piece = self.by_text.get(symbols[i] + symbols[i + 1])
                if piece is not None and piece != but and (best is None or self.m.score[piece] > best[0]):
                    best = (self.m.score[piece], i)
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        return [self.by_text.get(s, NONE) for s in symbols]

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one, or None for a character and for what no merge makes."""
        if piece not in self.split:
            pieces, score = self.m.pieces, self.m.score
            text = pieces[piece]
            best = None
            if len(text) > 1:  # without its last merge, the text stays in two: of all cuts the one that merging leaves
                symbols = self.merged(text, piece)
                best = (symbols[0], symbols[1]) if len(symbols) == 2 and NONE not in symbols else None
            self.split[piece] = best
            if any(len(pieces[h]) > 1 and score[h] <= score[piece] for h in best or ()):
                self.irregular.add(piece)
        return self.split[piece]

    def whole(self, piece: int) -> bool:
        """Whether merging the piece's own text gives the piece."""
        return len(self.m.pieces[piece]) == 1 or self.halves(piece) is not None

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces apart.

        Walks inwards along the cut: whichever side was merged later is taken apart, and a merge across the cut that
        comes before the one taken apart (or as early and further left) would have been made first.
        """
        if not self.whole(b) or a != NONE and not self.whole(a):
            return False
        if a == NONE:
            return True
        if a in self.irregular or b in self.irregular:  # parts that come after the whole: merge and see
            return self.merged(self.m.pieces[a] + self.m.pieces[b]) == [a, b]
        score, pieces, by_text = self.m.score, self.m.pieces, self.by_text
        left = right = None  # the merges that took a side's inner neighbour away: its score
        while True:
            across = by_text.get(pieces[a] + pieces[b])
            if across is not None:
                s = score[across]
                if (left is None or s > left) and (right is None or s >= right):
                    return False
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                return True
            # The side with the later merge, the lower score, is taken apart first; of equals the right one.
            if y is None or x is not None and score[a] < score[b]:
                left, a = score[a], x[1]
            else:
                right, b = score[b], y[0]

    def compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece can follow; NONE before it is a start or a character without a piece."""
        size = len(self.m.pieces)
        keys = (before + 1) * size + piece
        known, ok = self.pairs.get(keys)
        if not known.all():
            new = np.unique(keys[~known]).tolist()
            good = [self.follows(key // size - 1, key % size) for key in new]
            place = np.searchsorted(new, keys[~known])
            ok[~known] = np.array(good)[place]
            self.pairs.put(new, good)
        return ok

    def viterbi(self, units: list[str]) -> list[bytes]:
        """Best paths of units of one length, as four bytes a piece."""
        rows, length = len(units), len(units[0])
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(rows, length).astype(tk.U64)
        best = np.full((rows, length + 1), NEVER)
        best[:, 0] = 0
        back = np.zeros((rows, length + 1), dtype=np.int64)
        last = np.full((rows, length + 1), NONE, dtype=np.int64)
        lone = float(self.m.score.min()) - 10
        hashes = np.zeros((self.m.longest, rows), dtype=tk.U64)  # of the substrings that end here, by length
        for end in range(1, length + 1):
            best[:, end], back[:, end] = best[:, end - 1] + lone, end - 1  # no piece ends here but the character alone
            hashes[1:] = hashes[:-1].copy()
            hashes[0] = 0
            hashes = step_hash(hashes, points[:, end - 1])
            at, piece = self.m.table.find(hashes[:end].ravel())
            size, row = at // rows + 1, at % rows
            if self.m.merges:  # one path at most; were there more, the longest piece
                good = self.compatible(last[row, end - size], piece)
                row, size, piece = row[good], size[good], piece[good]
                back[row, end], last[row, end] = end - size, piece
                continue
            score = best[row, end - size] + self.m.score[piece]
            order = np.lexsort((size, -score, row))
            order = order[np.concatenate(([True], np.diff(row[order]) != 0))] if len(order) else order
            order = order[score[order] > best[row[order], end]]
            row, size, piece = row[order], size[order], piece[order]
            best[row, end], back[row, end], last[row, end] = score[order], end - size, piece
        # All units walk back together; then the pieces are put in order, unit by unit.
        row, end, steps = np.arange(rows), np.full(rows, length), []
        while len(row):
            steps.append((row, back[row, end], last[row, end]))
            end = steps[-1][1]
            row, end = row[end > 0], end[end > 0]
        row, start, piece = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((start, row))
        data, cut = piece[order].astype("<i4").tobytes(), 4 * np.cumsum(np.bincount(row, minlength=rows))
        paths = [data[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]
        for i in np.unique(row[piece == NONE]).tolist():
            paths[i] = np.array(self._with_bytes(units[i], np.frombuffer(paths[i], dtype="<i4").tolist()), dtype="<i4").tobytes()
        return paths

    def learn(self, units: set[str]) -> None:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        by_length: dict[int, list[str]] = {}
        for unit in units:
            by_length.setdefault(len(unit), []).append(unit)
        for same in by_length.values():
            for at in range(0, len(same), 4096):
                part = same[at : at + 4096]
                self.memory.update(zip(part, self.viterbi(part)))

    def _with_bytes(self, unit: str, path: list[int]) -> list[int]:
        out, at = [], 0
        for piece in path:
            if piece != NONE:
                out.append(piece)
                at += len(self.m.pieces[piece])
                continue
            raw = [self.m.byte_ids.get(b) for b in unit[at].encode()]
            out += [self.m.unknown] if None in raw else raw
            at += 1
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.units.findall(self.prepared(t or "")) for t in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        new = {u for units in cut for u in units if u not in self.memory}
        self.learn(new)
        memory = self.memory
        return [np.frombuffer(b"".join([memory[u] for u in units]), dtype="<i4") for units in cut]

    def decode(self, ids: np.ndarray) -> str:
        table = self.m.bytes
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def encoded(docs: DataFrame, model: PieceModel, text_col: str = "text", into: str = "pieces", check_into: str = "round_trip") -> DataFrame:
    """All rows and columns, the piece ids, and whether decoding them gives the text back."""
    into = unused(docs, into)
    check_into = unused(docs, check_into)
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.coder()
        for batch in batches:
            for part in tk.slices(batch, text_col):
                texts = part.column(column).to_pylist()
                ids = coder.encode(texts)
                same = [coder.decode(i) == (t or "") for i, t in zip(ids, texts)]
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, dtype="<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same, pa.bool_())], [*part.schema.names, into, check_into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType())), T.StructField(check_into, T.BooleanType())]))


def decoded(rows: DataFrame, model: PieceModel, ids_col: str = "pieces", into: str = "decoded") -> DataFrame:
    """All rows and columns, and the text of the piece ids; null ids give null."""
    into = unused(rows, into)
    shared, column = rows.sparkSession.sparkContext.broadcast(model), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.coder()
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, dtype=np.int64)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))
