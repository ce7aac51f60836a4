"""Near duplicates by an exact n-gram Jaccard join with vertical partitioning.

A document's set has its distinct word n-grams, ordered by hash; documents with equal sets form a class, and classes are
what is joined. The global n-gram order is cut into fragments. For a size level whose sets can differ in at most D
n-grams and still be similar enough, D + 1 fragments are cut, so two linked sets agree entirely in at least one. Classes
that agree in some fragment form a bucket (spare fragments make up for those that are empty; in a set with more of those,
an empty one counts together with a fragment of a second order, so that chance brings nobody together). Sets that share
too few of the first n-grams of the order with any other set are left out beforehand. As ``MARGIN`` more fragments are cut
than sets can differ in, linked sets agree in several; classes that share fewer of a level with others are left out too,
and of what a class shares only the rarest make buckets (``buckets``).
Overlaps of candidate pairs are then counted separately in each of ``PARTS`` coarser fragments of the order and summed
per pair: first of each class with the most connected class of its buckets, after which most buckets are of one component.

A larger bucket is not tried in all pairs. In the first turn, large buckets are put together by the classes they have in
common (``HOPS``), so that a class is in about one group. Let u be the n-grams that most of a sample of its sets have (any u would do),
d(x) = x and u's symmetric difference, f(x) = |d(x)| - b |x| with b = (1 - t) / (1 + t) for similarity t, and c the set
with the least f. All sets are compared with c. Sets x and y link if |d(x)| + |d(y)| - 2 |d(x) & d(y)| <= b (|x| + |y|), so

* if d(x) and d(y) share nothing, f(x) + f(c) <= f(x) + f(y) <= 0, and x links with c, and so does y: nothing is left to do;
* else they share at least (f(x) + f(y)) / 2 n-grams, which rules most sets out, and bounds how far down the order of d(x)
  the first shared one lies: x and y meet again in that n-gram's bucket in the next turn. As u has what most sets have, an n-gram that x
  lacks or has beyond u is one that few sets lack or have: those buckets are about half as large at most.

Buckets whose members are all of one component are done. Turns go on until none is left; buckets of few classes
(``SMALL``) try their pairs at once. So no pairs of a whole group are ever made, and no link is lost. Components are
found by label propagation on verified links. No group is gathered in one task.

Classes are told apart by 128 bits from two hashes that are independent from the texts' bytes on.

Defined results: A-Z are lower-cased, words are runs without ASCII white space; texts of fewer words than n are one
n-gram; null, empty and blank texts have empty sets and no links. Equal texts link. A component is named by its
smallest id; null ids count only if there is no other. Repeated rows give repeated results. Other columns, whatever their
names, are ignored or passed on. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import row_hash, unused
from sheaf.llm.joins import BROADCAST_BYTES, HOT_SHARE, broadcast_if_small, components, hinted, in_company, lookup
from sheaf.storage import Scratch, kept

#: Defaults for corpora without a contract of their own: five words and 0.8.
N = 5
PERCENT = 80
PARTS = 8
#: Below this similarity a set has about as many fragments as n-grams; the first n-grams of the order then serve as well.
FRAGMENTS_FROM = 75
#: Buckets of up to so many classes try all pairs.
SMALL = 6
#: Pairs a class, on average, that are few enough to try them all.
PLAIN = 16
#: So often each class is held against one class of its buckets before these are looked at further.
HUB_TURNS = 1
#: A level has more fragments than linked sets can differ in by this share, so that they agree in several.
MARGIN = 0.25
#: About so many sets of a larger group say what most of it has; results do not depend on which.
SAMPLE = 16
#: Hops by which the buckets of the first turn are put together; later ones are parts of a group and stay apart.
HOPS = 2
ROW_BYTES = 64


def levels(most: int = 1 << 40, ratio: float = 1.4) -> list[int]:
    """Lower bounds of the size levels."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


LEVELS = levels()


def most_different(total: int, percent: int) -> int:
    """The most n-grams in which two sets of ``total`` n-grams together can differ with similarity percent / 100 or more."""
    return total * (100 - percent) // (100 + percent)


def sets_of(texts: pa.Array, n: int, which: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words = tk.words_of(texts, tk.NOT_SPACE, True, which)
    first, grams = tk.windows(words.hash + tk.U64(n), words.doc, n, which)
    begin = words.first
    at = np.searchsorted(first, begin)
    for i, count in enumerate(words.per_doc.tolist()):
        if count >= n:
            yield np.unique(grams[at[i] : at[i + 1]])
        elif count:
            yield tk.windows(words.hash[begin[i] : begin[i + 1]] + tk.U64(count), np.zeros(count, dtype=np.int64), count, which)[1]
        else:
            yield np.empty(0, dtype=tk.U64)


def class_of(grams: np.ndarray) -> int:
    """A hash of the whole set, as Spark's long."""
    total = tk.mix(grams ^ tk.BASES[1]).sum(dtype=tk.U64) + tk.U64(len(grams))
    return int(tk.mix(np.array([total], dtype=tk.U64)).view(np.int64)[0])


def _pieces(grams: np.ndarray, fragments: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each of the fragments, and its size."""
    where = ((grams >> tk.U64(32)) * tk.U64(fragments)) >> tk.U64(32)
    cut = np.searchsorted(where, np.arange(fragments + 1, dtype=tk.U64))
    total = np.zeros(len(grams) + 1, dtype=tk.U64)
    np.cumsum(tk.mix(grams + tk.U64(salt)), dtype=tk.U64, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]], np.diff(cut)


@lru_cache(None)
def fragments(level: int, percent: int) -> tuple[int, int]:
    """How many fragments a level has, and how many of them may be empty in a set without a second order.

    With D + 1 + z fragments two linked sets agree in z + 1 at least, so a set with e <= z empty ones agrees in z + 1 - e
    that are not empty. z is a little more than chance makes empty in the level's smallest sets, and ``MARGIN`` of D.
    """
    different = most_different(2 * (LEVELS[level + 1] - 1), percent)
    more = int(MARGIN * different)
    spare, smallest = more, max(1, LEVELS[level] * percent // 100)
    for _ in range(8):
        count = different + 1 + spare
        empty = count * math.exp(-smallest / count)
        spare = more + (math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0)
    return different + 1 + spare, spare


def signatures(grams: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """What the set may agree in with another of at least ``percent`` similarity, at its own level and those above that it can link with.

    Beside it, for each level in turn, (level, signatures, how many of these any linked set of the level has too).
    """
    n = len(grams)
    if percent < FRAGMENTS_FROM:
        first = grams[: (100 - percent) * n // 100 + 1]
        return first, [(0, len(first), 1)]
    level = bisect.bisect_right(LEVELS, n) - 2
    out, needs = [np.empty(0, dtype=tk.U64)], []
    while (level := level + 1) < len(LEVELS) - 1 and (LEVELS[level] <= n or 100 * n >= percent * LEVELS[level]):
        if most_different(2 * (LEVELS[level + 1] - 1), percent) == 0:
            continue  # only equal sets can link
        count, spare = fragments(level, percent)
        total, size = _pieces(grams, count, 1)
        place = np.arange(count, dtype=tk.U64) * tk.BASES[0] + tk.U64(level * int(tk.BASES[1]) % (1 << 64))
        own = [tk.mix(tk.mix(total + place) + size.astype(tk.U64))[size > 0]]
        empty = np.flatnonzero(size == 0)
        if len(empty) > spare:
            again, sizes = _pieces(np.sort(tk.mix(grams ^ tk.BASES[0])), count, 2)
            second = tk.mix(tk.mix(again + place) + sizes.astype(tk.U64) + tk.U64(7))
            own += [tk.mix(second + tk.mix(place[e : e + 1] + tk.U64(3))) for e in empty]
        needs.append((level, sum(map(len, own)), max(1, spare + 1 - len(empty))))
        out += own
    return np.concatenate(out), needs


def least_of(grams: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first n-grams of the order, and how many of them some other set must have if this one has a link at all."""
    missing = (100 - percent) * len(grams) // 100
    first = grams[: missing + missing // 2 + 1]
    return first, len(first) - missing


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def classes(docs: DataFrame, n: int) -> DataFrame:
    """(id, row, n, class, check) of each document; ``row`` tells texts apart that share an id, class and check are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                sizes, keys, checks = [], [], []
                for grams, others in zip(sets_of(part.column(2), n), sets_of(part.column(2), n, 1)):
                    sizes.append(len(grams))
                    keys.append(class_of(grams))
                    checks.append(class_of(others))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (sizes, keys, checks))], ["id", "row", "n", "class", "check"])

    return docs.mapInArrow(run, "id long, row long, n long, class long, check long")


def agreements(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, class, level, need) for each signature of each of the texts (class, text); ``need`` is what a linked set shares of the level's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                sigs, rows = [np.empty(0, dtype=tk.U64)], []
                for key, grams in zip(part.column(0).to_pylist(), sets_of(part.column(1), n)):
                    own, needs = signatures(grams, percent)
                    sigs.append(own)
                    rows += [(key, *x) for x in needs]
                key, level, many, need = (np.array(x, dtype=np.int64) for x in (zip(*rows) if rows else [()] * 4))
                columns = [pa.array(np.repeat(x, many)) for x in (key, level.astype(np.int32), need.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([tk.signed(np.concatenate(sigs)), *columns], ["sig", "class", "level", "need"])

    return texts.mapInArrow(run, "sig long, class long, level int, need int")


def buckets(sigs: DataFrame, into: Scratch) -> DataFrame:
    """The rows of ``agreements`` that others share, of classes that share enough of a level for a link at all.

    Of these each class keeps the rarest, but for the last ``need`` - 1: of what two linked sets share, ``need`` or more,
    the rarest is before those in both. So what very many sets have in common brings nobody together by itself.
    """
    level = Window.partitionBy("class", "level")
    for last in (False, True):  # who goes leaves others with less
        shared = in_company(sigs, "sig", "many").withColumn("have", F.count("*").over(level))
        if last:
            shared = shared.withColumn("rank", F.row_number().over(level.orderBy("many", "sig"))).filter("rank <= have - need + 1")
        sigs = into.kept(shared.filter("have >= need").select("sig", "class", "level", "need"), "agreements")
    return in_company(sigs, "sig")


def first_grams(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(gram, class, need) for the first n-grams of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                grams, keys, needs = [np.empty(0, dtype=tk.U64)], [], []
                for one in sets_of(part.column(2), n):
                    if len(one):
                        first, need = least_of(one, percent)
                        grams.append(first)
                        keys.append(class_of(one))
                        needs.append(need)
                many = [len(x) for x in grams[1:]]
                yield pa.RecordBatch.from_arrays([tk.signed(np.concatenate(grams)), pa.array(np.repeat(np.array(keys, dtype=np.int64), many)), pa.array(np.repeat(np.array(needs, dtype=np.int32), many))], ["gram", "class", "need"])

    return docs.mapInArrow(run, "gram long, class long, need int")


def vertical(texts: DataFrame, n: int) -> DataFrame:
    """(class, part, grams): each set of the texts (class, text) cut into PARTS fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                keys, parts, ends, grams = [], [], [0], []
                for key, one in zip(part.column(0).to_pylist(), sets_of(part.column(1), n)):
                    cut = np.searchsorted(one >> tk.U64(61), np.arange(PARTS + 1, dtype=tk.U64))
                    keys += [key] * PARTS
                    parts += range(PARTS)
                    grams.append(one)
                    ends += (ends[-1] + cut[1:]).tolist()
                values = np.concatenate(grams) if grams else np.empty(0, dtype=tk.U64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tk.signed(values))], ["class", "part", "grams"])

    return texts.mapInArrow(run, "class long, part int, grams array<long>")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (x, y, nx, ny) with ``both``: overlaps counted in each fragment and summed per pair."""
    some = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    count = some.count()
    if count * ROW_BYTES <= BROADCAST_BYTES:
        parts = parts.join(F.broadcast(some), "class", "left_semi")
    ours = parts.select(F.col("class").alias("x"), "part", F.col("grams").alias("gx"))
    theirs = parts.select(F.col("class").alias("y"), "part", F.col("grams").alias("gy"))
    beside = pairs.join(theirs, "y").join(ours, ["x", "part"])
    return beside.select(*pairs.columns, F.size(F.array_intersect("gy", "gx")).alias("both")).groupBy(*pairs.columns).agg(F.sum("both").alias("both"))


def _beside_hubs(pairs: DataFrame, parts: DataFrame, now: Scratch) -> DataFrame:
    """``overlaps`` of pairs whose y many may share: the n-grams of such y are broadcast, so their pairs meet in no task."""
    total = pairs.count()
    hot = now.kept(pairs.groupBy("y", "ny").agg(F.count("*").alias("many")).filter(F.col("many") > max(SMALL, total * HOT_SHARE)).select("y", "ny"), "hot")
    if hot.isEmpty():
        return overlaps(pairs, parts)
    theirs = parts.select(F.col("class").alias("y"), "part", F.col("grams").alias("gy")).join(F.broadcast(hot.select("y")), "y", "left_semi")
    theirs = broadcast_if_small(theirs, hot.agg(F.sum("ny").alias("n")).first().n, 8)
    ours = parts.select(F.col("class").alias("x"), "part", F.col("grams").alias("gx"))
    most = pairs.join(F.broadcast(hot.select("y")), "y", "left_semi")
    beside = ours.join(broadcast_if_small(most, total, ROW_BYTES), "x").join(theirs, ["y", "part"])
    shared = beside.select(*pairs.columns, F.size(F.array_intersect("gy", "gx")).alias("both")).groupBy(*pairs.columns).agg(F.sum("both").alias("both"))
    return shared.unionByName(overlaps(pairs.join(F.broadcast(hot.select("y")), "y", "left_anti").select(pairs.columns), parts))


def _hubs(buckets: DataFrame, percent: int, now: Scratch) -> DataFrame:
    """(x, y, nx, ny): each class x beside at most one other y of its buckets, the most connected one of another component."""
    weight = hinted(now.kept(buckets.groupBy("class").agg(F.sum("size").alias("weight")), "weights"), ROW_BYTES)
    heavy = F.struct("weight", F.xxhash64("class"), "class", "n", "label")
    # Of each bucket the most connected class, and the most connected one that is not of its component.
    weighed = now.kept(buckets.select("key", "class", "n", "label").join(weight, "class"), "weighed")
    first = now.kept(weighed.groupBy("key").agg(F.max(heavy).alias("h")), "leads")
    beside = now.kept(weighed.join(hinted(first, 2 * ROW_BYTES), "key"), "beside")
    other = beside.filter(F.col("label") != F.col("h.label")).groupBy("key").agg(F.max(heavy).alias("h"))
    lead = now.kept(other, "others")
    inside = beside.drop("h").join(beside.filter(F.col("label") == F.col("h.label")).select("key", "class"), ["key", "class"], "left_semi")
    offers = beside.filter(F.col("label") != F.col("h.label")).unionByName(inside.join(hinted(lead, 2 * ROW_BYTES), "key"))
    close = 100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")
    chosen = offers.filter(close).groupBy("class", "n").agg(F.max("h").alias("h"))
    return now.kept(chosen.select(F.col("class").alias("x"), F.col("h.class").alias("y"), F.col("n").alias("nx"), F.col("h.n").alias("ny")), "hubs")


def _mixed(members: DataFrame, labels: DataFrame, now: Scratch, into: Scratch) -> DataFrame:
    """The rows of buckets that still have classes of several components, labelled."""
    own = now.kept(_labelled(members.drop("label"), hinted(labels, ROW_BYTES), "class", "label"), "labelled")
    mixed = own.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    return into.kept(own.join(hinted(now.kept(mixed, "mixed"), ROW_BYTES), "key"), "members")


def _distinct_buckets(members: DataFrame) -> DataFrame:
    """Of buckets with the same classes one, with the bucket's size."""
    h = F.xxhash64("class")
    low, high, other = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 33), F.xxhash64("class", F.lit(1)).bitwiseAND(0x7FFFFFFF)
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum(low).alias("a"), F.sum(high).alias("b"), F.sum(other).alias("c"), F.min("class").alias("d"))
    chosen = sizes.filter("size > 1").groupBy("size", "a", "b", "c", "d").agg(F.min("key").alias("key")).select("key", "size")
    return members.join(chosen, "key")


def _pairs_of(small: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs x < y of different components in small buckets, of sizes that allow a link."""
    b = small.select("key", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("label").alias("other"))
    a = small.select("key", F.col("class").alias("x"), F.col("n").alias("nx"), "label")
    close = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    return a.join(b, "key").filter((F.col("x") < F.col("y")) & (F.col("label") != F.col("other")) & close).select("x", "y", "nx", "ny").distinct()


def _labelled(df: DataFrame, labels: DataFrame, key: str, into: str) -> DataFrame:
    found = labels.select(F.col("node").alias(key), F.col("label").alias("__found"))
    return df.join(found, key, "left").withColumn(into, F.coalesce("__found", key)).drop("__found")


def _merged(large: DataFrame, hops: int, now: Scratch) -> DataFrame:
    """Large buckets that lead to the same class as one group: distinct (group, class, n).

    A bucket leads to its most connected class; with each further hop, to the most connected one that a bucket with a
    class in common leads to. Whole buckets go into one group, so a class is in few.
    """
    weight = hinted(now.kept(large.groupBy("class").agg(F.sum("size").alias("weight")), "weights"), ROW_BYTES)
    rows = large.join(weight, "class").select("key", "class", "n", F.struct("weight", F.xxhash64("class"), "class").alias("lead"))
    for hop in range(hops):
        if hop:
            best = now.kept(rows.groupBy("class").agg(F.max("lead").alias("lead")), "bests")
            rows = rows.drop("lead").join(hinted(best, ROW_BYTES), "class")
        lead = now.kept(rows.groupBy("key").agg(F.max("lead").alias("lead")), "leads")
        rows = rows.drop("lead").join(hinted(lead, ROW_BYTES), "key")
    return rows.select(F.col("lead.class").alias("group"), "class", "n").distinct()


def _core(groups: DataFrame, parts: DataFrame, now: Scratch) -> DataFrame:
    """(group, part, core): in each fragment, the n-grams that most of a sample of the group's sets have."""
    sizes = now.kept(groups.groupBy("group").agg(F.count("*").alias("size")), "sizes")
    sample = groups.join(hinted(sizes, ROW_BYTES), "group").filter(F.pmod(F.xxhash64("class", "group"), F.col("size")) < SAMPLE).select("group", "class")
    sample = now.kept(sample, "sample")
    many = sample.groupBy("group").agg(F.count("*").alias("many"))
    grams = hinted(sample, ROW_BYTES).join(parts, "class").select("group", "part", F.explode("grams").alias("gram")).groupBy("group", "part", "gram").agg(F.count("*").alias("have"))
    most = grams.filter("have > 1").join(many, "group").filter("2 * have > many")
    return now.kept(most.groupBy("group", "part").agg(F.sort_array(F.collect_list("gram")).alias("core")), "core")


def _star(groups: DataFrame, parts: DataFrame, percent: int, now: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each group's sets beside its centre: (group, class, n, d, f, centre, fc, linked), and their deltas (group, class, part, more, less)."""
    core = _core(groups, parts, now)
    core = broadcast_if_small(core, core.agg(F.coalesce(F.sum(F.size("core") + F.lit(4)), F.lit(0)).alias("n")).first().n, 8)
    none = F.array().cast("array<bigint>")
    u = F.coalesce("core", none)
    cells = groups.join(parts, "class").join(core, ["group", "part"], "left")
    deltas = now.kept(cells.select("group", "class", "n", "part", F.array_except("grams", u).alias("more"), F.array_except(u, "grams").alias("less")), "deltas")
    f = (100 + percent) * F.col("d") - (100 - percent) * F.col("n")
    totals = now.kept(deltas.groupBy("group", "class", "n").agg(F.sum(F.size("more") + F.size("less")).alias("d")).withColumn("f", f), "totals")
    centres = totals.groupBy("group").agg(F.min_by(F.struct("class", "n", "d", "f"), F.struct("f", "class")).alias("c"))
    centres = now.kept(centres.select("group", F.col("c.class").alias("centre"), F.col("c.n").alias("nc"), F.col("c.d").alias("dc"), F.col("c.f").alias("fc")), "centres")
    size = centres.agg(F.coalesce(F.sum(F.col("dc") + 8 * PARTS), F.lit(0)).alias("n")).first().n
    whose = hinted(centres.select("group", F.col("centre").alias("class")), ROW_BYTES)
    theirs = broadcast_if_small(deltas.join(whose, ["group", "class"], "left_semi").select("group", "part", F.col("more").alias("more_c"), F.col("less").alias("less_c")), size, 8)
    both = F.size(F.array_intersect("more", "more_c")) + F.size(F.array_intersect("less", "less_c"))
    shared = deltas.join(theirs, ["group", "part"]).groupBy("group", "class").agg(F.sum(both).alias("both"))
    far = F.col("d") + F.col("dc") - 2 * F.col("both")
    beside = totals.join(shared, ["group", "class"]).join(hinted(centres, ROW_BYTES), "group")
    linked = (F.col("class") != F.col("centre")) & ((100 + percent) * far <= (100 - percent) * (F.col("n") + F.col("nc")))
    return now.kept(beside.withColumn("linked", linked).select("group", "class", "n", "d", "f", "centre", "fc", "linked"), "star"), deltas


def _next_keys(star: DataFrame, deltas: DataFrame, percent: int, now: Scratch) -> DataFrame:
    """(key, class, n, label): the n-grams of a set's delta of which a link that is still open needs one.

    A link shares at least (f(x) + f(y)) / 2 n-grams of both deltas, so f(x) <= 2 q(y) - f(y), where q(y) counts those
    n-grams of d(y) that another delta of the group has. One of the two is not of the centre's component (``rest``).
    """
    unsettled = hinted(now.kept(star.filter("rest").select("group").distinct(), "unsettled"), ROW_BYTES)
    grams = deltas.join(unsettled, "group", "left_semi").select("group", "class", F.explode(F.concat("more", "less")).alias("gram"))
    several = grams.groupBy("group", "gram").agg(F.count("*").alias("have")).filter("have > 1")
    common = now.kept(grams.join(several, ["group", "gram"]), "common")
    unit = 2 * (100 + percent)
    q = common.groupBy("group", "class").agg(F.count("*").alias("q"))
    with_q = now.kept(star.join(q, ["group", "class"]).withColumn("top", unit * F.col("q") - F.col("f")), "bounds")
    bounds = with_q.groupBy("group").agg(F.max("top").alias("highest"), F.max("n").alias("most"))
    with_q = with_q.join(bounds, "group")
    may = F.col("rest") & (F.col("f") <= F.col("highest")) & (F.col("top") >= F.col("fc"))
    with_q = now.kept(with_q.withColumn("may", may), "may")
    least = with_q.filter("may").groupBy("group").agg(F.min("f").alias("least"))
    with_q = with_q.join(least, "group")
    partner, size = F.when(F.col("rest"), F.col("fc")).otherwise(F.col("least")), F.least(F.col("most"), 100 * F.col("n") / percent)
    share = F.greatest(F.lit(1), F.ceil((F.col("f") + partner) / unit), F.ceil((F.col("f") - (100 - percent) * size) / (100 + percent)))
    heads = with_q.filter("may OR NOT rest AND top >= least").select("group", "class", "n", "label", (F.col("q") - share + 1).cast("int").alias("first")).filter("first > 0")
    cells = common.join(hinted(now.kept(heads, "heads"), ROW_BYTES), ["group", "class"])
    lists = cells.groupBy("group", "class", "n", "label", "first").agg(F.sort_array(F.collect_list(F.struct("have", "gram"))).alias("order"))  # the rarest first
    return lists.select(F.col("group"), "class", "n", "label", F.explode(F.slice(F.col("order.gram"), F.lit(1), F.col("first"))).alias("gram")).select(F.xxhash64("group", "gram").alias("key"), "class", "n", "label")


def class_links(members: DataFrame, parts: DataFrame, classes: int, percent: int) -> DataFrame:
    """(node, label) of all classes with links, written; ``members`` has (key, class, n), the buckets of candidates.

    Once the pairs in the buckets that are left are at most ``PLAIN`` times ``classes``, they are tried as small ones.
    """
    spark = members.sparkSession
    found, before = Scratch(spark), Scratch(spark)  # what lasts, and what the turn before has left
    members, edges, labels = members.withColumn("label", F.col("class")), None, None
    for _ in range(HUB_TURNS):
        now, after = Scratch(spark), Scratch(spark)
        members = now.kept(_distinct_buckets(members), "buckets")
        before.drop()
        counted = _beside_hubs(_hubs(members, percent, now), parts, now)
        new = found.kept(counted.filter((100 + percent) * F.col("both") >= percent * (F.col("nx") + F.col("ny"))).select("x", "y"), "links")
        edges = new if edges is None else edges.unionByName(new)
        if not new.isEmpty():
            labels = components(edges, found)
            members = _mixed(members.drop("size"), labels, now, after)
        else:
            members = after.kept(members.drop("size"), "members")
        now.drop()
        before = after
    first = True
    while True:
        now, after = Scratch(spark), Scratch(spark)
        members = now.kept(_distinct_buckets(members), "buckets")
        before.drop()
        left = members.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("pairs")).first().pairs / 2
        few = F.col("size") <= SMALL if left > PLAIN * classes else F.lit(True)
        counted = overlaps(now.kept(_pairs_of(members.filter(few), percent), "pairs"), parts)
        new = counted.filter((100 + percent) * F.col("both") >= percent * (F.col("nx") + F.col("ny"))).select("x", "y")
        groups = now.kept(_merged(members.filter(~few), HOPS if first else 1, now), "groups")
        first = False
        some = not groups.isEmpty()
        if some:
            star, deltas = _star(groups, parts, percent, now)
            new = new.unionByName(star.filter("linked").select(F.col("centre").alias("x"), F.col("class").alias("y")))
        if labels is not None:  # a link inside a component says nothing new
            side = hinted(labels, ROW_BYTES)
            new = _labelled(_labelled(new, side, "x", "a"), side, "y", "b").filter("a <> b").select("x", "y")
        new = found.kept(new, "links")
        if labels is None or not new.isEmpty():
            edges = edges.unionByName(new)
            labels = components(edges, found)
        if not some:
            now.drop()
            return labels
        side = hinted(labels, ROW_BYTES)
        star = _labelled(_labelled(star, side, "class", "label"), side, "centre", "middle")
        star = now.kept(star.select("group", "class", "n", "d", "f", "fc", "label", (F.col("label") != F.col("middle")).alias("rest")), "labelled")
        tokens = now.kept(_next_keys(star, deltas, percent, now), "tokens")
        mixed = tokens.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
        members = after.kept(tokens.join(hinted(now.kept(mixed, "mixed"), ROW_BYTES), "key"), "members")
        now.drop()
        before = after
        if members.isEmpty():
            after.drop()
            return labels


def _indexed(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each document's (id, row, n, key), and of each key with company its (rows, component_id, one): the id and row of the document that stays."""
    spark = docs.sparkSession
    slim = _slim(docs, id_col, text_col)
    table = kept(classes(slim, n), "classes")
    scratch = Scratch(spark)
    one = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    per_class = scratch.kept(table.filter("n > 0").groupBy("class", "check").agg(F.min("n").alias("n"), F.min("id").alias("id"), F.count("*").alias("rows"), F.min(one).alias("one")), "sets")
    # Most documents share too few n-grams with any other to have a link; only the rest are looked at closely.
    grams = first_grams(slim, n, percent)
    alive = in_company(grams, "gram").groupBy("class").agg(F.count("*").alias("have"), F.max("need").alias("need")).filter("have >= need").select("class")
    wanted = scratch.kept(per_class.join(alive, "class", "left_semi").withColumn("node", F.col("class")), "wanted")
    clashes = scratch.kept(wanted.groupBy("class").agg(F.count("*").alias("rows")).filter("rows > 1").select("class"), "clashes")
    if not clashes.isEmpty():  # different sets with one hash get nodes of their own
        apart = wanted.join(clashes, "class", "left_semi").withColumn("node", F.xxhash64("class", "check"))
        wanted = scratch.kept(wanted.join(clashes, "class", "left_anti").unionByName(apart), "wanted")
    count = wanted.count()
    if count:
        reps = broadcast_if_small(wanted.select(F.col("one.id").alias("rid"), F.col("one.row").alias("rrow"), F.col("node").alias("class")), count, ROW_BYTES)
        texts = scratch.kept(slim.join(reps, F.col("id").eqNullSafe(F.col("rid")) & (F.col("row") == F.col("rrow"))).select("class", "text"), "texts")
        if texts.count() > count:  # whole rows repeat
            texts = scratch.kept(texts.dropDuplicates(["class"]), "texts")
        sizes = broadcast_if_small(wanted.select(F.col("node").alias("class"), F.col("n").cast("int").alias("n")), count, ROW_BYTES)
        members = buckets(agreements(texts, n, percent), scratch).select(F.col("sig").alias("key"), "class").join(sizes, "class")
        members = scratch.kept(members, "members")
        parts = scratch.kept(vertical(texts, n), "parts")
        labels = class_links(members, parts, count, percent).select(F.col("node"), "label")
        labels = wanted.select("class", "check", "node").join(labels, "node").select("class", "check", "label")
        per_class = per_class.join(labels, ["class", "check"], "left")
    else:
        per_class = per_class.withColumn("label", F.lit(None).cast("long"))
    named = per_class.filter("label is not null").groupBy("label").agg(F.min("id").alias("first"), F.min("one").alias("stays"))
    per_class = per_class.join(named, "label", "left")
    # Documents alone in their class and without links need no lookup.
    key = F.struct("class", "check")
    index = per_class.filter("rows > 1 OR label is not null").select(key.alias("k"), "rows", F.coalesce("first", "id").alias("component_id"), F.coalesce("stays", "one").alias("one"))
    index = kept(index, "components")
    scratch.drop()
    return table.select("id", "row", "n", key.alias("key")), index


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_shingles, component_id, one) of each document; linked documents share a component, named by its smallest id.

    ``one`` is null for a document without company, and else has the id and the row hash of the one to stay.
    """
    table, index = _indexed(docs, n, percent, id_col, text_col)
    found = lookup(table, "key", index, "k", "rows", index.count(), table.count(), ROW_BYTES)
    alone = (F.col("n") == 0) | F.col("rows").isNull()
    return found.select("id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "one")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns: of each component one, with the smallest id.

    Null ids come last; of different texts with that id the one with the smaller hash stays, of wholly equal rows one.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.kept(near_duplicates(docs, n, percent, id_col, text_col).filter("one is not null"), "grouped")
    stays = F.col("id").eqNullSafe(F.col("one.id")) & (F.col("row") == F.col("one.row"))
    gone = kept(found.filter(~stays).select(F.col("id").alias("__gone"), F.col("row").alias("__gone_row")).distinct(), "gone")
    twice = kept(found.filter(stays).groupBy(F.col("id").alias("__gone"), F.col("row").alias("__gone_row")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    scratch.drop()
    own, row = unused(docs, "__own"), unused(docs, "__row")
    keyed = docs.withColumns({own: F.col(id_col).cast("long"), row: F.xxhash64(text_col)})
    on = keyed[own].eqNullSafe(F.col("__gone")) & (keyed[row] == F.col("__gone_row"))
    size = twice.count()
    rest = gone.unionByName(twice) if size else gone
    out = keyed.join(broadcast_if_small(rest, gone.count() + size, ROW_BYTES), on, "left_anti").select(docs.columns)
    if not size:
        return out
    again = keyed.join(broadcast_if_small(twice, size, ROW_BYTES), on, "left_semi")
    first = again.groupBy(own, row).agg(F.min_by(F.struct(*docs.columns), row_hash(docs)).alias("one"))
    return out.unionByName(first.select("one.*"))
