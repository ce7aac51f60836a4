"""Exact and near duplicates, repeated passages, contamination: against brute force."""

import hashlib
import random
import re

import pytest

from sheaf.llm import decontaminate, exact_dedup, ngram_join, substring_dedup, textkit

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0d]+")
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string"


def words(text):
    return SPACED.findall((text or "").translate(LOW))


# -- exact -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(weird, keep):
    rows = exact_dedup.duplicate_groups(weird, keep).collect()
    assert len(rows) == weird.count()
    groups = {}
    for i, t in [(r.doc_id, r.text) for r in weird.collect()]:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if keep == "max" else min(known))
    for sha in by_sha:
        assert sum(r.kept for r in rows if r.text_sha256 == sha) == 1


def test_exact_stay(spark, weird, nothing):
    stay = exact_dedup.exact_dedup(weird)
    assert stay.columns == weird.columns and stay.count() == 7
    assert exact_dedup.exact_dedup(nothing).count() == 0 == exact_dedup.duplicate_groups(nothing).count()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, "any")


def test_exact_ties_and_reserved_names(spark):
    rows = [(1, "a", 5), (1, "A", 6), (1, "a", 5), (2, "a", 7), (None, "b", 1), (None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n long").selectExpr("doc_id", "text", "__n", "__n AS __kept", "'x' AS __text")
    stay = exact_dedup.exact_dedup(docs)
    assert stay.columns == docs.columns
    first = sorted(map(str, stay.collect()))
    assert len(first) == 2 and first == sorted(map(str, exact_dedup.exact_dedup(docs.repartition(3)).collect()))
    assert sorted(r.kept for r in exact_dedup.duplicate_groups(docs).collect()) == [False] * 4 + [True] * 2


def test_index_takes_more_runs(spark):
    index = exact_dedup.DigestIndex(spark, "min")
    index.flush(spark.createDataFrame([(5, "a"), (6, "b")], SCHEMA)).flush(spark.createDataFrame([(2, "A"), (None, "c")], SCHEMA))
    assert sorted((r.id, r.n) for r in index.entries().collect() if r.id is not None) == [(2, 2), (6, 1)]


def test_hot_lookup(spark, monkeypatch):
    from sheaf.llm import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(300)] + [(1000 + i, f"own {3 * i}") for i in range(10)], SCHEMA)
    rows = exact_dedup.duplicate_groups(df, "max").collect()
    assert len(rows) == 310 and sum(r.kept for r in rows) == 101 and max(r.group_size for r in rows) == 200


# -- near --------------------------------------------------------------------------------------------------------------


def components(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, base_words, copies, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            at = draw.randrange(len(w))
            w[at : at + draw.choice((0, 1, 1, 1))] = [f"e{draw.randrange(10**6)}"] * draw.choice((0, 1, 1))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_near(spark, n, percent):
    texts = family(1, 150, 30, 4) + family(2, 40, 15, 2) + family(3, 12, 20, 2) + family(4, 600, 12, 20) + family(5, 8, 20, 1)
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(1001, None), (1003, " "), (1005, "ab cd"), (1007, "AB cd"), (1009, "ab")]
    random.Random(0).shuffle(docs)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, SCHEMA), n, percent).collect()}
    assert got == components(docs, n, percent)


def test_near_around_a_centre(spark, monkeypatch):
    """A group near its centre but hardly to one another: stars and turns, and no pairs tried plainly."""
    monkeypatch.setattr(ngram_join, "PLAIN", 0)
    draw, base = random.Random(7), [f"b{i}" for i in range(60)]
    docs = []
    for i in range(70):
        w = list(base)
        for at in draw.sample(range(60), 4):
            w[at] = f"c{i} {at}" if i % 3 else f"shared{at}"
        docs.append((i, " ".join(w[: draw.randrange(52, 61)])))
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, SCHEMA), 2, 80).collect()}
    assert got == components(docs, 2, 80)


def thue_morse():
    """Two words of 1,024 letters whose polynomial hashes modulo 2 ** 64 are equal for any odd base."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_in_polynomials(spark):
    one, two = thue_morse()
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], SCHEMA)
    assert {r.id: r.component_id for r in ngram_join.near_duplicates(docs, 3, 100).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert [r.n_removed for r in substring_dedup.remove_repeated(docs, 35).collect()] == [0] * 4


def test_one_of_each_with_ties(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "A b c"), (7, "x y z"), (7, "x y z"), (7, "X y z"), (8, "x y z"), (9, None), (9, None)], SCHEMA)
    stay = ngram_join.one_of_each(docs).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in stay) == [("7", "x y z"), ("9", ""), ("9", ""), ("None", "a b c")]


def test_a_large_group_of_near_copies_stays_small(spark, monkeypatch):
    """Classes share many buckets; each is in about one group, and what is no link in spite of shared fragments goes early."""
    from sheaf.storage import Scratch

    rows, kept = {}, Scratch.kept

    def counted(self, df, name):
        out = kept(self, df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "PLAIN", 0)
    monkeypatch.setattr(Scratch, "kept", counted)
    draw = random.Random(11)
    base = [f"b{i}" for i in range(160)]
    docs = []
    for i in range(90):  # pairs of 3 to 24 edits at a time: some link, most do not
        w = list(base)
        for at in draw.sample(range(160), draw.randrange(2, 13)):
            w[at] = f"c{draw.randrange(6)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join([f"s{i} {draw.random()}" for _ in range(60)] + base[: 12 + i % 3])) for i in range(40)]  # a common line
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 80).collect()}
    assert got == components(docs, 3, 80)
    assert rows["groups"][0] <= 130
    assert rows["hubs"] and max(rows["hubs"]) <= 130


def test_what_all_have_in_common_makes_no_bucket(spark):
    """Near copies in twos, of families that share a passage only: buckets hold no more than the two, and each two meets."""
    draw, passage, docs = random.Random(11), " ".join(f"p{i}" for i in range(30)), []
    for i in range(25):
        own = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        other = list(own)
        other[draw.randrange(200)] = "changed"
        docs += [(2 * i, f"{' '.join(own)} {passage}"), (2 * i + 1, f"{' '.join(other)} {passage}")]
    texts, scratch = spark.createDataFrame(docs, "class long, text string"), ngram_join.Scratch(spark)
    together = {}
    for r in ngram_join.buckets(ngram_join.agreements(texts, 5, 80), scratch).select("sig", "class").collect():
        together.setdefault(r.sig, set()).add(r["class"])
    scratch.drop()
    assert {tuple(sorted(x)) for x in together.values()} == {(2 * i, 2 * i + 1) for i in range(25)}


def test_classes_share_enough_of_a_level():
    """Any two linked sets have at least ``need`` signatures of some level in common, and a common line is not enough."""
    draw = random.Random(2)
    for percent in (75, 80, 90, 97):
        for size in (1, 2, 3, 7, 12, 40, 150, 700):
            for _ in range(12):
                one = {draw.randrange(1 << 64) for _ in range(size)}
                other = set(one)
                for gram in draw.sample(sorted(one), min(size, draw.randrange(size // 4 + 2))):
                    other.discard(gram)
                    if draw.random() < 0.5:
                        other.add(draw.randrange(1 << 64))
                if not other or one == other or 100 * len(one & other) < percent * len(one | other):
                    continue
                shared = []
                for s in (one, other):
                    sigs, needs = ngram_join.signatures(textkit.np.array(sorted(s), dtype=textkit.U64), percent)
                    ends = textkit.np.cumsum([many for _, many, _ in needs])
                    shared.append({level: (set(sigs[end - many : end].tolist()), need) for end, (level, many, need) in zip(ends, needs)})
                a, b = shared
                assert any(len(a[level][0] & b[level][0]) >= max(a[level][1], b[level][1]) for level in a.keys() & b.keys())


def test_near_edges(weird, nothing):
    rows = ngram_join.near_duplicates(weird).collect()
    assert len(rows) == weird.count()
    assert {r.id: r.component_id for r in rows if r.id in (2, 3, 5, 6, 10)} == {2: 2, 3: 3, 5: 5, 6: 5, 10: 5}
    assert ngram_join.one_of_each(weird).columns == weird.columns
    assert {5} == {r.doc_id for r in ngram_join.one_of_each(weird).collect()} & {5, 6, 10}
    assert ngram_join.near_duplicates(nothing).count() == 0 == ngram_join.one_of_each(nothing).count()


def test_fragments_hold():
    for percent in (60, 80, 90):
        for level in range(1, 25):
            count, spare = ngram_join.fragments(level, percent)
            assert count == ngram_join.most_different(2 * (ngram_join.LEVELS[level + 1] - 1), percent) + 1 + spare


# -- passages ----------------------------------------------------------------------------------------------------------


def removed(docs, window):
    lists = [(i, SPACED.findall(t or "")) for i, t in docs]
    seen = {}
    for _, w in lists:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in lists:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [5, 35])
def test_passages(spark, window):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    passage = text(60)
    docs = [(i, f"{text(draw.randrange(50))} {passage if i % 3 else ''}\n{text(draw.randrange(90))}") for i in range(40)]
    docs += [(100, "a " * 60), (101, "a b " * 30), (102, passage), (102, passage), (103, None), (104, ""), (105, "é " + passage.upper())]
    got = sorted((tuple(r) for r in substring_dedup.remove_repeated(spark.createDataFrame(docs, SCHEMA), window).collect()), key=repr)
    assert got == removed(docs, window)


def test_passages_with_full_sketch(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 3)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 21)
    monkeypatch.setattr(substring_dedup, "CELLS", 0)
    draw = random.Random(4)
    docs = [(i, " ".join(str(draw.randrange(9)) for _ in range(80))) for i in range(30)]
    got = sorted((tuple(r) for r in substring_dedup.remove_repeated(spark.createDataFrame(docs, SCHEMA), 5).collect()), key=repr)
    assert got == removed(docs, 5)


def test_passage_edges(weird, nothing):
    assert substring_dedup.remove_repeated(weird).count() == weird.count()
    assert substring_dedup.remove_repeated(nothing).count() == 0


# -- benchmark ---------------------------------------------------------------------------------------------------------


def hits(docs, items, window=10):
    wanted = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(str(i) if i is not None else "")
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        covered, names = set(), set()
        for size in {len(k) for k in wanted}:
            for k in range(len(w) - size + 1):
                if found := wanted.get(tuple(w[k : k + size])):
                    covered |= set(range(k, k + size))
                    names |= found
        out.append((i, len(w), len(covered), sorted(names)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.contamination.n_words, r.contamination.n_hit, sorted(r.contamination["items"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1 << 23, 200])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    draw = random.Random(5)
    text = lambda k: " ".join(f"v{draw.randrange(30)}" for _ in range(k))
    items = [(i, text(k)) for i, k in enumerate((25, 10, 9, 3, 2, 1, 0, 40))] + [(50, None), (51, "Rare-Word, rare"), (51, "Rare-Word, rare"), (None, "null item here"), (52, "z " * 30)]
    docs = [(i, f"{text(20)}. {items[i % 5][1].upper()} {text(15)}") for i in range(30)] + [(90, None), (91, ""), (92, "RARE word;rare!"), (92, "RARE word;rare!"), (93, "z " * 40), (94, "null item here")]
    got = found(decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")))
    assert got == hits(docs, items)


def test_one_block_of_items_at_a_time(spark, monkeypatch):
    import weakref

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    made, most, of = [], [], decontaminate.Probe.of

    def counted(*values):
        probe = of(*values)
        made.append(weakref.ref(probe))
        most.append(sum(x() is not None for x in made))
        return probe

    monkeypatch.setattr(decontaminate.Probe, "of", counted)
    items = [(i, f"alpha{i} beta{i} gamma{i}") for i in range(8)]
    docs = [(i, f"x alpha{i} beta{i} gamma{i} y") for i in range(10)]
    got = found(decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")))
    assert got == hits(docs, items) and len(made) > 2 and max(most) == 1


def test_contamination_edges(spark, weird, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(decontaminate.contamination(weird, none)) == hits([(r.doc_id, r.text) for r in weird.collect()], [])
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    clean = decontaminate.decontaminated(weird, items)
    assert clean.columns == weird.columns and clean.count() == weird.count() - 3
    assert decontaminate.decontaminated(nothing, items).count() == 0


def test_spans(spark):
    row = decontaminate.contamination(spark.createDataFrame([(1, "a b c d e f")], SCHEMA), spark.createDataFrame([(1, "b c"), (2, "e")], "item_id long, text string")).first().contamination
    assert (row.starts, row.ends) == ([1, 4], [3, 5])


# -- words -------------------------------------------------------------------------------------------------------------


def test_words_across_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textkit, "BLOCK_BYTES", 7)
    texts = ["One two", None, "", "x" * 50, " a\x0bb c ", "é日 Zz", "endless" * 9 + " z"]
    got = textkit.words_of(pa.array(texts), lower=True)
    assert [got.bytes_of(i).decode() for i in range(len(got.start))] == [w for t in texts for w in words(t)]
    assert got.per_doc.tolist() == [len(words(t)) for t in texts]
    assert len(set(got.hash.tolist())) == len({w for t in texts for w in words(t)})
