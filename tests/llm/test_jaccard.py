"""The Jaccard join against comparing all pairs of shingle sets."""

import random

import numpy as np
import pytest

from nightframe.llm import jaccard_join as J
from nightframe.llm.simhash import Words, shingle_set


def sets_of(text, words=5):
    parts = (text or "").encode().lower().split()
    if len(parts) < words:
        return {b" ".join(parts)} if parts else set()
    return {b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def similar(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def components(rows, percent):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j], percent):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(((k, len(s), least[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=160):
    """Near copies with few and many edits, chains of them, exact copies, passages that many share, short and odd texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(400))
    passage = [word() for _ in range(40)]
    bases, texts = [[word() for _ in range(rnd.choice([6, 9, 14, 60, 200]))] for _ in range(12)], []
    for _ in range(n):
        own = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 1, 1, 2, 4, 12])):
            own[rnd.randrange(len(own))] = word()
        if rnd.random() < 0.2:
            own = own + passage
        if rnd.random() < 0.1:
            bases.append(own)
        texts.append(" ".join(own))
    texts += [texts[0]] * 30 + [texts[1].upper(), texts[2].replace(" ", "\n\t "), "", None, " \r\n", "a b", "A  B", "a b c d", "to to to to to of", "to " * 30 + "of " * 30, "é a b c d e", "É a b c d e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4]), (None, "alone " * 3), (7, "other text under a known id")]


@pytest.mark.parametrize("seed,tile,percent", [(1, 512, 80), (2, 8, 80), (3, 4, 60), (4, 8, 90)])
def test_groups(spark, monkeypatch, seed, tile, percent):
    """Also with tiles so small that leaders, tiles and pairs of tiles all take part."""
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "u", "v", "w") for r in rows], "doc_id bigint, text string, node string, n string, lead string")
    got = sorted((tuple(r) for r in J.shingle_groups(docs, percent).collect()), key=str)
    assert got == components(rows, percent)


@pytest.mark.parametrize("tile", [512, 6])
def test_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    rows = [r for r in corpus(5, 90) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {}
    for k, t in rows:
        if s := frozenset(sets_of(t)):
            first[s] = min(k, first.get(s, k))
    want = {(min(a, b), max(a, b), len(s & t)) for s, a in first.items() for t, b in first.items() if a < b and similar(s, t, 80)}
    got = [tuple(r) for r in J.similar_pairs(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_tables(spark, odd_docs, no_docs):
    assert J.shingle_groups(no_docs).count() == 0 and J.similar_pairs(no_docs).count() == 0
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.shingle_groups(odd_docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None)], key=str)


def test_divide_skip():
    """Searching inverted lists gives what intersecting the sets gives, with short and long lists."""
    rnd = random.Random(6)
    for percent in (50, 80, 95):
        overlap = J.Overlap(percent)
        common = rnd.sample(range(10**6), 60)
        sets = [np.unique(np.array(rnd.sample(common, rnd.randint(20, 60)) + [rnd.randrange(10**6) for _ in range(rnd.randint(0, 8))], np.uint64)) for _ in range(120)]
        index = J.Lists(sets, overlap)
        for k, s in enumerate(sets):
            ids, shared = index.search(s)
            want = {i: len(np.intersect1d(s, t)) for i, t in enumerate(sets) if similar(set(s.tolist()), set(t.tolist()), percent)}
            assert dict(zip(ids.tolist(), shared.tolist(), strict=True)) == want and k in want
    assert J.Lists.merged([[1, 4, 9], [4, 7, 9], [2, 4], [9, 11]], 3) == {4: 3, 9: 3}


def test_bounds_by_size():
    """What ``Overlap`` asks never exceeds what similar sets share, for all sizes."""
    for percent in (60, 80, 95):
        o = J.Overlap(percent)
        for n in range(1, 80):
            for m in range(1, n + 1):
                for shared in range(m + 1):
                    if 100 * shared >= percent * (n + m - shared):
                        assert shared >= o.of_pair(n, m) >= max(o.least(n), o.least(m)) and m >= o.least(n)
                        assert min(n - shared, o.prefix(n)) < o.prefix(n) and o.prefix(n) - (n - shared) >= o.shared(n)
                        assert o.prefix(m) - (m - shared) >= o.shared(n)


def test_shingles_of_repeated_words_differ():
    text = ("to " * 20 + "of " * 20 + "to " * 20 + "a " * 20).encode()
    assert len(shingle_set(text, 5, Words())) == len(sets_of(text.decode()))


@pytest.mark.parametrize("tile", [512, 16])
def test_links_of_a_large_group_grow_with_its_size(spark, monkeypatch, tile):
    """A group whose members are nearly all similar: as many links as connect it, not all of its pairs."""
    monkeypatch.setattr(J, "TILE", tile)
    rnd = random.Random(9)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(150):
        own = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            own[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    _, sets, places = J.candidates(docs, 80, 5, "doc_id", "text")
    met = places.count()
    edges = J.links(sets, places, J.Overlap(80)).count()
    assert edges < 6 * met
    got = sorted((tuple(r) for r in J.shingle_groups(docs).collect()), key=str)
    assert got == components(list(enumerate(texts)), 80)


def test_counts_of_shared_elements_are_packed(spark):
    """What others share with a set, against counting all elements, in no more rows than ranges by ranges."""
    rnd = random.Random(10)
    sets = {n: sorted({rnd.randrange(300) * 2**40 for _ in range(rnd.randint(1, 40))}) for n in range(-90, 90)}
    rows = [(n, np.array(s, np.uint64).tobytes()) for n, s in sets.items()]
    df = spark.createDataFrame(rows, "node bigint, first binary").repartition(5)
    times = {}
    for s in sets.values():
        for t in s:
            times[t] = times.get(t, 0) + 1
    want = {n: k for n, s in sets.items() if (k := sum(times[t] > 1 for t in s))}
    assert {r["node"]: r["shared"] for r in J.shared_elements(df, 1).collect()} == want
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < J.shared_by_range(df, 1).count() <= ranges**2 < len(want)
