"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nightframe.llm import exact_dedup, simhash
from nightframe.llm.components import connected_components

ID_TEXT = "doc_id bigint, text string"


def exact_by_hand(rows):
    groups = {}
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_groups(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "ab ", "a\tb\n", "é é", "é\u00a0é", "", None, " ", "c" * rng.randint(1, 3)])) for i in range(300)]
    df = spark.createDataFrame(rows, ID_TEXT).repartition(19)
    for fan_in in (2, 8):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(df, fan_in=fan_in).collect()}
        assert got == exact_by_hand(rows)


def test_exact_odd_tables(odd_docs, no_docs):
    out = exact_dedup.exact_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count() and sum(r["kept"] for r in out) == 5
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 5), (False, 6), (False, 7), (True, None)]
    assert exact_dedup.exact_duplicates(no_docs).count() == 0 and exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def fingerprint_by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, radius):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def make_texts(n=60):
    rng = random.Random(8)
    rows = []
    for base in range(n // 5):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 30, 200]))]
        rows += [" ".join(words).upper()] + [" ".join(edited(rng, words, k)) for k in (0, 1, 2, 6)]
    rows += ["", None, "\t ", "one", "One"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_simhash_components(spark):
    rows = make_texts()
    fps = {i: fingerprint_by_hand(t) for i, t in rows}
    want = components_by_hand(fps, 4)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_groups(spark.createDataFrame(rows, ID_TEXT)).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert len(set(want.values())) < len(rows) - 5


def test_links_survive_hot_ranges_and_blocks(spark):
    """All fingerprints in one range: it is split between tasks and cut into blocks, and no component changes."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1, 2**62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(56, k, replace=False)) for k in rng.integers(0, 9, 300)}
    values = np.array(sorted(values), np.uint64)
    want = components_by_hand({int(v): int(v) for v in values}, 4)
    head = int(values[0] >> np.uint64(56))
    for most, at_once in ((10**6, 20_000), (100, 6_000_000), (5, 6_000_000)):
        ball = simhash.Ball(4, 8, at_once=at_once)
        hot = ball.hot_ranges({head: len(values)}, most)
        assert set(hot) == ({head ^ int(f) for f in ball.heads} if most < 300 else set())
        groups = {}
        for places, to, part in ball.reach(values, hot):
            for p, t, s in zip(places, to, part, strict=True):
                groups.setdefault((int(t), int(s)), []).append(p)
        root = {int(v): int(v) for v in values}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for (t, s), places in groups.items():
            own = values[np.array(sorted(places))]
            for variants, owner in ball.collisions(own, t, s, hot.get(t, 0)):
                for v in np.unique(variants):
                    who = [int(own[o]) for o in np.unique(owner[variants == v])]
                    for w in who[1:]:
                        x, y = find(who[0]), find(w)
                        root[max(x, y)] = min(x, y)
        assert {v: find(v) for v in root} == want


def test_simhash_odd_tables(odd_docs, no_docs):
    out = simhash.simhash_groups(odd_docs).collect()
    assert len(out) == odd_docs.count() and len({r["component_id"] for r in out if r["fingerprint"] == "0" * 16}) == 1
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, None}


def jaccard(a, b):
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_find_what_is_similar(spark):
    rng = random.Random(3)
    rows, similar, different = [], [], []
    for base in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows.append((base * 10, " ".join(words)))
        for k, n in ((1, 3), (2, 40)):
            rows.append((base * 10 + k, " ".join(edited(rng, words, n))))
    texts = dict(rows)
    for base in range(0, 300, 10):
        for k in (1, 2):
            (similar if jaccard(texts[base], texts[base + k]) >= 0.8 else different).append((base, base + k))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ID_TEXT)).collect()}
    assert len(similar) >= 29 and all(got.get(a) == got.get(b) == a for a, b in similar)
    assert not any(b in got for a, b in different if jaccard(texts[a], texts[b]) < 0.6)


def near_by_hand(rows):
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row[0])
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def test_near_duplicates_are_counted_exactly(spark, monkeypatch):
    """Long pairs just under and over 0.8, texts of few words, and groups of several tiles."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for base in range(60):
        words = [word() for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:-31] + [word() for _ in range(31 + base % 12)])]
    for n in range(8, 20):
        for _ in range(5):
            words = [word() for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, word()]), " ".join([word(), *words, word()])]
    words = [word() for _ in range(200)]
    texts += [" ".join(edited(rng, words, k)) for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(6)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for tile in (512, 5):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ID_TEXT)).collect()}
        assert got == near_by_hand(rows)


def test_rows_that_repeat_an_id_are_told_apart(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (2, "quite another text under the same id, not like any of these")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, ID_TEXT)).collect()
    assert sorted(map(tuple, kept)) == sorted([rows[0], rows[2]])


def test_large_groups_are_joined_without_all_pairs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 8).astype(np.uint64)
    near = np.repeat(centre[None], 400, 0) ^ (np.uint64(1) << rng.integers(0, 63, (400, 8)).astype(np.uint64))
    far = rng.integers(0, 2**63, (50, 8)).astype(np.uint64)
    links = simhash.Links(np.concatenate([near, far]), 60)
    links.group(np.arange(450))
    roots = links.roots(np.arange(450)).tolist()
    assert len(set(roots[:400])) == 1 and len(set(roots[400:])) == 50


def test_counted_bits_and_blocks():
    rng = np.random.default_rng(7)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (0, 1, 2, 254, 255, 256, 3000, 0, 7)]
    got = simhash.majorities(sets, at_once=300)
    for s, (bits,) in zip(sets, got.tolist(), strict=True):
        assert bits == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    for n in (10, 300_000, 10**10):
        plan = simhash.Plan(n, 0.8)
        wide = rng.integers(0, 2**63, (3, plan.wide)).astype(np.uint64)
        for row, line in enumerate(wide.tolist()):
            whole = sum(int(x) << (64 * k) for k, x in enumerate(line))
            assert all(int(plan.block(wide, k)[row]) == whole >> (k * plan.width) & ((1 << plan.width) - 1) for k in range(plan.blocks))


def test_ranges_of_candidates(spark):
    """Many ranges give the same candidates as one."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, words if i % 2 else words[::-1], i % 5))) for i in range(60)]
    docs, plan = spark.createDataFrame(rows, ID_TEXT), simhash.Plan(60, 0.8)
    marked = simhash.wide_fingerprints(docs, plan).select("node", "wide").distinct()
    found = [{(r["node"], r["root"]) for r in connected_components(simhash.candidate_links(marked, plan, n)).collect()} for n in (1 << 19, 4)]
    assert found[0] == found[1] and len(found[0]) >= 50


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
