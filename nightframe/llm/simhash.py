"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 h`` bits have a common variant, one that differs from each in at most ``h``
bits. So every fingerprint is made to meet its variants: it is sent to each range of variants (their leading bits) that
its ball reaches, and the variants of a range are listed, sorted and compared where the range is handled. That moves a
few dozen rows for each fingerprint instead of the thousands of variants themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import checkpointed, portions, salted_join, small, whole, written
from nightframe.llm.components import connected_components

SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased, one space between words; a shorter text is one run."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, hashed = memoryview(b" ".join(parts)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        return np.array([hashed(line, SEED)], np.uint64)
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    stops = ends[words - 1 :].tolist()
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def bit_counts(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many values of each segment (they begin at ``starts``, none is empty) have each of the 64 bits set.

    Eight counters of eight bits lie in one word, so at most 255 values are added before the counters are widened.
    """
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    out, lanes = np.empty((len(starts), 64), np.int64), np.uint64(0x0101010101010101)
    for j in range(8):
        counters = np.add.reduceat((values >> np.uint64(j)) & lanes, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[:, j::8] = np.add.reduceat(counters, first, axis=0, dtype=np.int64)
    return out


def majorities(sets: list[np.ndarray], wide: int = 0, at_once: int = 1 << 15) -> np.ndarray:
    """For each list of hashes the bits that are set in over half of them (none for an empty list): 64 bits of the hashes
    themselves, or, with ``wide``, 64 bits of each of so many values mixed from them."""
    out = np.zeros((len(sets), max(1, wide)), np.uint64)
    sizes = np.array([len(x) for x in sets], np.int64)
    order, k = np.flatnonzero(sizes), 0
    ends = np.cumsum(sizes[order])
    while k < len(order):
        done = ends[k - 1] if k else 0
        upto = max(k + 1, int(np.searchsorted(ends, done + at_once, side="right")))
        rows = order[k:upto]
        values, starts = np.concatenate([sets[r] for r in rows]), np.cumsum(sizes[rows]) - sizes[rows]
        for w in range(max(1, wide)):
            more = 2 * bit_counts(mixed(values, w) if wide else values, starts) > sizes[rows][:, None]
            out[rows, w] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
        k = upto
    return out


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th independent 64-bit value made from each hash."""
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a long); repeated shingles count as often as they occur, no words give zero."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).cast("binary").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                found = majorities([shingle_hashes(t.as_py(), words) for t in part.column(1)])[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(make, f"doc_id {kind}, fp bigint")


def flips(bits: range, most: int) -> np.ndarray:
    """All masks with at most ``most`` of the given bits set, fewest first."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)], np.uint64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes can reach over the edges."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, deeper := root[root]):
            root = deeper


def repeated(values: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, ordered by value and place."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    spread = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(42)
    seen = np.zeros(1 << 22, bool)
    seen[(twice.astype(np.uint64) * spread) >> shift] = True
    maybe = np.flatnonzero(seen[(values.astype(np.uint64) * spread) >> shift])
    maybe = maybe[np.argsort(values[maybe], kind="stable")]
    own = values[maybe]
    same = np.concatenate([[False], own[1:] == own[:-1]])
    return maybe[same | np.concatenate([same[1:], [False]])]


class Ball:
    """Variants of fingerprints of ``bits`` bits within ``radius // 2`` bits, by the range of their ``prefix`` leading bits."""

    #: parity checks that split the variants of one range evenly: the first ``SPLIT`` between tasks, the others within one
    CHECKS = np.random.default_rng(11).integers(1, 2**63, 12, dtype=np.int64).astype(np.uint64)
    SPLIT = 6

    def __init__(self, radius: int, prefix: int, bits: int = 64, at_once: int = 6_000_000):
        self.half, self.prefix, self.low, self.at_once = radius // 2, prefix, bits - prefix, at_once
        self.heads = flips(range(prefix), self.half)
        self.tails = [flips(range(self.low), r) for r in range(self.half + 1)]

    def checks(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for k, mask in enumerate(self.CHECKS):
            out |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << k
        return out

    def hot_ranges(self, counts: dict[int, int], most: int) -> dict[int, int]:
        """The ranges that receive over ``most`` values (``counts`` has the large heads), as each also receives what lies in
        its neighbours, and into how many parts, as a power of two, their variants are split."""
        received: dict[int, int] = {}
        for head, n in counts.items():
            for flip in self.heads.tolist():
                received[head ^ flip] = received.get(head ^ flip, 0) + n
        return {r: min(self.SPLIT, math.ceil(math.log2(n / most))) for r, n in received.items() if n > most}

    def reach(self, values: np.ndarray, hot: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, ranges and parts: where each value has variants. Every part of a hot range gets all its values."""
        everyone = np.arange(len(values))
        for head in self.heads:
            to = ((values >> np.uint64(self.low)) ^ head).astype(np.int64)
            split = np.array([hot.get(t, 0) for t in to.tolist()]) if hot else np.zeros(len(to), np.int64)
            for bits in np.unique(split).tolist():
                own = split == bits
                for part in range(1 << bits):
                    yield everyone[own], to[own], np.full(own.sum(), part)

    def collisions(self, values: np.ndarray, target: int, part: int = 0, split: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every variant of the range that two or more values share, the variant and the places of the values.

        ``part`` is one of ``2 ** split`` parts of the variants. They come in blocks of about ``at_once``, cut by parity
        checks, so memory doesn't grow with the range.
        """
        head = (values >> np.uint64(self.low)) ^ np.uint64(target)
        left = self.half - np.bitwise_count(head).astype(np.int64)
        base = (values & np.uint64((1 << self.low) - 1)) | (np.uint64(target) << np.uint64(self.low))
        total = sum(int((left == r).sum()) * len(self.tails[r]) for r in range(self.half + 1)) >> split
        cut = min(len(self.CHECKS) - self.SPLIT, max(0, (total // self.at_once).bit_length()))
        asked = ((1 << cut) - 1) << self.SPLIT | ((1 << split) - 1)
        own = self.checks(base) & asked if asked else np.zeros(len(base), np.int64)
        tails = [(t, self.checks(t) & asked if asked else np.zeros(len(t), np.int64)) for t in self.tails]
        for block in range(1 << cut):
            value = (block << self.SPLIT) | part
            made, owners = [], []
            for r, (masks, syndromes) in enumerate(tails):
                for syndrome in np.unique(own[left == r]):
                    who = np.flatnonzero((left == r) & (own == syndrome))
                    those = masks[syndromes == (value ^ syndrome)]
                    made.append((base[who][:, None] ^ those[None, :]).ravel())
                    owners.append(np.repeat(who, len(those)))
            if not made:
                continue
            variants, owner = np.concatenate(made), np.concatenate(owners)
            places = repeated(variants)
            if len(places):
                yield variants[places], owner[places]


def prefix_bits(n: int, least: int, rows: int) -> int:
    """Leading bits that leave about ``rows`` fingerprints to a range."""
    return max(least, math.ceil(math.log2(max(1, n / rows))))


def fingerprint_links(fps: DataFrame, radius: int = 4, most: int = 1 << 16) -> DataFrame:
    """Edges ``a, b`` that join all fingerprints (distinct longs in ``fp``) within ``radius`` bits of each other.

    The edges of a range are a spanning forest of its links: all links have the same components as these edges.
    A range that receives over ``most`` fingerprints, its neighbours' among them, is split by its variants into up to 64 tasks.
    """
    fps = written(fps)
    n = fps.count()
    prefix = prefix_bits(n, 8, 1024)
    ball = Ball(radius, prefix)
    head = F.shiftrightunsigned("fp", 64 - prefix)
    # heads this large are few, whatever the number of rows
    large = fps.groupBy(head.alias("h")).count().filter(F.col("count") > max(most // (2 * len(ball.heads)), n // 4096))
    hot = ball.hot_ranges({r["h"]: r["count"] for r in large.collect()}, most)
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(ball.tails[-1]) // 20_000_000)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for places, to, part in ball.reach(values, hot):
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(part.astype(np.int32)), pa.array(values[places].view(np.int64))], names=["range", "part", "fp"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        values = np.sort(rows.column("fp").to_numpy().view(np.uint64))
        target, part = key[0].as_py(), key[1].as_py()
        ends = []
        for variants, owner in ball.collisions(values, target, part, hot.get(target, 0)):
            first = np.concatenate([[True], variants[1:] != variants[:-1]])
            leader = owner[np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
            near = np.bitwise_count(values[leader] ^ values[owner]) <= radius
            ends.append(np.unique(np.stack([leader, owner])[:, near & ~first], axis=1))
        a, b = np.concatenate(ends, axis=1) if ends else (np.zeros(0, np.int64),) * 2
        root = local_roots(len(values), a, b)
        other = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[other].view(np.int64), "b": values[root[other]].view(np.int64)})

    sent = fps.mapInArrow(send, "range bigint, part int, fp bigint").repartition(tasks, "range", "part")
    return sent.groupBy("range", "part").applyInArrow(meet, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; the component is the smallest id reachable over links.

    Null counts as empty; texts without words have fingerprint zero and are linked like any other. Copies share one
    fingerprint, and only distinct fingerprints are compared, so a group of copies of any size costs one entry.
    Rows that repeat an id are each returned; null ids are larger than any other. Other columns are not looked at.
    """
    marked = written(fingerprints(docs, words, id_col, text_col))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    joined = distinct.join(roots, distinct["fp"] == roots["node"])
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = checkpointed(salted_join(joined, least, "root", "fp").select("fp", "component_id"))
    named = distinct.join(small(moved), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of 0.8 on shingles of five words -----------------------------------------------------------------

#: Members of a group whose sets are held together in one task; a larger group is compared tile against tile.
TILE = 512

#: 64-bit words of a wide fingerprint that go with a row to where fingerprints meet; all words take part in verifying.
CHECK = 4


class Words(dict):
    """Words and their hashes; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingle_set(text: bytes, words: int, known: Words) -> np.ndarray:
    """The distinct shingles of ``words`` words (A-Z lower-cased; a shorter text is one), each as 64 bits mixed from the
    hashes of its words; sorted."""
    parts = text.lower().split()
    hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    if not n:
        return hashes
    total = np.zeros(len(parts) - n + 1, np.uint64)
    for j in range(n):
        # powers of one number: sums of small multiples of them, as of repeated words, don't meet
        total += hashes[j : len(parts) - n + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    return np.unique(mixed(total, 99))


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def fewer_by_one(hashes: np.ndarray, similarity: float) -> list[int]:
    """Names of the sets without one of the hashes, if the set is so small that only such sets are similar to it."""
    n = len(hashes)
    if n < 2 or (n - 1) / n < similarity or (n - 2) / n >= similarity:
        return []
    return [digest(np.delete(hashes, k)) for k in range(n)]


def content(text_col: str):
    """A 64-bit name of the text, which tells rows that repeat an id apart."""
    return F.xxhash64(whole(text_col).cast("binary"))


class Plan:
    """How wide fingerprints of ``n`` sets are cut into blocks for a similarity.

    The wider a block, the fewer unlike fingerprints meet in it by chance: it has four bits more than ``n`` has, so that a
    variant has one or two owners on average at every size. There are as many blocks, of independent bits, as let a pair of
    just that similarity miss all of them once in ``1 / miss`` times.
    """

    def __init__(self, n: int, similarity: float, radius: int = 2, miss: float = 1e-3):
        # the expected share of bits that differ, with a hundredth more as sets of a dozen differ more than large ones
        self.share = math.acos(2 * similarity / (1 + similarity)) / math.pi + 0.01
        self.n, self.similarity, self.radius = n, similarity, radius
        self.width = min(60, max(20, math.ceil(math.log2(max(1, n))) + 4))
        meets = sum(math.comb(self.width, k) * self.share**k * (1 - self.share) ** (self.width - k) for k in range(radius + 1))
        self.blocks = math.ceil(math.log(miss) / math.log(1 - meets))
        self.wide = max(CHECK, -(-self.blocks * self.width // 64))

    def most(self, words: int, errors: float = 4.0) -> int:
        """In how many bits of so many words two similar sets may differ: the expected number and so many standard errors."""
        bits = 64 * words
        return math.floor(bits * self.share + errors * math.sqrt(bits * self.share * (1 - self.share)))

    def block(self, wide: np.ndarray, k: int) -> np.ndarray:
        word, shift = divmod(k * self.width, 64)
        value = wide[:, word] >> np.uint64(shift)
        if shift + self.width > 64:
            value = value | wide[:, word + 1] << np.uint64(64 - shift)
        return value & np.uint64((1 << self.width) - 1)


def wide_fingerprints(docs: DataFrame, plan: Plan, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, content, node, wide, fewer``: the name of the set of shingles, the bits over it (null for texts without
    words), and the names of the sets that lack one shingle where the set is small."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), content(text_col).alias("content"), whole(text_col).cast("binary").alias("text"))
    wide, similarity = plan.wide, plan.similarity

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in portions(batch, 2):
                sets = [shingle_set(t.as_py(), words, known) for t in part.column(2)]
                bits = majorities(sets, wide)
                made = [
                    pa.array([digest(s) for s in sets], pa.int64()),
                    pa.array([b.tobytes() if len(s) else None for s, b in zip(sets, bits, strict=True)], pa.binary()),
                    pa.array([fewer_by_one(s, similarity) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "content", "node", "wide", "fewer"])

    return source.mapInArrow(make, f"doc_id {kind}, content bigint, node bigint, wide binary, fewer array<bigint>")


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the last axes of two arrays of 64-bit words differ."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int64)
    for w in range(a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


class Links:
    """Links within one range of one block: those fingerprints that share a variant and agree over all bits at hand."""

    def __init__(self, wide: np.ndarray, most: int):
        self.wide, self.most = wide, most
        self.parent = np.arange(len(wide))

    def roots(self, members: np.ndarray) -> np.ndarray:
        found = self.parent[members]
        while not np.array_equal(found, deeper := self.parent[found]):
            found = deeper
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        near = differ(self.wide[a], self.wide[b]) <= self.most
        self.parent = local_roots(len(self.parent), np.concatenate([a[near], np.arange(len(self.parent))]), np.concatenate([b[near], self.parent]))

    def meet(self, variants: np.ndarray, owner: np.ndarray, upto: int = 8) -> None:
        """Joins what is linked among the owners of each variant; equal variants lie side by side."""
        begin = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
        size = np.diff(np.concatenate([begin, [len(variants)]]))
        few = np.repeat(size <= upto, size)
        a, b = [np.repeat(owner[begin], size)], [owner]
        for step in range(1, min(upto, int(size.max()))):
            at = np.flatnonzero((variants[step:] == variants[:-step]) & few[:-step])
            a.append(owner[at])
            b.append(owner[at + step])
        both = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)]), axis=0), axis=1)
        self.join(both[0], both[1])
        for first, n in zip(begin[size > upto].tolist(), size[size > upto].tolist(), strict=True):
            self.group(np.unique(owner[first : first + n]))

    def group(self, members: np.ndarray) -> None:
        """Joins what is linked among ``members``, comparing only members that are not joined yet."""
        roots = self.roots(members)
        while len(members) and (roots != roots[0]).any():
            mine = roots == roots[0]
            hit = self.touched(members[mine], members[~mine])
            if hit.any():
                self.parent[np.unique(roots[~mine][hit])] = roots[0]
                roots = self.roots(members)
            else:
                members, roots = members[~mine], roots[~mine]

    def touched(self, front: np.ndarray, rest: np.ndarray, at_once: int = 1_000_000) -> np.ndarray:
        """Which of ``rest`` are linked to any of ``front``."""
        hit = np.zeros(len(rest), bool)
        step = max(1, at_once // len(rest))
        for k in range(0, len(front), step):
            open_ = np.flatnonzero(~hit)
            near = differ(self.wide[front[k : k + step]][:, None], self.wide[rest[open_]][None]) <= self.most
            hit[open_[near.any(axis=0)]] = True
        return hit


def exact_links(sets: list[np.ndarray], wide: np.ndarray, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join all of the sets (none empty) with a Jaccard similarity of ``similarity`` or more. Sets are
    counted where their wide fingerprints differ in at most ``most`` bits."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, left, ends = np.zeros(len(codes), np.int32), np.arange(len(sets)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            one = front.pop()
            those = left[differ(wide[left], wide[one]) <= most]
            if not len(those):
                continue
            own = codes[starts[one] : starts[one] + sizes[one]]
            mark[own] = 1
            shared = np.array([mark[codes[starts[k] : starts[k] + sizes[k]]].sum() for k in those.tolist()])
            mark[own] = 0
            hit = those[shared / (sizes[those] + sizes[one] - shared) >= similarity]
            ends += [(one, k) for k in hit.tolist()]
            front += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    a, b = np.array(ends, np.int64).reshape(-1, 2).T
    return a, b


def verified_links(docs: DataFrame, distinct: DataFrame, roots: DataFrame, plan: Plan, words: int, id_col: str, text_col: str) -> DataFrame:
    """Edges ``a, b`` that join, within each group of candidates (``node, root``), all sets that are similar by exact count.

    Of a group of over ``TILE`` members, all are compared with the one that names the group. Those that are similar to it
    need no comparison among themselves; the rest is compared with everyone, tile against tile, each in a task.
    """
    members = checkpointed(roots.join(distinct.select("node", F.col("first.doc_id").alias("_id"), F.col("first.content").alias("_content")), "node"))
    source = docs.select(F.col(id_col).alias("_id"), content(text_col).alias("_content"), whole(text_col).cast("binary").alias("_text"))
    texts = source.join(small(members, 100_000), ["_id", "_content"]).select("node", "root", "_text")
    wide, similarity, most = plan.wide, plan.similarity, plan.most(plan.wide)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in portions(batch, 2):
                sets = [shingle_set(t.as_py(), words, known) for t in part.column(2)]
                made = [pa.array([b.tobytes() for b in majorities(sets, wide)], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["node", "root", "wide", "shingles"])

    sets = written(texts.mapInArrow(make, "node bigint, root bigint, wide binary, shingles array<bigint>").dropDuplicates(["node"]))
    large = checkpointed(roots.groupBy("root").count().filter(F.col("count") > TILE).select("root"))
    leads = sets.filter("node = root").join(small(large), "root").select("root", F.col("shingles").alias("lead"))
    shared = F.size(F.array_intersect("shingles", "lead"))
    alike = shared / (F.size("shingles") + F.size("lead") - shared) >= similarity
    stars = checkpointed(sets.join(small(leads, 1000), "root").select("node", "root", alike.alias("alike")))
    tiles = lambda c: F.ceil(F.count(F.when(c, 1)) / TILE).cast("int")
    counts = stars.groupBy("root").agg(tiles(F.col("alike")).alias("done"), tiles(~F.col("alike")).alias("open"))
    placed = stars.join(small(checkpointed(counts)), "root").select("node", "alike", "done", "open")
    key = lambda p, q, kind: F.struct(p.alias("p"), q.alias("q"), F.lit(kind).alias("kind"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    spread = sets.join(small(placed, 100_000), "node", "left").withColumns({"alike": F.coalesce("alike", F.lit(False)), "done": F.coalesce("done", F.lit(0)), "open": F.coalesce("open", F.lit(1))})
    own = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("alike"), F.col("done")).otherwise(F.col("open")), F.lit(1))).cast("int")
    spread = spread.withColumn("own", own)
    first, second = F.transform(upto("open"), lambda p: key(p, F.col("own"), 0)), F.transform(upto("done"), lambda q: key(F.col("own"), q, 0))
    among = F.transform(upto("open"), lambda q: key(F.least("own", q), F.greatest("own", q), 1))
    spread = spread.withColumn("at", F.explode(F.when(F.col("alike"), first).otherwise(F.concat(second, among)))).select("root", "at.*", "node", "wide", "shingles")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        if len(nodes) < 2:
            return pa.table({"a": nodes[:0], "b": nodes[:0]})
        bits = np.frombuffer(b"".join(rows.column("wide").to_pylist()), "<u8").reshape(-1, wide)
        a, b = exact_links([s.values.to_numpy() for s in rows.column("shingles")], bits, most, similarity)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    edges = spread.groupBy("root", "p", "q", "kind").applyInArrow(compare, "a bigint, b bigint")
    return edges.unionByName(stars.filter("alike").select(F.col("node").alias("a"), F.col("root").alias("b")))


#: What goes to a range: the bits of the block, the name of the set, and the bits that are compared.
PACKED = np.dtype([("value", "<u8"), ("node", "<i8"), ("check", "<u8", CHECK)])


def candidate_links(distinct: DataFrame, plan: Plan, range_rows: int = 1 << 19) -> DataFrame:
    """Edges ``a, b`` (a spanning forest for each range) of fingerprints that meet in a block and agree in their first words.

    Each block is ball-hashed by itself: a fingerprint goes to the ranges of variants that its ball reaches, where the
    variants are listed. What a batch sends to one range goes as one row.
    """
    ball = Ball(plan.radius, prefix_bits(plan.n, 0, range_rows), plan.width, at_once=1_500_000)
    most, wide, blocks = plan.most(CHECK), plan.wide, plan.blocks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, wide)
            rows = np.empty(batch.num_rows, PACKED)
            rows["node"], rows["check"] = batch.column(1).to_numpy(zero_copy_only=False), bits[:, :CHECK]
            for block in range(blocks):
                rows["value"] = plan.block(bits, block)
                ranges, packed = [], []
                for places, to, _ in ball.reach(rows["value"], {}):
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.diff(to[order])) + 1
                    for own in np.split(order, cuts) if len(order) else []:
                        ranges.append(int(to[own[0]]))
                        packed.append(rows[places[own]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranges), block, np.int32)), pa.array(ranges, pa.int64()), pa.array(packed, pa.binary())], names=["block", "range", "packed"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(rows.column("packed").to_pylist()), PACKED)
        nodes, values = own["node"], np.ascontiguousarray(own["value"])
        links = Links(np.ascontiguousarray(own["check"]), most)
        for variants, owner in ball.collisions(values, key[1].as_py()):
            links.meet(variants, owner)
        root = links.roots(np.arange(len(nodes)))
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[other], "b": nodes[root[other]]})

    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks << ball.prefix)
    sent = distinct.select("wide", "node").mapInArrow(send, "block int, range bigint, packed binary").repartition(tasks, "block", "range")
    return sent.groupBy("block", "range").applyInArrow(meet, "a bigint, b bigint")


def near_groups(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, content, keep`` for documents that have a near duplicate; ``keep`` has the smallest id and content."""
    plan = Plan(docs.count(), similarity)
    marked = written(wide_fingerprints(docs, plan, words, id_col, text_col).filter("wide is not null and doc_id is not null"))
    row = F.struct("doc_id", "content")
    distinct = written(marked.groupBy("node").agg(F.first("wide").alias("wide"), F.first("fewer").alias("fewer"), F.min(row).alias("first"), F.max(row).alias("last")))
    candidates = connected_components(candidate_links(distinct, plan))
    verified = verified_links(docs, distinct, candidates, plan, words, id_col, text_col)
    lacking = distinct.select(F.col("node").alias("a"), F.explode("fewer").alias("b")).join(distinct.select(F.col("node").alias("b")), "b").select("a", "b")
    roots = connected_components(verified.unionByName(lacking))
    joined = distinct.select("node", "first", "last").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("first").alias("keep"), F.max("last").alias("_last")).filter("keep <> _last")
    groups = checkpointed(salted_join(joined, least, "root", "node").select("node", "keep"))
    return marked.join(small(groups, 100_000), "node").select("doc_id", "content", "keep")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id`` for documents that have a near duplicate: sets of shingles of ``words`` words with a Jaccard
    similarity of ``similarity`` or more, counted exactly.

    Candidates are those who agree in one block of a wide fingerprint to within two bits, and over more bits to within a
    loose bound; the width and number of blocks follow from the number of rows (``Plan``). Sets so small that similar ones
    lack just one shingle find these by name. Groups are the components of the pairs whose sets were counted; ``keep_id``
    is the smallest id. Texts that are null, empty or without words have no near duplicates here; null ids are left alone;
    rows that repeat an id and a text are one; an empty table gives no rows; other columns are not looked at.
    """
    return near_groups(docs, words, similarity, id_col, text_col).select("doc_id", F.col("keep.doc_id").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near duplicates; same columns. Rows are told
    apart by id and text, so of rows that repeat an id only those in a group are dropped, and rows that repeat both stay
    or go together. What has no words or no id stays."""
    row = F.struct("doc_id", "content")
    found = checkpointed(near_groups(docs, words, similarity, id_col, text_col).filter(row != F.col("keep")).select("doc_id", "content").distinct())
    gone = small(found.toDF("__nf_gone", "__nf_content"), 100_000)
    return docs.join(gone, (docs[id_col] == F.col("__nf_gone")) & (content(text_col) == F.col("__nf_content")), "left_anti")
