"""Joining documents whose sets of word shingles have a Jaccard similarity of at least so many per cent, by T-occurrence search.

A set finds its partners by counting in how many of its shingles' inverted lists they occur. DivideSkip sets the longest
lists aside, merges the short ones with a heap that skips what can't occur often enough any more, and looks up the remaining
candidates in the long lists by binary search. For that, sets that may be similar have to meet, and others need not:

* Two similar sets share at least as many of their shingles of smallest hash as ``Overlap.shared`` says. Sets without so many
  shared ones have no partner and go no further; that takes a third of the shingles and no pairs.
* Of the sets left, each looks at its rarest shingles, as many as any partner must share one of. The smallest set among those
  that have a shingle there leads the list, and each set is sent to the leaders of its lists, once for each.
* What a leader receives is searched in one task if it is small. Of a large block all are compared with the leader first;
  the sets similar to it need no comparison among themselves, and the others are searched against all, tile against tile.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import checkpointed, portions, salted_join, small, whole, written
from nightframe.llm.components import connected_components
from nightframe.llm.simhash import Words, content, digest, mixed, shingle_set

#: Members of a block that are searched together; larger blocks are compared with their leader first and cut into tiles.
TILE = 512


class Overlap:
    """What a Jaccard similarity of ``percent`` per cent asks of two sets by their sizes."""

    def __init__(self, percent: int):
        self.percent = percent

    def of_pair(self, n, m):
        """How many elements sets of ``n`` and ``m`` elements have to share."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def least(self, n):
        """How many elements a set of ``n`` elements has to share with any partner; also a partner's smallest size."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        """How many of the first elements (in any order common to all sets) have to be looked at: a tenth more than it
        takes to share one."""
        return n - self.least(n) + 1 + n // 10

    def shared(self, n):
        """How many of these a set shares with any partner: the smaller of the two has at least ``least(n)`` elements, and
        looks at a tenth of that more than it takes to share one."""
        return 1 + self.least(n) // 10


class Lists:
    """Inverted lists of sets (sorted arrays of distinct hashes), searched by DivideSkip."""

    #: Weight of a long list against the merging of short ones, as its authors found it to serve.
    MU = 0.0085

    def __init__(self, sets: list[np.ndarray], overlap: Overlap):
        self.overlap, self.n = overlap, len(sets)
        #: places of the sets by size, so that the sets of a range of sizes are a range of each list
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.sizes = np.array([len(sets[k]) for k in self.order], np.int64)
        values = np.concatenate([sets[k] for k in self.order])
        owner = np.repeat(np.arange(self.n), self.sizes)
        self.tokens, place = np.unique(values, return_inverse=True)
        #: all lists one after the other, each entry as (list, set)
        self.entries = np.sort(place * self.n + owner)

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the list of sets) and overlaps of the sets that are similar to a set."""
        n = len(query)
        low = int(np.searchsorted(self.sizes, self.overlap.least(n)))
        high = int(np.searchsorted(self.sizes, 100 * n // self.overlap.percent, side="right"))
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if low >= high:
            return nothing
        needed = int(self.overlap.of_pair(n, self.sizes[low]))
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query]
        begin, end = np.searchsorted(self.entries, at * self.n + low), np.searchsorted(self.entries, at * self.n + high)
        there = end > begin
        at, begin, end = at[there], begin[there], end[there]
        if len(at) < needed:
            return nothing
        order = np.argsort(begin - end, kind="stable")
        longest = int(end[order[0]] - begin[order[0]])
        aside = min(needed - 1, int(needed / (self.MU * np.log2(longest + 1) + 1)))
        long, short = at[order[:aside]], order[aside:]
        found = self.merged([(self.entries[begin[k] : end[k]] - at[k] * self.n).tolist() for k in short], needed - aside)
        if not found:
            return nothing
        ids, counts = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        for k in long.tolist():
            probes = k * self.n + ids
            where = np.searchsorted(self.entries, probes)
            counts += self.entries[np.minimum(where, len(self.entries) - 1)] == probes
        kept = counts >= self.overlap.of_pair(n, self.sizes[ids])
        return self.order[ids[kept]], counts[kept]

    @staticmethod
    def merged(lists: list[list[int]], needed: int) -> dict[int, int]:
        """Counts of what occurs in at least ``needed`` of the sorted lists: a heap holds the head of every list; when too few
        lists have the smallest head, so many more are popped that none below the next head can occur often enough, and
        all of these jump to that head."""
        heads, places, found = [(x[0], k) for k, x in enumerate(lists)], [0] * len(lists), {}
        heapq.heapify(heads)
        while len(heads) >= needed:
            value, popped = heads[0][0], []
            while heads and heads[0][0] == value:
                popped.append(heapq.heappop(heads)[1])
            if len(popped) >= needed:
                found[value] = len(popped)
                target = value + 1
            else:
                while heads and len(popped) < needed - 1:
                    popped.append(heapq.heappop(heads)[1])
                if not heads:
                    break
                target = heads[0][0]
            for k in popped:
                own = lists[k]
                place = places[k] = bisect_left(own, target, places[k])
                if place < len(own):
                    heapq.heappush(heads, (own[place], k))
        return found


def shingled(docs: DataFrame, words: int, overlap: Overlap, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, content, node, n, first``: the name and size of a row's set, and its elements of smallest hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), content(text_col).alias("content"), whole(text_col).cast("binary").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in portions(batch, 2):
                sets = [shingle_set(t.as_py(), words, known) for t in part.column(2)]
                made = [
                    pa.array([digest(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s[: overlap.prefix(len(s))].tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "content", "node", "n", "first"])

    return source.mapInArrow(make, f"doc_id {kind}, content bigint, node bigint, n bigint, first binary")


#: An element of a set, and the set.
ELEMENT = np.dtype([("token", "<u8"), ("node", "<i8")])


#: A set, and how many of its elements others have.
COUNT = np.dtype([("node", "<i8"), ("shared", "<i8")])


def shared_by_range(marked: DataFrame, elements: int, per_range: int = 4_000_000) -> DataFrame:
    """``bucket, counts``: how many of a set's first elements in a range of their hashes other sets have among theirs. The sets
    of a bucket are packed into one row for each range, as most sets have some common element in most ranges.

    One that several sets of a batch have counts for these at once, and only one of them is sent on to let other batches
    know; so a very common element costs one entry for each batch.
    """
    ranges = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-elements // per_range))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            firsts = [np.frombuffer(batch.column(1)[k].as_py(), np.uint64) for k in at.tolist()]
            sizes = np.array([len(x) for x in firsts], np.int64)
            if not sizes.sum():
                continue
            tokens, where, count = np.unique(np.concatenate(firsts), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(nodes)), sizes)
            known = np.bincount(owner, weights=count[where] > 1, minlength=len(nodes)).astype(np.int64)
            # of the sets that have an element one stands for all; it is named 0 more than once, others by their node
            rows = np.empty(len(tokens), ELEMENT)
            rows["token"], rows["node"][where] = tokens, nodes[owner]
            many = count > 1
            target = (mixed(tokens, 7) % np.uint64(ranges)).astype(np.int64)
            order = np.lexsort((many, target))
            cuts = np.flatnonzero(np.diff(target[order])) + 1
            made = [(int(target[own[0]]), rows[own[~many[own]]].tobytes(), rows["token"][own[many[own]]].tobytes()) for own in np.split(order, cuts)]
            to, single, several = zip(*made, strict=True)
            lent = np.flatnonzero(known)
            credit = [np.stack([nodes[lent], known[lent]], axis=1).tobytes()] + [b""] * (len(made) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *(pa.array(x, pa.binary()) for x in (single, several, credit))], names=["range", "single", "several", "credit"])

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        lent = np.frombuffer(b"".join(rows.column("credit").to_pylist()), np.int64).reshape(-1, 2)
        one = np.frombuffer(b"".join(rows.column("single").to_pylist()), ELEMENT)
        # a set that several batches hold sends its elements several times
        one = one[np.lexsort((one["node"], one["token"]))]
        fresh = np.concatenate([[True], (one["token"][1:] != one["token"][:-1]) | (one["node"][1:] != one["node"][:-1])])[: len(one)]
        one = one[fresh]
        tokens, where, times = np.unique(one["token"], return_inverse=True, return_counts=True)
        several = np.frombuffer(b"".join(rows.column("several").to_pylist()), np.uint64)
        hit = (times > 1) | np.isin(tokens, several)
        nodes, shared = np.unique(one["node"][hit[where]], return_counts=True)
        found = np.empty(len(lent) + len(nodes), COUNT)
        found["node"], found["shared"] = np.concatenate([lent[:, 0], nodes]), np.concatenate([lent[:, 1], shared])
        bucket = (mixed(found["node"].view(np.uint64), 11) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        buckets, begin = np.unique(bucket[order], return_index=True)
        packed = [x.tobytes() for x in np.split(found[order], begin[1:])] if len(found) else []
        return pa.table({"bucket": buckets, "counts": pa.array(packed, pa.binary())})

    sent = marked.select("node", "first").mapInArrow(send, "range bigint, single binary, several binary, credit binary").repartition(ranges, "range")
    return sent.groupBy("range").applyInArrow(count, "bucket bigint, counts binary")


def shared_elements(marked: DataFrame, elements: int, per_range: int = 4_000_000) -> DataFrame:
    """``node, shared``: how many of a set's first elements other sets have among theirs (none: no row)."""

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), COUNT)
        nodes, where = np.unique(counts["node"], return_inverse=True)
        return pa.table({"node": nodes, "shared": np.bincount(where, weights=counts["shared"]).astype(np.int64)})

    return shared_by_range(marked, elements, per_range).groupBy("bucket").applyInArrow(total, "node bigint, shared bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``node, n, elements``: the whole sets of the rows ``wanted`` (``node``, and ``row`` with id and content), once each."""
    source = docs.select(F.col(id_col).alias("_id"), content(text_col).alias("_content"), whole(text_col).cast("binary").alias("_text"))
    rows = small(wanted.select("node", F.col("row.doc_id").alias("_own"), F.col("row.content").alias("_same")), 100_000)
    texts = source.join(rows, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_content") == F.col("_same"))).select("node", "_text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in portions(batch, 1):
                sets = [shingle_set(t.as_py(), words, known) for t in part.column(1)]
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["node", "n", "elements"])

    return written(texts.mapInArrow(make, "node bigint, n bigint, elements array<bigint>").dropDuplicates(["node"]), "sets")


def blocks(sets: DataFrame, overlap: Overlap) -> DataFrame:
    """``lead, node``: the leaders to whom a set is sent. Two similar sets have one in common."""
    rows = sets.select("node", "n", F.explode("elements").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = rows.join(counts, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("rare"))
    least = F.ceil(overlap.percent * F.col("n") / 100)
    enough = shared.filter(F.size("rare") >= least).select("node", F.explode(F.slice("rare", F.lit(1), (F.size("rare") - least + 1).cast("int"))).alias("e")).select("node", "e.token")
    enough = written(enough, "rare")
    leads = enough.groupBy("token").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("token", "lead")
    return enough.join(leads, "token").select("lead", "node").distinct()


def lead_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements each set shares with its leader's."""
    for batch in batches:
        shared = [len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True)) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
        sizes = [[len(s.values) for s in batch.column(c)] for c in (3, 4)]
        made = [pa.array(v, pa.int64()) for v in (*sizes, shared)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["lead", "node", "n", "m", "overlap"])


def forest(found: list[tuple[int, int, int]], n: int, united: np.ndarray) -> list[tuple[int, int, int]]:
    """Of pairs of ``n`` places, as many as connect all that they connect, if the places ``united`` are connected already."""
    above, kept = list(range(n)), []
    for k in united.tolist():
        above[k] = int(united[0])

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for pair in found:
        a, b = top(pair[0]), top(pair[1])
        if a != b:
            above[a] = b
            kept.append(pair)
    return kept


def linked(sets: list[np.ndarray], overlap: Overlap, every: bool) -> list[tuple[int, int, int]]:
    """Pairs of places, and overlaps, of similar sets: all of them, or (not ``every``) as many as connect all that are.

    For the latter, sets that links connect with the first one need no search of their own: what isn't connected with it
    searches everything, so all pairs are seen but those within that component.
    """
    index, ends, reached, open_ = Lists(sets, overlap), [], {0}, list(range(1, len(sets)))
    following: dict[int, set[int]] = {}

    def ask(k: int) -> None:
        ids, shared = index.search(sets[k])
        mine = [(k, i, s) for i, s in zip(ids.tolist(), shared.tolist(), strict=True) if i != k]
        ends.extend(e for e in mine if not every or e[1] > k)
        for _, i, _ in mine:
            following.setdefault(k, set()).add(i)
            following.setdefault(i, set()).add(k)

    def spread(front: list[int]) -> None:
        while front:
            for i in following.get(front.pop(), ()):
                if i not in reached:
                    reached.add(i)
                    front.append(i)

    ask(0)
    spread([0])
    for k in open_:
        if every or k not in reached:
            ask(k)
            if any(i in reached for i in following.get(k, ())):
                reached.add(k)
                spread([k])
    return ends


def links(sets: DataFrame, places: DataFrame, overlap: Overlap, every: bool = False) -> DataFrame:
    """Edges ``a, b, overlap`` of the blocks: all similar pairs (``every``), or edges that connect all similar sets."""
    places = written(places, "blocks")
    sizes = checkpointed(places.groupBy("lead").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > TILE))
    members = places.join(sets, "node").select("lead", "node", "elements")
    if every:
        stars = None
        spread = members.join(small(sizes), "lead", "left").select("lead", "node", "elements", F.lit(False).alias("alike"), F.lit(0).alias("done"), F.ceil(F.coalesce("f", F.lit(1)) / TILE).cast("int").alias("open"))
    else:
        large = places.join(small(sizes), "lead").select("lead", "node")
        heads = sets.join(sizes.select(F.col("lead").alias("node")), "node").select(F.col("node").alias("lead"), F.col("elements").alias("own"))
        both = salted_join(large.join(sets, "node").select("lead", "node", "elements"), heads, "lead", "node").select("lead", "node", F.lit(0).alias("_"), "elements", "own")
        met = both.mapInArrow(lead_overlap, "lead bigint, node bigint, n bigint, m bigint, overlap bigint")
        alike = (100 + overlap.percent) * F.col("overlap") >= overlap.percent * (F.col("n") + F.col("m"))
        stars = checkpointed(met.select("lead", "node", "overlap", alike.alias("alike")))
        tiles = lambda c: F.ceil(F.count(F.when(c, 1)) / TILE).cast("int")
        counts = checkpointed(stars.groupBy("lead").agg(tiles(F.col("alike")).alias("done"), tiles(~F.col("alike")).alias("open")))
        placed = stars.join(small(counts), "lead").select("lead", "node", "alike", "done", "open")
        filled = {"alike": F.coalesce("alike", F.lit(False)), "done": F.coalesce("done", F.lit(0)), "open": F.coalesce("open", F.lit(1))}
        spread = members.join(small(placed, 100_000), ["lead", "node"], "left").withColumns(filled)
    own = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("alike"), F.col("done")).otherwise(F.col("open")), F.lit(1))).cast("int")
    key = lambda p, q, kind: F.struct(p.alias("p"), q.alias("q"), F.lit(kind).alias("kind"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    spread = spread.withColumn("own", own)
    met_by = F.transform(upto("open"), lambda p: key(p, F.col("own"), "open and done"))
    meets = F.transform(upto("done"), lambda q: key(F.col("own"), q, "open and done"))
    among = F.transform(upto("open"), lambda q: key(F.least("own", q), F.greatest("own", q), "open"))
    spread = spread.withColumn("at", F.explode(F.when(F.col("alike"), met_by).otherwise(F.concat(meets, among))))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        p, q, kind = (k.as_py() for k in key[1:])
        nodes = rows.column("node").to_numpy()
        sets = [s.values.to_numpy().view(np.uint64) for s in rows.column("elements")]
        if kind == "open" and p == q:
            found = linked(sets, overlap, every)
        else:
            asks = rows.column("alike").to_numpy(zero_copy_only=False) == 0 if kind != "open" else rows.column("own").to_numpy() == p
            asking, there = np.flatnonzero(asks), np.flatnonzero(~asks)
            found = []
            if len(asking) and len(there):
                index = Lists([sets[k] for k in there], overlap)
                for k in asking.tolist():
                    ids, shared = index.search(sets[k])
                    found += [(k, i, s) for i, s in zip(there[ids].tolist(), shared.tolist(), strict=True)]
        if not every:
            # all pairs of a large group would grow with its square; sets that are like the leader are connected through it
            found = forest(found, len(sets), np.flatnonzero(rows.column("alike").to_numpy(zero_copy_only=False)))
        a, b, shared = np.array(found, np.int64).reshape(-1, 3).T
        return pa.table({"a": nodes[a], "b": nodes[b], "overlap": shared})

    sent = spread.select("lead", "at.p", "at.q", "at.kind", "node", "alike", "own", "elements")
    edges = sent.groupBy("lead", "p", "q", "kind").applyInArrow(compare, "a bigint, b bigint, overlap bigint")
    if stars is not None:
        edges = edges.unionByName(stars.filter("alike and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"), "overlap"))
    return edges


def candidates(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marked rows, the sets that may have partners, and the leaders to whom they are sent."""
    overlap = Overlap(percent)
    marked = written(shingled(docs, words, overlap, id_col, text_col), "marked")
    full = marked.filter("n > 0")
    elements = full.agg(F.sum(F.length("first") / 8)).first()[0] or 0
    least = F.floor(F.ceil(percent * F.col("n") / 100) / 10) + 1
    row = F.min(F.struct("doc_id", "content")).alias("row")
    shared = shared_elements(full, int(elements))
    named = full.groupBy("node").agg(F.first("n").alias("n"), row)
    wanted = written(named.join(shared, "node").filter(F.col("shared") >= least).select("node", "row"), "wanted")
    sets = sets_of(docs, wanted, words, id_col, text_col)
    return marked, sets, blocks(sets, overlap)


def shingle_groups(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the number of distinct shingles of ``words`` words (A-Z
    lower-cased; fewer words are one shingle), and the smallest id reachable over links, its own included.

    Two rows are linked if their sets' intersection has at least ``percent`` per cent of their union. Null, empty and
    wordless texts have the empty set and no links. Equal sets are searched once, whatever their number. Rows that repeat
    an id are each returned; null ids are larger than any other; an empty table gives no rows; other columns are not
    looked at. Shingles are known by 64-bit hashes.
    """
    marked, sets, places = candidates(docs, percent, words, id_col, text_col)
    edges = links(sets, places, Overlap(percent))
    roots = connected_components(edges.select("a", "b"))
    named = written(marked.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("f")), "named")
    joined = named.join(roots, "node").select("node", "root", "first")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = checkpointed(salted_join(joined, least, "root", "node").select("node", "component_id"))
    # sets of one row that have no link need no name of their own
    groups = named.join(small(moved), "node", "left").filter("f > 1 or component_id is not null").select("node", F.coalesce("component_id", "first").alias("component_id"))
    grouped = marked.select("doc_id", "node", "n").join(small(checkpointed(groups), 100_000), "node", "left")
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id"))


def similar_pairs(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, other_id, overlap``: all pairs of different sets that are linked (see ``shingle_groups``), each set named by
    its smallest id, with the size of the intersection. ``shingle_groups`` tells which rows have a set in common."""
    marked, sets, places = candidates(docs, percent, words, id_col, text_col)
    ids = marked.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    pairs = links(sets, places, Overlap(percent), every=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap").distinct()
    named = pairs.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other_id"), "overlap")


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM words
  )
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT s FROM sets GROUP BY s HAVING count(*) > 1),
kept AS (SELECT doc_id, s FROM sets SEMI JOIN shared USING (s)),
enough AS (SELECT doc_id, n FROM kept JOIN sizes USING (doc_id) GROUP BY doc_id, n HAVING 100 * count(*) >= 80 * n),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM kept a JOIN enough x ON x.doc_id = a.doc_id JOIN kept b ON b.s = a.s AND b.doc_id <> a.doc_id JOIN enough y ON y.doc_id = b.doc_id
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 180 * count(*) >= 80 * (x.n + y.n)
), reach AS (
  SELECT a AS doc_id, a AS other FROM pairs
  UNION
  SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other
), roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.doc_id = d.doc_id
"""
