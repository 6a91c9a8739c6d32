"""Language identification by cross-parsing: how few phrases of a language's known text make up a text."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm.common import crc_mod, portions, small, whole

#: Texts are parsed in pieces of so many characters at once; phrases that cross the borders are put right afterwards.
PIECE = 4096
GAP, OTHER = 0, 1  # codes: anything that is not a letter, a letter no language has shown


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``codes``, for each state; 0 is the root."""
    step, link, length, last = [dict()], [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Automaton:
    """The suffix automaton of a text of known letters, with the steps of many parses at a time.

    Its transitions, under 3 n for n letters, are held as a matrix of states and own letters if that has at most ``DENSE``
    entries, as with alphabets; else, as with thousands of characters, as a hash table of two to four slots a transition.
    Either way 25,000 letters take at most 24 MB.
    """

    DENSE = 6_000_000
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: list[int], letters: int):
        step = suffix_automaton(codes)
        own = sorted(step[0])
        self.local = np.zeros(letters, np.int64)  # 0 for letters that the text lacks
        self.local[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        self.root = np.zeros(self.width, np.int32)
        self.root[1:] = [step[0][c] for c in own]
        local = self.local.tolist()
        keys = np.array([s * self.width + local[c] for s, to in enumerate(step) for c in to], np.int64)
        ends = np.array([e for to in step for e in to.values()], np.int32)
        self.table = None
        if len(step) * self.width <= self.DENSE:
            # the lowest bit says that a phrase begins
            table = np.tile(2 * self.root + 1, len(step))
            table[keys] = 2 * ends
            table[: self.width] = 2 * self.root + 1
            self.table = table
            return
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ends = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.ends[slot[first]] = keys[left[first]], ends[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states for letters in ``local`` codes, and whether a phrase begins with them: at the root, which is where a
        text begins and what follows a letter the automaton lacks, and where the phrase so far can't go on."""
        key = state * self.width + code
        if self.table is not None:
            at = self.table[key]
            return at >> 1, (at & 1).astype(bool)
        slot = self._slot(key)
        there = self.keys[slot]
        to = np.where(there == key, self.ends[slot], 0)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            to[open_[hit]] = self.ends[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        begins = (to == 0) | (state == 0)
        return np.where(begins, self.root[code], to), begins


@dataclass
class Languages:
    """Known text of each language; the automata are built from it where they are used."""

    names: list[str]
    texts: list[str]

    def alphabet(self) -> dict[str, int]:
        """A code for every letter of the known texts."""
        return {c: k + 2 for k, c in enumerate(sorted({c for t in self.texts for c in t.lower() if c.isalpha()}))}


class Parser:
    """Counts phrases of many texts at once. A phrase is the longest match from where the last one ended."""

    def __init__(self, languages: Languages):
        self.alphabet = languages.alphabet()
        self.table = np.full(0x110000, -1, np.int32)
        self.machines, self.worth = [], []
        for text in languages.texts:
            codes = self.codes(text).tolist()
            self.machines.append(Automaton(codes, len(self.alphabet) + 2))
            self.worth.append(np.log2(max(2, len(codes))))

    def codes(self, text: str) -> np.ndarray:
        """Letters by their number in the alphabet, runs of anything else as one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[points]
        fresh = out < 0
        if fresh.any():
            for p in np.unique(points[fresh]).tolist():
                self.table[p] = self.alphabet.get(chr(p), OTHER) if chr(p).isalpha() else GAP
            out = self.table[points]
        return out[(out != GAP) | np.concatenate([[True], out[:-1] != GAP])] if len(out) else out

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases (texts x languages).

        Pieces of all texts are parsed side by side, each as if a phrase began with it. From the second piece of a text on,
        the parse is then repeated from the state in which the piece before really ended, until a phrase begins where one
        began before: from there on both agree. Where they don't agree within a piece, its end is handed to the next one.
        """
        flat = np.concatenate([*coded, np.zeros(0, np.int32)])
        sizes = np.array([len(c) for c in coded], np.int64)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(coded)), pieces)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + PIECE * rank
        size = np.minimum(PIECE, sizes[owner] - PIECE * rank)
        out = np.zeros((len(coded), len(self.machines)), np.int64)
        for k, machine in enumerate(self.machines):
            own = machine.local[flat]
            begins, end = np.zeros(len(flat), bool), np.zeros(len(owner), np.int64)
            count = self._parse(machine, own, start, size, end, begins, np.argsort(-size, kind="stable"))
            wrong = np.flatnonzero(rank > 0)
            entry = np.zeros(len(owner), np.int64)
            while len(wrong):
                fresh = wrong[end[wrong - 1] != entry[wrong]]
                entry[fresh] = end[fresh - 1]
                before = end[fresh].copy()
                count[fresh] = self._resume(machine, own, start[fresh], size[fresh], entry[fresh], begins, end, fresh)
                moved = fresh[end[fresh] != before] + 1
                wrong = moved[(moved < len(owner))]
                wrong = wrong[rank[wrong] > 0]
            out[:, k] = np.bincount(owner, weights=count, minlength=len(coded))
        return out

    @staticmethod
    def _parse(machine: Automaton, flat: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray, begins: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Phrases of every piece from the root; fills in the last states and where phrases begin. ``order``: longest first."""
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        at = start[order]
        for n in live.tolist():
            own = at[:n]
            state[:n], fresh = machine.step(state[:n], flat[own])
            begins[own] = fresh
            count[:n] += fresh
            at[:n] += 1
        end[order] = state
        out = np.empty_like(count)
        out[order] = count
        return out

    @staticmethod
    def _resume(machine: Automaton, flat: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, begins: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Phrases that begin within pieces that are entered in the given states; corrects ``begins`` and ``end``."""
        at, stop, left = start.copy(), start + size, np.arange(len(start))
        while len(left):
            state, fresh = machine.step(state, flat[at[left]])
            met = fresh & begins[at[left]]
            begins[at[left]] = fresh
            at[left] += 1
            done = at[left] == stop[left]
            # a parse that began a phrase where the earlier one did too ends as that one did
            end[piece[left[done & ~met]]] = state[done & ~met]
            stay = ~met & ~done
            left, state = left[stay], state[stay]
        total = np.concatenate([[0], np.cumsum(begins)])
        return total[start + size] - total[start]

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1 without a letter) and the score."""
        coded = [self.codes(t) for t in texts]
        lettered = np.array([bool((c != GAP).any()) for c in coded], bool)
        cost = self.phrases(coded) * np.array(self.worth)[None, :]
        best = cost.argmin(1)
        share = 1 / np.maximum(cost, 1e-9)
        top = share[np.arange(len(texts)), best] / share.sum(1) if len(texts) else np.zeros(0)
        return np.where(lettered, best, -1), np.where(lettered, top, 0.0)


def parser_for(languages: Languages) -> Parser:
    """The parser of this process; Python workers are used again, so it is built once in each."""
    kept = sys.__dict__.setdefault("_nightframe_parsers", {})
    key = (tuple(languages.names), hash(tuple(languages.texts)))
    if key not in kept:
        kept.clear()
        kept[key] = Parser(languages)
    return kept[key]


def learn_languages(
    docs: DataFrame, learn, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", buckets: int = 32, chars: int = 25_000
) -> Languages:
    """Known text of every language from a bounded sample.

    Of each language and each of ``buckets`` hash buckets of the id, the document with the smallest hash is taken; its
    first ``chars / buckets`` characters join the language's text; of rows that repeat an id one counts. So a language brings at most ``chars`` characters to
    the driver, whatever share of the rows it has. Every language of the labels is learnt; a Python worker holds up to
    24 MB for each, about 8 MB with a Latin alphabet.
    """
    mine = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), whole(text_col).alias("_text")).filter(F.col("_lang").isNotNull() & learn)
    hashed = F.xxhash64("_id", F.lit("known"))
    picked = mine.groupBy("_lang", F.pmod(hashed, F.lit(buckets)).alias("_b")).agg(F.min(hashed).alias("_h"))
    chosen = picked.select("_lang", "_h")
    rows = mine.withColumn("_h", hashed).join(small(chosen), ["_lang", "_h"]).groupBy("_lang", "_h").agg(F.min(F.substring("_text", 1, chars // buckets)).alias("t")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_lang"], r["_h"], r["t"])):
        found.setdefault(r["_lang"], []).append(r["t"])
    names = sorted(n for n, parts in found.items() if any(c.isalpha() for p in parts for c in p))
    return Languages(names, [" ".join(found[n])[:chars] for n in names])


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text.

    For each language the text is cut into phrases, each the longest piece of the language's known text that matches;
    phrases weigh the logarithm of the known text's length, and the language with the least weight wins, the first by
    name among equals. The score is the winner's share of the inverse weights. Texts that are null or have no letter
    get ``und`` and score 0, as does every text if no language is known. Repeated rows give equal rows; other columns
    are not looked at. One pass without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_for(languages)
        names = [*languages.names, "und"]
        for batch in batches:
            for part in portions(batch, 1):
                if languages.names:
                    best, score = parser.predict(part.column(1).to_pylist())
                else:
                    best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[b] for b in best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def language_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = identify(docs, learn_languages(docs, crc_mod("_id", 4) != 2))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
