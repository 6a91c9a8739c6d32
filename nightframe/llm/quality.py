"""Quality by the votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm.common import crc_mod, whole
from nightframe.llm.samples import labelled_texts

SLOTS, WORD_SLOTS = 4096, 3072
RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1+"))


def shape_of(token: str) -> str:
    """``Word,`` -> ``Aa,``; ``WORD!!`` -> ``A!+``; ``12.5`` -> ``9.9``."""
    letters = lambda m: "A" if m[0].isupper() else "Aa" if m[0][:1].isupper() else "a"
    out = RUNS[0][0].sub(letters, token)
    return RUNS[2][0].sub(RUNS[2][1], RUNS[1][0].sub("9", out))


def slots_of(token: str) -> tuple[int, int]:
    word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS
    shape = WORD_SLOTS + zlib.crc32(shape_of(token).encode("utf-8", "surrogatepass")) % (SLOTS - WORD_SLOTS)
    return word, shape


def document_marks(text: str, counts: Counter) -> list[str]:
    """Marks for what single words don't show: repetition of words and of lines, and the mean length of lines."""
    total = sum(counts.values())
    lines = [x for x in text.split("\n") if x.strip()]
    fresh = lambda distinct, n: int(10 * distinct / n) if n else -1
    return [
        f"\0words {fresh(len(counts), total)} {min(6, total.bit_length())}",
        f"\0lines {fresh(len(set(lines)), len(lines))}",
        f"\0most {fresh(max(counts.values(), default=0), total)} {min(6, total.bit_length())}",
        f"\0length {(total // max(1, len(lines))).bit_length()}",
    ]


def term_matrix(texts: list[str], cache: dict[str, tuple[int, int]]) -> np.ndarray:
    """Rows of damped counts over the hash slots: the first part holds words, the rest shapes and marks."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for k, text in enumerate(texts):
        counts = Counter(text.split())
        words, shapes, numbers = [], [], []
        for token, n in counts.items():
            pair = cache.get(token)
            if pair is None:
                if len(cache) > 200_000:
                    cache.clear()
                pair = cache[token] = slots_of(token)
            words.append(pair[0])
            shapes.append(pair[1])
            numbers.append(n)
        if counts:
            row = np.bincount(np.array(words + shapes), weights=np.array(numbers * 2), minlength=SLOTS)
            total = sum(numbers)
            row = row / total
            marks = [WORD_SLOTS + zlib.crc32(m.encode()) % (SLOTS - WORD_SLOTS) for m in document_marks(text, counts)]
            out[k] = np.sqrt(row)
            out[k, marks] += 0.35
    return out


@dataclass
class Neighbours:
    """Labelled documents in the latent space. Its size is bounded by the sample and by ``rank``."""

    scale: np.ndarray  # weight of each slot
    axes: np.ndarray  # slots x rank
    vectors: np.ndarray  # labelled documents x rank, of length 1
    labels: np.ndarray
    share: float

    def parts(self) -> tuple:
        return self.scale, self.axes, self.vectors, self.labels, self.share

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = (terms * self.scale) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, terms: np.ndarray, k: int = 15, power: float = 4.0) -> np.ndarray:
        """Share of label 1 among the ``k`` nearest labelled documents, each counting with similarity to ``power``.

        Similarities are compared at six decimals; of equal ones the earlier rows count, whatever the number of rows.
        """
        if not len(self.labels):
            return np.full(len(terms), self.share)
        z = self.latent(terms)
        near = np.round(np.maximum(z @ self.vectors.T, 0), 6)
        k = min(k, len(self.labels))
        least = np.partition(near, -k, axis=1)[:, -k][:, None]
        more, same = near > least, near == least
        counted = more | (same & (np.cumsum(same, axis=1) <= k - more.sum(1, keepdims=True)))
        row, col = np.nonzero(counted)
        weight = near[row, col].astype(np.float64) ** power
        total = np.bincount(row, weights=weight, minlength=len(near))
        score = np.bincount(row, weights=weight * self.labels[col], minlength=len(near)) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(score, 0, 1), self.share)


def fit(rows: list[tuple[str, int]], share: float, rank: int = 48, seed: int = 7) -> Neighbours:
    """Weights slots by how rare they are, and finds the leading axes by a randomised singular value decomposition."""
    labels = np.array([y for _, y in rows], np.float32)
    terms = term_matrix([t for t, _ in rows], {}) if rows else np.zeros((0, SLOTS), np.float32)
    seen = (terms > 0).sum(0)
    scale = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32)
    scale[WORD_SLOTS:] = 1 + 0.5 * scale[WORD_SLOTS:]
    scale[:WORD_SLOTS] *= 0.5
    if not rows:
        return Neighbours(scale, np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), labels, share)
    x = terms * scale
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 12, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T[:, :rank]).astype(np.float32)
    model = Neighbours(scale, axes, np.zeros((0, rank), np.float32), labels, share)
    model.vectors = model.latent(terms).astype(np.float32)
    return model


def quality(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text", k: int = 15, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted`` for every row: blocks of documents against all labelled vectors.

    Texts without a word are like nothing and get the share of good labels as score. The model is broadcast; its size
    depends on the sample's bound alone. No shuffle; repeated rows are scored alike, other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, int]] = {}
        near = Neighbours(*shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = near.vote(term_matrix(part.column(1).to_pylist(), cache), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    return source.mapInArrow(score, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_model(docs: DataFrame, labels: DataFrame) -> Neighbours:
    return fit(*labelled_texts(docs, labels, "quality", crc_mod("_id", 3) != 1))


def quality_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality(docs, quality_model(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Neighbours, text_col: str = "text", k: int = 15, threshold: float = 0.5) -> DataFrame:
    """``docs``, same columns, without the rows that the model rejects: a filter over whole rows, with no join.

    Null and empty texts get the share of good labels as score; null ids and rows that repeat are judged by their text
    like any other; an empty table gives no rows.
    """
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, int]] = {}
        near = Neighbours(*shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = near.vote(term_matrix([t or "" for t in part.column(at).to_pylist()], cache), k)
                yield part.filter(pa.array(found >= threshold))

    return docs.mapInArrow(judge, schema)
