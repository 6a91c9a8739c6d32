"""Toxicity scores from a sparse logistic model that is penalised for reacting to identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm.common import crc_mod, whole
from nightframe.llm.samples import labelled_texts

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms. Each line is one kind; a group's forms are joined by slashes, and a group is swapped for each
# other one of its line, form for form.
IDENTITY = """
women/woman men/man girls/girl boys/boy females/female males/male nonbinary/nonbinary
gay/gays lesbian/lesbians bisexual/bisexuals straight/straights queer/queers homosexual/homosexuals heterosexual/heterosexuals
transgender/trans cisgender/cis
muslim/muslims christian/christians jewish/jews hindu/hindus buddhist/buddhists atheist/atheists sikh/sikhs
black/blacks white/whites asian/asians latino/latinos african/africans european/europeans arab/arabs indigenous/natives
mexican/mexicans american/americans chinese/chinese indian/indians german/germans french/french turkish/turks polish/poles russian/russians
immigrant/immigrants refugee/refugees citizen/citizens foreigner/foreigners
deaf blind disabled autistic
old young elderly
frauen/frau männer/mann mädchen/mädchen jungen/junge
femmes/femme hommes/homme filles/fille garçons/garçon
mujeres/mujer hombres/hombre chicas/chica chicos/chico
muslime/muslim christen/christ juden/jude
musulmans/musulman chrétiens/chrétien juifs/juif
musulmanes/musulmán cristianos/cristiano judíos/judío
"""


def _swaps() -> dict[str, list[dict[str, str]]]:
    """For each identity term the swaps of its group: which word becomes which."""
    out: dict[str, list[dict[str, str]]] = {}
    for line in IDENTITY.strip().split("\n"):
        groups = [g.split("/") for g in line.split()]
        for own in groups:
            made = [{w: other[min(k, len(other) - 1)] for k, w in enumerate(own)} for other in groups if other is not own]
            for w in dict.fromkeys(own):
                out.setdefault(w, []).extend(made)
    return out


SWAPS = _swaps()


STEMS = (4, 5, 6, 7)


#: Stems of identity terms: they are no features, as they would name the group once more.
BARRED = {term[:k] for term in SWAPS for k in STEMS if len(term) >= k}


def features_of(words: Counter[str], stems: set[str] | None = None) -> set[str]:
    begun: Counter[str] = Counter()
    for word, n in words.items():
        for k in STEMS:
            if len(word) >= k and word[:k] not in BARRED and (stems is None or word[:k] in stems):
                begun[word[:k]] += n
    return words.keys() | {f"{stem}*{t}" for stem, n in begun.items() for t in (2, 3) if n >= t}


def features(text: str, stems: set[str] | None = None) -> set[str]:
    """The words of a text, and stems that two or more, or three or more, of its words begin with (``stem*2``).

    Insults are inflected and compounded more than they are repeated; ``stems`` limits the stems that are counted.
    """
    return features_of(Counter(WORD.findall(text.lower())), stems)


def counterfactuals(texts: list[str], known: dict[str, int]) -> list[dict[int, int]]:
    """What swaps change: for every sentence with identity terms, and every other group that could stand there, the
    columns of the model that come (1) and go (-1) if all forms of the group are swapped throughout the sentence. All
    features of both sentences are made anew, stems among them."""
    out = []
    for text in texts:
        for sentence in SENTENCE.split(text.lower()):
            words = Counter(WORD.findall(sentence))
            swaps = {tuple(swap.items()): swap for term in words.keys() & SWAPS.keys() for swap in SWAPS[term]}
            own = features_of(words) if swaps else set()
            for _, swap in sorted(swaps.items()):
                other: Counter[str] = Counter()
                for word, n in words.items():
                    other[swap.get(word, word)] += n
                new = features_of(other)
                change = {known[f]: 1 for f in new - own if f in known} | {known[f]: -1 for f in own - new if f in known}
                if change:
                    out.append(change)
    return out


def curvature(row: np.ndarray, col: np.ndarray, weight: np.ndarray, m: int, rounds: int = 30) -> float:
    """The largest eigenvalue of the weighted second moments of the words and the constant, by power iteration."""
    v, one, top = np.ones(m), 1.0, 1.0
    for _ in range(rounds):
        z = weight * (one + np.bincount(row, weights=v[col], minlength=len(weight)))
        v, one = np.bincount(col, weights=z[row], minlength=m), z.sum()
        top = float(np.sqrt(v @ v + one * one))
        v, one = v / top, one / top
    return 1.1 * top


def fit(rows: list[tuple[str, int]], share: float, fairness: float = 5.0, sparsity: float = 3e-4, least: int = 3, most: int = 3000, rounds: int = 400) -> tuple[dict[str, float], float]:
    """Weights of words and the intercept.

    Minimises the class-balanced logistic loss, plus ``sparsity`` times the absolute weights, plus ``fairness`` times
    the mean squared change of the score (before the logistic function) over all swapped sentences, by accelerated proximal gradient steps.
    Only the ``most`` features that tell the classes apart best, and all identity terms, take part. The intercept is then
    moved to the true ``share`` of toxic rows.
    """
    prior = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    y = np.array([label for _, label in rows], np.float64)
    if not rows or y.min() == y.max():
        return {}, prior
    sets = [features(text) for text, _ in rows]
    seen = {label: Counter(w for s, (_, own) in zip(sets, rows, strict=True) if own == label for w in s) for label in (0, 1)}
    n0, n1 = len(y) - y.sum(), y.sum()

    def apart(w: str) -> float:
        """How many standard errors the two classes are apart."""
        p, q, all_of = seen[1][w] / n1, seen[0][w] / n0, (seen[1][w] + seen[0][w]) / len(y)
        return abs(p - q) / max(1e-9, all_of * (1 - all_of) * (1 / n0 + 1 / n1)) ** 0.5

    often = [w for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= least and w not in SWAPS]
    vocabulary = sorted(sorted(often, key=lambda w: (-apart(w), w))[:most] + [w for w in SWAPS if seen[0][w] + seen[1][w]])
    known = {w: i for i, w in enumerate(vocabulary)}
    row = np.concatenate([np.full(len(s & known.keys()), i) for i, s in enumerate(sets)] or [np.zeros(0)]).astype(np.int64)
    col = np.array([known[w] for s in sets for w in sorted(s & known.keys())], np.int64)
    n, m = len(rows), len(vocabulary)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    swapped = counterfactuals([text for text, _ in rows], known)
    which = np.repeat(np.arange(len(swapped)), [len(c) for c in swapped]) if swapped else np.zeros(0, np.int64)
    at = np.array([k for c in swapped for k in c], np.int64)
    sign = np.array([v for c in swapped for v in c.values()], np.float64)
    steepest = max((len(c) for c in swapped), default=0)
    step = 1 / (0.25 * curvature(row, col, weight, m) + 2 * fairness * steepest)
    w, bias, look, look_bias, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        logit = look_bias + np.bincount(row, weights=look[col], minlength=n)
        off = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
        slope = np.bincount(col, weights=off[row], minlength=m)
        if swapped:
            change = np.bincount(which, weights=sign * look[at], minlength=len(swapped))
            slope += np.bincount(at, weights=sign * (2 * fairness / len(swapped)) * change[which], minlength=m)
        new = look - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
        new_bias = look_bias - step * off.sum()
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look, look_bias = new + (before - 1) / t * (new - w), new_bias + (before - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return {v: float(w[i]) for v, i in known.items() if w[i]}, float(bias + prior)


def toxicity(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row, from the words of its whole text.

    Null and empty texts have no words and get the intercept's score. One pass without a shuffle; repeated rows are
    scored alike, other columns are not looked at.
    """
    weights, bias = model
    stems = {w.partition("*")[0] for w in weights if "*" in w}
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.array([bias + sum(weights[w] for w in sorted(features(t.as_py(), stems) & weights.keys())) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -40, 40))))], names=["doc_id", "score"])

    return source.mapInArrow(score, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, share = labelled_texts(docs, labels, "toxic", crc_mod("_id", 4) != 2)
    out = toxicity(docs, fit(rows, share))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
