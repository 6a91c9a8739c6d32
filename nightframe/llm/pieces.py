"""SentencePiece encoding and decoding by one forward pass over the shared prefixes of sorted words."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import portions, whole

MARK = "▁"  # stands for a space
SEGMENT = re.compile("▁+[^▁]*|[^▁]+")
LINES = re.compile("▁+[^▁\n]*|\n+|[^▁\n]+")
# Fixed values of the model format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Vocabulary:
    """Pieces with their scores, in the order of their ids, and the model's settings."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy_prefix: bool = True
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
        # if no piece holds a line break, no piece reaches over one
        self.segment = SEGMENT if any("\n" in p for p in self.ids) or self.model == UNIGRAM else LINES
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.worst = min(normal, default=0.0) - 10.0

    def of_unknown(self, text: str) -> list[int]:
        if self.byte_ids is None:
            return [self.unknown]
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = number() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> Vocabulary:
    """A vocabulary out of a model file. Only models that leave texts as they are (no normalisation, spaces kept) are read."""
    pieces, scores, kinds, model, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode("utf-8"))
            scores.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            if own.get(2, b"") or own.get(4, 1):
                raise ValueError("the model normalises texts or drops spaces")
            prefix = bool(own.get(3, 1))
    if model not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are read")
    return Vocabulary(pieces, scores, kinds, model, prefix)


class Forward:
    """The forward state of each prefix of the current word: the best path's score, its last piece, where that begins.

    It is Viterbi's recurrence in both cases. For a unigram model the best path is the one of the highest score. For a BPE
    model, where a step is worth 0 or minus infinity depending on the piece before, it is the only one whose
    neighbouring pieces could all stand side by side: two pieces may if merging their joint text by the model's
    priorities gives just those two. Either way the state of a prefix depends on the prefix alone, so words that are
    handled in sorted order share it: only what follows the common prefix with the word before is computed, which is
    a depth-first walk of the words' trie.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bpe = vocabulary.model == BPE
        self.word = ""
        self.score, self.last, self.begin = [0.0], [""], [0]
        self.beside: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: again and again the pair with the best joint piece is merged, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.v.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.v.scores[k] > best):
                    best, at = self.v.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        pair = (a, b)
        known = self.beside.get(pair)
        if known is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            known = self.beside[pair] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def _merge_paths(self, word: str, same: int) -> None:
        """The states of the prefixes longer than ``same``, for a BPE model."""
        ids, last, begin, beside, longest = self.v.ids, self.last, self.begin, self.beside, self.v.longest
        for end in range(same + 1, len(word) + 1):
            for start in range(end - longest if end > longest else 0, end - 1):
                piece = word[start:end]
                if piece in ids:
                    ok = beside.get((last[start], piece))
                    if ok or (ok is None and self.fit(last[start], piece)):
                        break
            else:
                start = end - 1
                piece = word[start:end]
            last.append(piece)
            begin.append(start)

    def _score_paths(self, word: str, same: int) -> None:
        """The same for a unigram model, with the best scores."""
        ids, scores = self.v.ids, self.v.scores
        for end in range(same + 1, len(word) + 1):
            start, piece, top = end - 1, word[end - 1 : end], -1e300
            for s in range(max(0, end - self.v.longest), end):
                k = ids.get(word[s:end])
                value = self.score[s] + (scores[k] if k is not None else self.v.worst if s == end - 1 else -1e300)
                if value > top:
                    start, piece, top = s, word[s:end], value
            self.score.append(top)
            self.last.append(piece)
            self.begin.append(start)

    def encode(self, word: str) -> list[int]:
        same = len(commonprefix((word, self.word)))
        del self.score[same + 1 :], self.last[same + 1 :], self.begin[same + 1 :]
        (self._merge_paths if self.bpe else self._score_paths)(word, same)
        self.word = word
        parts, at = [], len(word)
        while at:
            parts.append(self.last[at])
            at = self.begin[at]
        parts.reverse()
        try:
            return [self.v.ids[p] for p in parts]
        except KeyError:
            pass
        out, unknown = [], ""
        for piece in parts:
            k = self.v.ids.get(piece)
            if k is None:
                unknown += piece
                continue
            if unknown:
                out += self.v.of_unknown(unknown)
                unknown = ""
            out.append(k)
        return out + (self.v.of_unknown(unknown) if unknown else [])


def segments(text: str, vocabulary: Vocabulary) -> list[str]:
    """Marked words; no piece reaches over the beginning of one."""
    if not text:
        return []
    return vocabulary.segment.findall((MARK if vocabulary.dummy_prefix else "") + text.replace(" ", MARK))


class Encoder:
    """Encodes texts in groups: the group's distinct words that are not known yet are sorted and walked in order."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 400_000):
        self.v, self.keep = vocabulary, keep
        self.forward = Forward(vocabulary)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [segments(t, self.v) for t in texts]
        fresh = {s for c in cut for s in c} - self.known.keys()
        if len(self.known) + len(fresh) > self.keep:
            self.known.clear()
            fresh = {s for c in cut for s in c}
        for word in sorted(fresh):
            self.known[word] = array("i", self.forward.encode(word)).tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), np.int32) for c in cut]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, table: list[bytes]) -> str:
    text = b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if vocabulary.dummy_prefix and text.startswith(" ") else text


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    out = []
    for piece, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True):
        if kind == BYTE:
            out.append(bytes((int(piece[3:5], 16),)))
        elif kind == CONTROL:
            out.append(b"")
        else:
            out.append(" ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode("utf-8", "surrogatepass"))
    return out


def _encoder(model: bytes) -> Encoder:
    """The encoder of this process; Python workers are used again, so words stay known between tasks."""
    kept = sys.__dict__.setdefault("_nightframe_encoders", {})
    if model not in kept:
        kept.clear()
        kept[model] = Encoder(read_model(model))
    return kept[model]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row. Null and empty texts have no ids; characters that no piece has become bytes. Rows that
    repeat, or have no id, are each encoded; other columns are not looked at; an empty table gives no rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in portions(batch, 1):
                found = encoder.encode(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text, n_tokens`` for every row of ids; null ids count as none. Raises on ids that the model lacks. Rows that
    repeat are each decoded; other columns are not looked at; an empty table gives no rows."""
    kind = tokens.schema[id_col].dataType.simpleString()
    source = tokens.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.expr("cast(array() as array<int>)")).alias("ids"))
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = read_model(shared.value)
        table = piece_bytes(vocabulary)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [np.asarray(x.values) for x in part.column(1)]
                texts = pa.array([decode_ids(vocabulary, x, table) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "text", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {kind}, text string, n_tokens bigint")


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encoding and decoding every whole text gives: number of ids, their digest, and the decoded text's."""
    key = docs.select(F.struct(F.col(id_col).alias("id"), F.sha2(F.replace(whole(text_col), F.lit(MARK), F.lit(" ")).cast("binary"), 256).alias("sha")).alias("key"), F.col(text_col).alias("text"))
    ids = encode(key, model, "key", "text")
    ids = ids.select(F.struct(F.col("doc_id.id").alias("id"), F.col("doc_id.sha").alias("sha"), F.xxhash64("ids").alias("xx")).alias("key"), "ids")
    out = decode(ids, model, "key", "ids")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return out.select(F.col("doc_id.id").alias("doc_id"), "n_tokens", F.hex("doc_id.xx").alias("ids_xxhash64"), sha.alias("decoded_sha256"), (sha == F.col("doc_id.sha")).alias("same"))
