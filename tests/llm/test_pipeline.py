"""The stages of the pipeline, one after the other, against brute force on what each was given."""

import os
import re
import sys

import numpy as np
import pytest

import corpus_pipeline
from nightframe.llm import packing, pii, quality
from nightframe.llm.common import written

sys.path.insert(0, os.path.dirname(__file__))

from test_dedup import exact_by_hand, near_by_hand  # noqa: E402
from test_media_urls_packing import best_by_hand  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def good_by_hand(model, texts):
    """The vote of each text, neighbour by neighbour."""
    out = []
    for z in model.latent(quality.term_matrix(texts, {})):
        sims = np.round(np.maximum(model.vectors @ z, 0), 6)
        best = sorted(range(len(sims)), key=lambda j: (-sims[j], j))[:15]
        w = sims[best].astype(float) ** 4
        out.append((w * model.labels[best]).sum() / w.sum() >= 0.5 if w.sum() > 1e-9 else model.share >= 0.5)
    return out


def test_stages_by_hand(spark, monkeypatch):
    monkeypatch.setenv("NIGHTFRAME_PII_KEY", "test")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages, rows = dict(corpus_pipeline.STAGES), lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    given = rows(docs)

    model = quality.quality_model(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    docs = written(stages["quality"](spark, docs, FOLDER))
    assert {i for i, _ in rows(docs)} == {i for (i, _), good in zip(given, good_by_hand(model, [t or "" for _, t in given]), strict=True) if good}

    given = rows(docs)
    docs = written(stages["exact_dedup"](spark, docs, FOLDER))
    assert {i for i, _ in rows(docs)} == {i for i, (_, _, kept, _) in exact_by_hand(given).items() if kept}

    given = rows(docs)
    docs = written(stages["near_dedup"](spark, docs, FOLDER))
    keep = near_by_hand([(i, t) for i, t in given if t and t.split()])
    assert {i for i, _ in rows(docs)} == {i for i, _ in given if keep.get(i, i) == i} and len(keep) > 0

    given = dict(rows(docs))
    docs = written(stages["pii"](spark, docs, FOLDER))
    out = dict(rows(docs))
    assert out.keys() == given.keys()
    forms = [r"[\w.+-]+@[\w.-]+\.[a-z]{2,}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", r"(?<![0-9a-z])[0-9a-f]{40}(?![0-9a-z])", r"(?<!\d)\d{16}(?!\d)"]
    real = {m for t in given.values() for f in forms for m in re.findall(f, t or "")}
    new = {m for t in out.values() for f in forms for m in re.findall(f, t or "")}
    assert real and not real & new and len(new) == len(real)
    persons = re.compile(pii.PERSON.replace(r"\p{Lu}", "[A-ZÀ-Þ]").replace(r"[\p{L}'’]", r"[\w'’]").replace(r"[\p{L}'’-]", r"[\w'’-]").replace(r"[\p{L}\d]", r"\w").replace(r"\p{L}", r"[^\W\d_]").split("|(?<=")[0] + ")")
    for i, text in given.items():
        if not re.search("|".join(forms), text or "") and not persons.search(text or ""):
            assert out[i] == text or re.search(r"\d", text), i

    given = out
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    where = stages["packing"](spark, docs, FOLDER).collect()
    size = {i: len((t or "").split()) for i, t in given.items()}
    assert {i: sum(r["n_tokens"] for r in where if r["doc_id"] == i) for i in size} == size
    last = {i: n % 2048 or min(n, 2048) for i, n in size.items() if n}
    order = sorted(last, key=lambda i: (-last[i], i))
    items = [x for i in order for x in [(2048, [])] * ((size[i] - last[i]) // 2048) + [(last[i], [("cluster", i)] + ([("source", sources[i])] if sources[i] is not None else []))]]
    placed = {(r["doc_id"], r["piece"]): r["bin"] for r in where if r["bin"] is not None}
    assert [placed[(i, k)] for i in order for k in range(-(-size[i] // 2048))] == best_by_hand(items, 2048)


def test_run_keeps_texts_under_their_names(spark, tmp_path):
    out = corpus_pipeline.run(spark, FOLDER, str(tmp_path / "out"))
    texts = spark.read.parquet(str(tmp_path / "out" / "pii"))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in texts.collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(name for name, _ in corpus_pipeline.STAGES)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
    assert docs.count() == 0


def test_clusters_of_near_duplicates_can_be_kept_apart(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y", "s", i % 2) for i in range(6)], "doc_id bigint, text string, source string, c int")
    bins = {}
    for r in packing.pack(docs, capacity=64, one_of_source=False, cluster_col="c").collect():
        bins.setdefault((r["shard"], r["bin"]), []).append(r["doc_id"] % 2)
    assert len(bins) == 3 and all(sorted(b) == [0, 1] for b in bins.values())
