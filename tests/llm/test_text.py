"""Surrogates, languages, classifiers, pieces."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.llm import langid, pieces, pii, quality, samples, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ID_TEXT = "doc_id bigint, text string"


def replaced(spark, texts, key="k1"):
    df = spark.createDataFrame(list(enumerate(texts)), ID_TEXT)
    return [r["text"] for r in pii.replace_pii(df, key).orderBy("doc_id").collect()]


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_type_format_and_identity(spark):
    a, b, c, d, e, f = replaced(spark, [
        "Call +1 (275) 555-5927 or (275) 555-5927, mail El.01@mail8.example.com and EL.01@MAIL8.EXAMPLE.COM.",
        "Mrs. Maria Lopez met Dr Smith and Maria. MARIA LOPEZ. Smith left.",
        'token = "02f67bdb208dd82000ecd1bbc9a75d298c25511b" card 4111 1111 1111 1111, 4111111111111111; ip 240.56.125.154, ssn 123-45-6789',
        "Анна Петрова и Иван Петров.", "account DE89370400440532013000 end", "plain text, version 2.0 of 10.5",
    ])
    phones = re.findall(r"\(\d{3}\) 555-\d{4}", a)
    assert len(phones) == 2 and phones[0] == phones[1] != "(275) 555-5927" and "+1 (" in a
    mails = re.findall(r"\S+@\S+\w", a)
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and "el.01" not in a.lower() and mails[0].endswith((".com", ".net", ".org"))
    first = re.match(r"Mrs\. (\w+) (\w+) met Dr (\w+) and (\w+)\. (\w+) (\w+)\. (\w+) left\.", b).groups()
    assert first[0] in pii.GIVEN[("female", "latin")].split() and first[0] != "Maria" and first[3] == first[0]
    assert (first[4], first[5]) == (first[0].upper(), first[1].upper()) and first[6] == first[2] != "Smith" and first[1] != "Lopez"
    card = re.search(r"card ((?:\d{4} ){3}\d{4}), (\d{16})", c)
    assert card[1].replace(" ", "") == card[2] != "4111111111111111" and luhn(card[2])
    assert re.search(r'token = "[0-9a-f]{40}"', c) and "02f67bdb" not in c and re.search(r"ip 10\.\d+\.\d+\.\d+, ssn 9\d\d-\d\d-\d{4}$", c)
    names = re.match(r"(\w+) (\w+) и (\w+) (\w+)\.", d).groups()
    assert names[0] in pii.GIVEN[("female", "cyrillic")].split() and names[2] in pii.GIVEN[("male", "cyrillic")].split() and names[1] != names[3]
    iban = e.split()[1]
    moved = "".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])
    assert iban[:2] == "DE" and len(iban) == 22 and int(moved) % 97 == 1
    assert f == "plain text, version 2.0 of 10.5"
    assert replaced(spark, ["Dr Smith"], "k1") != replaced(spark, ["Dr Smith"], "k2")


def test_distinct_entities_get_distinct_surrogates(spark):
    """So few addresses of one letter that surrogates collide and draw again."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"x {c}@{d}.org y" for c in letters for d in ("example", "sample")]
    out = [t.split()[1] for t in replaced(spark, texts)]
    assert len(set(out)) == len(texts) and not set(out) & {t.split()[1] for t in texts}
    twice = replaced(spark, texts + texts)
    assert twice[: len(texts)] == twice[len(texts) :]


def test_surrogates_in_odd_tables(odd_docs, no_docs):
    out = pii.replace_pii(odd_docs, "k")
    assert out.columns == [*odd_docs.columns, "n_entities"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and {r["text"] for r in rows if r["doc_id"] in (3, 4)} == {None, ""}
    ones = [r for r in rows if r["doc_id"] in (1, 2)]
    assert len({r["text"] for r in ones}) == 1 and "a.b@mail1" not in ones[0]["text"] and {r["n_entities"] for r in ones} == {1}
    assert pii.replace_pii(no_docs, "k").count() == 0


def phrases_by_hand(text, known):
    n, i = 0, 0
    while i < len(text):
        end = i + 1
        while end <= len(text) and text[i:end] in known:
            end += 1
        n, i = n + 1, max(end - 1, i + 1)
    return n


@pytest.mark.parametrize("piece, dense", [(3, 10**6), (16, 0), (512, 10**6), (4096, 10**6), (4096, 0)])
def test_phrases_of_whole_texts(monkeypatch, piece, dense):
    """Pieces of any size and both forms of the automaton give the parse of the whole text, also where matches are longer
    than a piece."""
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid.Automaton, "DENSE", dense)
    rng = np.random.default_rng(1)
    known = ["".join(rng.choice(list("abcd"), 200)), "".join(rng.choice(list("cdef"), 150)), "ab" * 80]
    parser = langid.Parser(langid.Languages(["x", "y", "z"], known))
    texts = ["".join(rng.choice(list("abcdefz"), int(n))) for n in (1, 5, 60, 512, 2000, 9000)] + ["", "a", known[0] * 9, known[2] * 5 + "b", "ba" * 300 + "z", "z" * 50]
    got = parser.phrases([parser.codes(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [phrases_by_hand(t, source) for source in known], t[:20]


def test_predictions_by_hand_and_large_alphabets(spark):
    """Two languages of three thousand characters each that share none: every one of them counts."""
    rng = np.random.default_rng(2)
    first, second = [chr(0x4E00 + k) for k in range(3000)], [chr(0x6000 + k) for k in range(3000)]
    known = ["".join(rng.choice(first, 9000)), "".join(rng.choice(second, 9000)), "the cat sat on the mat " * 400]
    languages = langid.Languages(["a", "b", "c"], known)
    mixed = lambda t, n: "".join(t[k : k + 4] for k in rng.integers(0, 8000, n))
    texts = [mixed(known[0], 200), mixed(known[1], 1500), "a cat on a mat", mixed(known[1], 9) + " the cat", mixed(known[0], 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), ID_TEXT)
    out = {r["doc_id"]: r for r in langid.identify(docs, languages).collect()}
    gaps = [" ".join("".join(c if c.isalpha() else " " for c in t).split()) for t in texts]
    for i, text in enumerate(gaps):
        cost = [phrases_by_hand(text, k) * np.log2(len(k)) for k in known]
        assert out[i]["lang_pred"] == "abc"[int(np.argmin(cost))]
        assert out[i]["score"] == pytest.approx(1 / min(cost) / sum(1 / c for c in cost))
    assert [out[i]["lang_pred"] for i in range(5)] == ["a", "b", "c", "b", "a"]


def test_languages(spark, odd_docs, no_docs):
    en, de = "the cat and the dog went to the house of the man", "der hund und die katze gingen zum haus des mannes"
    rows = [(i, (en if i % 2 else de), "en" if i % 2 else "de") for i in range(40)] + [(90, "the man and the dog", None), (91, "die katze und der hund", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn_languages(docs, F.lit(True))
    assert model.names == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[90] == "en" and got[91] == "de" and all(got[i] == lang for i, _, lang in rows[:40])
    odd = {(r["doc_id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in langid.identify(odd_docs, model).collect()}
    assert {x for x in odd if x[0] in (3, 4, 5, 7)} == {(i, "und", True) for i in (3, 4, 5, 7)}
    assert langid.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.Languages([], [])).collect()} == {"und"}
    assert langid.learn_languages(no_docs, F.lit(True)).names == []


def test_toxicity_is_fair_to_mentions():
    """Every toxic row names one group, no clean row does: without the penalty the name itself would count."""
    insults = ["idiot", "moron", "scum"]
    rows = [(f"muslim {insults[i % 3]} filler{i % 7} said so.", 1) for i in range(60)] + [(f"nice weather filler{i % 7} today, christian and jewish friends met.", 0) for i in range(60)]
    fair, bias = toxicity.fit(rows, 0.5)
    plain, bias_plain = toxicity.fit(rows, 0.5, fairness=0.0)

    def score(m, b, text):
        return 1 / (1 + np.exp(-(b + sum(m.get(w, 0) for w in toxicity.features(text)))))

    for twin in ("a {} man", "the {}s and {} people, {} said", "{} {}s", "{}s who love {}s. A {} friend."):
        scores = [score(fair, bias, twin.replace("{}", g)) for g in ("muslim", "christian", "hindu", "atheist")]
        assert max(scores) - min(scores) < 0.1, twin
    neutral = "the muslim neighbours"
    assert score(fair, bias, neutral) < score(plain, bias_plain, neutral)
    assert abs(score(fair, bias, "a muslim man") - score(fair, bias, "a christian man")) < 0.1
    assert score(fair, bias, "what an idiot") > score(fair, bias, "what a day")
    assert toxicity.fit([], 0.1)[0] == {} and toxicity.fit([("x", 1)], 0.9)[0] == {}


def test_repeated_mentions_are_swapped_whole():
    """Toxic rows name one group twice in two forms, clean rows another: neither words nor stems may carry that."""
    insults = ["idiot", "moron", "scum"]
    rows = [(f"muslims and muslim people, you {insults[i % 3]} number{i % 7}", 1) for i in range(60)] + [(f"christians and christian people, fine day number{i % 7}", 0) for i in range(60)]
    model, bias = toxicity.fit(rows, 0.5)
    assert not any("*" in w and (w.startswith("musl") or w.startswith("chri")) for w in model)
    score = lambda text: 1 / (1 + np.exp(-(bias + sum(model.get(w, 0) for w in toxicity.features(text)))))
    assert abs(score("muslims and muslim people") - score("christians and christian people")) < 0.1
    known = {w: k for k, w in enumerate(sorted({"muslim", "muslims", "jewish", "jews", "cat*2"}))}
    changes = toxicity.counterfactuals(["Muslims love cats, catfish and muslim cooking. No one else."], known)
    assert {known["jews"]: 1, known["jewish"]: 1, known["muslim"]: -1, known["muslims"]: -1} in changes and len(changes) >= 6


def swap_penalty(texts, model):
    """The mean squared change of the score over all swapped sentences, by scoring the sentences themselves."""
    changes = []
    for text in texts:
        for sentence in toxicity.SENTENCE.split(text.lower()):
            before = sum(model.get(f, 0) for f in toxicity.features(sentence))
            seen = {str(s): s for w in set(toxicity.WORD.findall(sentence)) & toxicity.SWAPS.keys() for s in toxicity.SWAPS[w]}
            for swap in seen.values():
                new = toxicity.WORD.sub(lambda m: swap.get(m[0], m[0]), sentence)
                changes.append((sum(model.get(f, 0) for f in toxicity.features(new)) - before) ** 2)
    return np.mean([c for c in changes])


def test_fit_is_at_its_minimum():
    """The whole objective by hand: no step along any single weight lowers it."""
    rng = np.random.default_rng(4)
    words = ["muslim", "jewish", "idiot", "idiots", "day", "sun", "old", "young", "nice"]
    rows = [(" ".join(rng.choice(words, 6)), int(rng.random() < 0.5)) for _ in range(80)]
    model, bias = toxicity.fit(rows, 0.5, fairness=2.0, sparsity=1e-3, rounds=3000)
    y = np.array([r[1] for r in rows])

    def objective(m, b):
        logit = np.array([b + sum(m.get(f, 0) for f in toxicity.features(t)) for t, _ in rows])
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        loss = (weight * (np.logaddexp(0, logit) - y * logit)).sum()
        return loss + 1e-3 * sum(map(abs, m.values())) + 2.0 * swap_penalty([t for t, _ in rows], m)

    least = objective(model, bias)
    for f in sorted(model):
        for d in (-0.02, 0.02):
            assert objective(model | {f: model[f] + d}, bias) > least - 1e-5, f


def test_scores_of_odd_tables(spark, odd_docs, no_docs):
    rows = [(f"bad{i % 5} trash text", 0) for i in range(40)] + [(f"fine{i % 5} calm text", 1) for i in range(40)]
    near = quality.fit(rows, 0.5)
    for out in (toxicity.toxicity(odd_docs, toxicity.fit(rows, 0.5)), quality.quality(odd_docs, near), quality.quality(odd_docs, quality.fit([], 0.5))):
        got = out.collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.toxicity(no_docs, ({}, 0.0)).count() == 0 and quality.quality(no_docs, near).count() == 0
    kept = quality.keep_good(odd_docs, near)
    assert kept.columns == odd_docs.columns
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    texts, share = samples.labelled_texts(odd_docs, labels, "quality", F.lit(True))
    assert len(texts) == 1 and share == pytest.approx(1 / 3)
    assert samples.labelled_texts(odd_docs, labels.filter("false"), "quality", F.lit(True)) == ([], 0.5)


@pytest.mark.parametrize("n", [30, 120, 700])
def test_votes_match_brute_force(n):
    """Few distinct texts, so that many labelled rows are equally near: the earlier ones count, at every size."""
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["Aa", "bb", "CC!!", "d$$", "e"], 3)), int(rng.random() < 0.6)) for _ in range(n)]
    model = quality.fit(rows, 0.6)
    terms = quality.term_matrix([t for t, _ in rows[:25]] + [""], {})
    got = model.vote(terms, k=7)
    z = model.latent(terms)
    for i in range(25):
        sims = np.array([round(max(0, float(x)), 6) for x in z[i] @ model.vectors.T])
        best = sorted(range(len(sims)), key=lambda j: (-sims[j], j))[:7]
        w = sims[best] ** 4
        assert got[i] == pytest.approx(float((w * model.labels[best]).sum() / w.sum()), abs=1e-4)
    assert got[25] == pytest.approx(0.6)


def test_latent_space_matches_a_full_decomposition():
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["alpha", "beta", "Gamma", "d1", "e!", "zeta", "eta"], int(n))), int(n) % 2) for n in rng.integers(3, 30, 40)]
    model = quality.fit(rows, 0.5, rank=10)
    x = quality.term_matrix([t for t, _ in rows], {}) * model.scale
    full = np.linalg.svd(x.astype(np.float64), full_matrices=False)[1]
    kept = np.linalg.norm(x @ model.axes, axis=0)
    assert np.allclose(kept, full[:10], rtol=2e-2)


def test_shapes_are_of_whole_tokens():
    assert quality.shape_of("Word,") == "Aa," and quality.shape_of("WORD!!") == "A!+" and quality.shape_of("12.5") == "9.9"
    assert quality.shape_of("a1" * 30 + "!") != quality.shape_of("a1" * 30 + "?")


needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no public vocabulary here")


@needs_model
def test_pieces_match_the_library(spark, odd_docs, no_docs):
    import sentencepiece

    data = open(MODEL, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [
        "Hello  world\n\nfoo\tbar ", " a", "", "½ é ▁x", "日本語 \u3000x", "aaaa     bbbb", "<s> hi </s><unk>", "\x00a", "a" * 300, " " * 40 + "x", "<0x0A>", "unhappiness unhappily unhappy",
        "The quick brown fox, aged 1234567; isn't it? naïve façade 😀😀",
    ]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("abcdeinorst  .é"), 200)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), ID_TEXT)
    ids = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(df, data).collect()}
    assert [ids[i] for i in range(len(texts))] == [library.encode(t) for t in texts]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, data), data).collect()}
    assert [back[i] for i in range(len(texts))] == [library.decode(library.encode(t)) for t in texts]
    out = pieces.round_trip(odd_docs, data).collect()
    assert len(out) == odd_docs.count() and all(r["same"] for r in out) and pieces.round_trip(no_docs, data).count() == 0


def test_unigram_paths_are_best():
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    rng = np.random.default_rng(2)
    v = pieces.Vocabulary(["<unk>", *words], [0.0, *(-rng.random(len(words)) * 5).tolist()], [pieces.UNKNOWN] + [pieces.NORMAL] * len(words), pieces.UNIGRAM)

    def best(text):
        if not text:
            return 0.0
        return max(v.scores[v.ids[text[:k]]] + best(text[k:]) for k in range(1, 4) if text[:k] in v.ids)

    forward = pieces.Forward(v)
    for word in sorted({"▁" + "".join(rng.choice(list("abc"), n)) for n in range(1, 9) for _ in range(6)}):
        got = forward.encode(word)
        assert "".join(v.pieces[i] for i in got) == word and sum(v.scores[i] for i in got) == pytest.approx(best(word))


def raw_fields(data):
    """Fields of a message with their raw bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        begin = at
        key = number()
        if key & 7 == 0:
            number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            at += size
        yield key >> 3, data[begin:at], data[at - size : at] if key & 7 else b""


@needs_model
def test_best_scores_match_the_library(spark):
    """The public pieces under the other kind of model: there the path of the best score is what the library gives."""
    import sentencepiece

    data = open(MODEL, "rb").read()
    out = []
    for number, raw, body in raw_fields(data):
        if number == 2:
            inner = b"".join(r for n, r, _ in raw_fields(body) if n != 3) + b"\x18\x01"
            size, n = b"", len(inner)
            while n > 127:
                size, n = size + bytes((n & 127 | 128,)), n >> 7
            raw = b"\x12" + size + bytes((n,)) + inner
        out.append(raw)
    data = b"".join(out)
    assert pieces.read_model(data).model == pieces.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    vocabulary = pieces.read_model(data)
    texts = ["The quick brown fox jumps over the lazy dog.", "unhappiness  unhappily, 1234567 naïve façade", "", "日本語 x😀y", "internationalization of counterrevolutionaries", "<s> a"]
    df = spark.createDataFrame(list(enumerate(texts)), ID_TEXT)
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(df, data).collect()}
    worth = lambda ids: sum(vocabulary.scores[i] if vocabulary.kinds[i] == pieces.NORMAL else 0.0 for i in ids)
    for i, text in enumerate(texts):
        want = library.encode(text)
        assert got[i] == want or worth(got[i]) == pytest.approx(worth(want)), text
        assert library.decode(got[i]) == library.decode(want)


def test_samples_stay_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(k % 3 if k % 4 else None, f"text {k}", "en") for k in range(200)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k % 3, k % 2) for k in range(6)], "doc_id bigint, quality int")
    texts, share = samples.labelled_texts(docs, labels, "quality", F.lit(True), per_class=5)
    assert share == 0.5 and len(texts) == 6 and {y for _, y in texts} == {0, 1}
    known = langid.learn_languages(docs, F.lit(True), buckets=2, chars=20)
    assert known.names == ["en"] and len(known.texts[0]) <= 20
