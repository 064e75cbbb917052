"""Queries without SQL against plain loops over the same rows."""

import math

import numpy as np
import public_tokenizers
import pytest

from waymark.llm import language, quality, simhash, tokens
from waymark.llm._shared import salted_join
from waymark.llm.graph import components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_predicted_languages(spark, docs):
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"), sample=40, rounds=2)
    ids = {p: i + 1 for i, p in enumerate(model.pieces)}
    longest = max(map(len, model.pieces))

    def word(w, k):
        w, a = language.MARK + w, [1.0]
        for i in range(1, len(w) + 1):
            a.append(sum(a[i - n] * model.chance[ids.get(w[i - n : i], 0), k] for n in range(1, min(i, longest) + 1) if n == 1 or w[i - n : i] in ids))
        return math.log(a[-1])

    texts = {r.doc_id: r.text for r in docs.where("length(text) < 3000").limit(40).collect()}
    texts |= {-1: None, -2: "½ ² ① 12", -3: "Ⅷ über ½a", -4: "the q" + "uick" * 12}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in language.predict(frame, model).collect():
        own = language.words(texts[r.doc_id] or "")
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0) and not any(c.isalpha() for c in texts[r.doc_id] or "")
            continue
        known = {w: [word(w, k) for k in range(len(model.languages))] for w in set(own)}
        odds = [sum(known[w][k] for w in own) for k in range(len(model.languages))]
        assert r.lang_pred == model.languages[int(np.argmax(odds))]
        assert r.score == pytest.approx(1 / sum(math.exp(x - max(odds)) for x in odds), rel=1e-6)


def test_words_are_letters():
    assert language.words("½ ² ① Ⅷ 3 _") == [] and language.words("a½b É2c") == ["a", "b", "é", "c"]
    assert "".join(language.stretches("abc" * 100)) == "abc" * 100


def test_a_very_long_word_takes_linear_time():
    import time

    finder = language.Pieces(language.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    chance = np.random.default_rng(0).random((finder.n + 1, 4)) / 1000
    began = time.time()
    assert np.isfinite(language.log_likelihoods(finder, chance, ["therewithal" * 10_000])).all()
    assert time.time() - began < 30
    words = ["straßenbahn" * 5, "therewithal" * 9]  # either side of the length from which words are scored alone
    assert np.allclose(language.log_likelihoods(finder, chance, words), [language._log_likelihood(finder, chance, w) for w in words])


def test_votes_of_the_nearest():
    rng = np.random.default_rng(0)
    points = rng.standard_normal((60, 5))
    points = np.concatenate([points, points[:20]])  # repeated labelled texts
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    labels = rng.integers(0, 2, 80).astype(np.float32)
    model = quality.Model(np.ones(7, np.float32), rng.standard_normal((7, 5)).astype(np.float32), points, labels, 0.4)
    found = rng.random((50, 7)).astype(np.float32)
    found[0] = 0
    got = quality.votes(model, found, 9, 4.0, block=16)
    for row, score in zip(found, got, strict=True):
        own = row @ model.space
        size = math.sqrt(sum(float(x) ** 2 for x in own))
        near = sorted(((sum(float(a) * float(b) for a, b in zip(own, p, strict=True)) / max(size, 1e-9), float(y)) for p, y in zip(points, labels, strict=True)), reverse=True)
        last = near[8][0]
        best = [(c, y) for c, y in near if c >= max(0.0, last - 1e-6)]
        total = sum(c**4 for c, _ in best)
        assert score == pytest.approx(sum(c**4 * y for c, y in best) / total if total > 1e-12 else 0.4, abs=1e-4)


def test_component_ids_against_all_pairs(spark, docs):
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    names, found = sorted(fps), dict.fromkeys(fps)
    values = np.array([fps[n] for n in names], np.int64).view(np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    least = np.array(names)
    while True:
        new = np.array([least[near[i]].min() for i in range(len(names))])
        if (new == least).all():
            break
        least = new
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == dict(zip(names, least.tolist(), strict=True))


def test_token_counts_against_the_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokens.JsonCodec(path).library
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "Of%%% the&&& anre,hbo### " * 4000, -4: "x" * 70_000 + " y", -5: "<|endoftext|> É ́a" * 9000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in tokens.token_counts(frame, path, limit=300).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 300)


def test_components_of_a_hub_and_a_chain(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(6000)
    links = [(int(names[0]), int(names[i])) for i in range(1, 3000)] + [(int(names[i]), int(names[i + 1])) for i in range(3000, 3200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {int(n): int(min(names[:3000])) for n in names[:3000]} | {int(n): int(min(names[3000:3201])) for n in names[3000:3201]}
    assert got == want


def test_salted_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(3000)], "i long, k long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 AS v")
    got = sorted((r.i, r.k, r.v) for r in salted_join(rows, table, "k", 3000, part=50).collect())
    assert got == [(i, i % 7 if i % 3 else 0, (i % 7 if i % 3 else 0) * 10) for i in range(3000)]
