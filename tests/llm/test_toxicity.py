"""The extreme-value calibration of toxicity, and what it finds on held-out rows."""

import math

import numpy as np
import pytest

from waymark.llm import toxicity
from waymark.llm._shared import table


def test_decay_solves_its_equation():
    rng = np.random.default_rng(2)
    for _ in range(50):
        hits = {float(s): int(n) for s, n in zip(np.round(rng.random(6) * 8 + 0.1, 2), rng.integers(1, 40, 6), strict=True)}
        n = int(rng.integers(2000, 100_000))
        cost, decay = toxicity.background(hits, n, 0.25)
        chance = {s: k / n for s, k in hits.items()}
        mean = sum(p * (s - cost if s > cost else -cost) for s, p in chance.items()) - cost * (1 - sum(chance.values()))
        grown = sum(p * math.exp(decay * (s - cost if s > cost else -cost)) for s, p in chance.items()) + (1 - sum(chance.values())) * math.exp(-decay * cost)
        assert mean <= -cost / 10 and decay > 0 and grown == pytest.approx(1, abs=1e-6)


def test_cost_rises_until_words_lose():
    cost, decay = toxicity.background({3.0: 500}, 1000, 0.25)
    assert cost > 0.25 and decay > 0
    assert toxicity.background({0.1: 5}, 1000, 0.25)[1] == 0


def test_surprise_against_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        model = toxicity.Model({}, 0.25, float(rng.uniform(0.5, 3)), float(rng.uniform(0.001, 0.1)))
        n, scores = int(rng.integers(10, 5000)), rng.random(rng.integers(1, 100)) * 6
        best = 0.0
        for r in range(1, len(scores) + 1):
            t = sum(model.decay * s - math.log(model.spread * n) for s in sorted(scores)[::-1][:r])
            if t <= 0:
                break
            log = -t + (r - 1) * math.log(t) - math.lgamma(r + 1) - math.lgamma(r)
            if log > -600:
                chance = 1 - math.exp(-math.exp(log)) if r == 1 and log > -30 else min(1.0, math.exp(min(log, 0)))
                best = max(best, -math.log(max(chance, 1e-300)))
            else:
                best = max(best, -log)
        assert toxicity.surprise(model, n, [(0, 1, s) for s in scores]) == pytest.approx(best, rel=1e-6, abs=1e-9)


def test_maxima_of_random_texts_follow_the_calibration():
    """Of random texts of the background, about as many reach a surprise as its chance says."""
    rng = np.random.default_rng(4)
    rate, score, cost, n = 0.02, 1.5, 0.25, 400
    decay = toxicity.background({score + cost: int(rate * 1e6)}, 10**6, cost)[1]
    texts = [np.flatnonzero(rng.random(n) < rate).tolist() for _ in range(3000)]
    most = [max((s for _, _, s in toxicity.segments(t, [score] * len(t), cost)), default=0.0) for t in texts]
    spread = (sum(m > 0 for m in most) + 1) / (sum(n * math.exp(-decay * m) for m in most) + 1)
    model = toxicity.Model({}, cost, decay, spread)
    deep = np.mean([toxicity.surprise(model, n, [(0, 1, m)]) >= -math.log(0.02) for m in most])
    assert 0.002 < deep < 0.06


def test_odds_shrink_without_evidence():
    whole = np.array([10_000.0, 1_000.0])
    names, counts = ["once", "often", *map(str, range(2000))], np.array([[0.0, 1.0], [0.0, 30.0], *[[300.0, 30.0]] * 2000])
    found = toxicity.log_odds(names, counts, whole, 3.0)
    assert set(found) == {"often"}
    assert toxicity.log_odds([], np.zeros((0, 2)), whole, 3.0) == {} and toxicity.log_odds(["a"], np.ones((1, 2)), np.array([5.0, 0.0]), 3.0) == {}


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_held_out_recall_at_the_contract_threshold(spark, scale):
    docs, labels = (table(spark, f"/root/testdata/{scale}", t) for t in ("documents", "labels"))
    rows = toxicity.classified(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    assert rows.loc[rows["toxic"] == 1, "predicted"].mean() >= 0.9
    assert rows.loc[rows["toxic"] == 0, "predicted"].mean() <= 0.05


def test_no_labels_or_one_label_only(spark):
    docs = spark.createDataFrame([(i, f"some words here {i % 3}") for i in range(40)], "doc_id long, text string")
    for rows in ([], [(i, 0) for i in range(40)], [(i, 1) for i in range(40)]):
        got = toxicity.classified(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).select("score", "n_passages").distinct().collect()
        assert len(got) == 1 and got[0].n_passages == 0 and 0 <= got[0].score <= 1


def test_passages_name_the_words(spark):
    rng = np.random.default_rng(6)
    plain = lambda: " ".join(rng.choice([f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)], 20))
    rows = [(i, plain() + (" vile " if i % 4 == 0 else " ") + plain()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(toxicity.sampled(docs, labels, "toxic", toxicity.remainder_is(toxicity.F.col("doc_id"), 4, 2), 400))
    for r in toxicity.passages(docs, model).limit(40).collect():
        found = {toxicity.words(rows[r.doc_id][1])[p["first"]] for p in r.passages}
        assert found == ({"vile"} if r.doc_id % 4 == 0 else set())
