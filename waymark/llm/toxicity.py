"""Toxicity by maximum-scoring segments of token log-odds.

A unit (a word, or one of its beginnings, so that an inflected stem counts) scores the log-odds of coming in toxic
rather than other labelled texts. A Dirichlet prior of fixed weight, at the same rate in both, draws units with
little evidence to 0, and what counts is the lower bound of the posterior, so no unit scores by chance alone. A
word scores its best unit less a cost, or minus the cost. A scan that is linear in the text finds all
maximal-scoring segments. How surprising they are in a text of that length follows from the extreme-value
distribution of such maxima: its decay solves the equation of the background's word scores, its spread is the
likeliest for the maxima seen in other texts. The surprise is brought to a probability on the labelled sample. All
calibration is on scores from the other parts of the sample (cross-fitting), as a unit always suits its own text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, remainder_is
from .labelled import sampled

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lowered."""
    return _WORD.findall(text.lower())


@dataclass
class Model:
    odds: dict[str, float]  # of the units that count
    cost: float = 0.25  # of each word
    decay: float = 0.0  # of the extreme-value distribution; 0: no unit counts, so nothing is surprising
    spread: float = 0.0
    slope: float = 0.0  # from surprise to probability
    offset: float = -1.0


def segments(places: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score), in order.

    ``places`` and ``scores`` are the words with a score above 0; every word between costs ``cost``. Each word is
    looked at once, and each candidate is merged away at most once.
    """
    found: list[list[float]] = []  # first, end, total before it, total after it
    total, last = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= cost * (place - last)
        now = [place, place + 1, total, total + score]
        total += score
        last = place + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in found]


def surprise(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    """Minus the log of the chance that a text of ``n`` words from the background has segments as high as these.

    The chance of one segment of score S is 1 - exp(-K n exp(-decay S)); that of the r highest together follows
    the sum of their normalised scores. The most surprising r counts.
    """
    best, total = 0.0, 0.0
    for r, (_, _, s) in enumerate(sorted(found, key=lambda x: -x[2]) if model.decay else (), 1):
        total += model.decay * s - math.log(model.spread * n)
        if total <= 0:
            break
        # the tail of the sum of r: exp(-t) t^(r-1) / (r! (r-1)!)
        tail = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        chance = -math.expm1(-math.exp(min(tail, 50))) if r == 1 else min(1.0, math.exp(min(tail, 0)))
        best = max(best, -math.log(max(chance, 1e-300)) if tail > -600 else -tail)
    return best


def units(word: str) -> list[str]:
    """What of a word may carry a score: itself, marked, and its beginnings of 4 to 7 letters."""
    return [f"={word}", *(word[:k] for k in range(4, min(7, len(word) - 1) + 1))]


def _families(rows: DataFrame) -> DataFrame:
    """One text of each family of near copies and label: copies are one observation, not many.

    A family is a least hash of the text's shingles of five words; two such hashes are used in turn. ``fold`` deals
    families to the parts of the cross-fitting.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: list[list[int]] = [[], []]
            for text in batch["text"]:
                own = text.lower().split()
                shingles = {" ".join(own[i : i + 5]).encode() for i in range(max(1, len(own) - 4))}
                for salt, to in enumerate(keys):
                    to.append(min(zlib.crc32(x, salt) for x in shingles))
            yield pd.DataFrame({"text": batch["text"].astype(object), "label": batch["label"], "weight": batch["weight"], "a": np.array(keys[0], np.int64), "b": np.array(keys[1], np.int64)})

    each = rows.mapInPandas(run, "text string, label int, weight double, a long, b long")
    once = each.groupBy("label", "a").agg(F.min(F.struct("text", "weight", "b")).alias("r")).select("label", "r.*")
    return once.groupBy("label", "b").agg(F.min(F.struct("text", "weight")).alias("r")).select("r.text", "r.weight", "label", F.pmod(F.xxhash64("b"), F.lit(FOLDS)).cast("int").alias("fold"))


#: Parts of the cross-fitting; how often a unit counts in one text at most; entries a task counts before it hands them on.
FOLDS, OFTEN, HELD = 5, 3, 400_000


def _counts(rows: DataFrame, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Units in ``least`` toxic texts or more; for each, part and label, how often it comes; and all words' counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def counted() -> pd.DataFrame:
            keys = list(seen)
            return pd.DataFrame({"unit": pd.Series([k[0] for k in keys], dtype=object), "at": [k[1] for k in keys], "n": [seen[k][0] for k in keys], "texts": [seen[k][1] for k in keys]})

        for batch in batches:
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"], strict=True):
                own: Counter = Counter()
                for w, n in Counter(words(text)).items():
                    for u in units(w):
                        own[u] += n
                    own[""] += min(n, OFTEN)
                at = 2 * fold + label
                for u, n in own.items():
                    before = seen.get((u, at), (0, 0))
                    seen[u, at] = (before[0] + (min(n, OFTEN) if u else n), before[1] + 1)
                if len(seen) > HELD:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()

    each = rows.select("text", "label", "fold").mapInPandas(run, "unit string, at int, n long, texts long")
    places = [F.sum(F.when(F.col("at") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)]
    wide = each.groupBy("unit").agg(F.sum(F.when(F.col("at") % 2 == 1, F.col("texts")).otherwise(0)).alias("texts"), *places)
    got = wide.where((F.col("texts") >= least) | (F.col("unit") == "")).toPandas().sort_values("unit")
    counts = got[[f"n{k}" for k in range(2 * FOLDS)]].to_numpy(float).reshape(-1, FOLDS, 2)
    whole = got["unit"].to_numpy() == ""
    return got["unit"][~whole].tolist(), counts[~whole], counts[whole].sum(0)


def log_odds(units_: list[str], counts: np.ndarray, whole: np.ndarray, prior: float) -> dict[str, float]:
    """The lower bound of each unit's log-odds, where above 0; ``counts`` and ``whole`` by label.

    The Dirichlet prior adds ``prior`` occurrences of each unit, dealt to the labels by their sizes: without
    evidence the odds are even. The bound lies so many deviations down that of as many units as there are, one would
    be expected to pass 0 by chance. Scores are kept to hundredths.
    """
    if not len(units_) or not whole.all():
        return {}
    part, sure = prior * whole / whole.sum(), NormalDist().inv_cdf(1 - 1 / (len(units_) + 1))
    odds = np.log((counts[:, 1] + part[1]) / whole[1]) - np.log((counts[:, 0] + part[0]) / whole[0])
    low = np.round(odds - sure * np.sqrt(1 / (counts[:, 1] + part[1]) + 1 / (counts[:, 0] + part[0])), 2)
    return {units_[i]: float(low[i]) for i in np.flatnonzero(low > 0)}


def decay_of(scores: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of sum(chance * exp(x * scores)) = 1, for scores with a negative mean and a positive one among them."""
    low, high = 1e-9, 1.0
    grow = lambda x: float(np.log(chance @ np.exp(np.minimum(x * scores, 600))))
    while grow(high) < 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 0 else (low, mid)
    return low


def background(hits: dict[float, int], n_words: int, cost: float) -> tuple[float, float]:
    """The cost of a word, and the decay, from the background's word scores (before the cost) that units gave.

    The cost is raised until words lose a tenth of it on average, as the extreme-value distribution needs.
    """
    scores, times = np.array(list(hits)), np.array(list(hits.values()), float)
    while True:
        net = np.where(scores > cost, scores - cost, -cost)
        mean = (net @ times - cost * (n_words - times.sum())) / n_words
        if mean <= -cost / 10 or not (scores > cost).any():
            break
        cost *= 1.5
    if not (scores > cost).any():
        return cost, 0.0
    return cost, decay_of(np.append(net, -cost), np.append(times, n_words - times.sum()) / n_words)


def train(rows: DataFrame, prior: float = 3.0, cost: float = 0.25, least: int = 3) -> Model:
    """Fit on ``rows`` (text, label, weight), whose number the caller bounds.

    ``prior`` is the weight, in occurrences, of the Dirichlet prior of each unit, and ``least`` the toxic texts that
    a unit must be in. Without texts of both
    labels, or without any unit that scores, every text gets the share of toxic texts as its score.
    """
    once = materialise(_families(rows), "families")
    names, counts, whole = _counts(once, least)
    odds = log_odds(names, counts.sum(1), whole.sum(0), prior)
    crossed = [log_odds(names, np.delete(counts, f, 1).sum(1), np.delete(whole, f, 0).sum(0), prior) for f in range(FOLDS)]
    sent = rows.sparkSession.sparkContext.broadcast(crossed)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text, fold in zip(batch["text"], batch["fold"], strict=True):
                own = words(text)
                seen[0.0] += len(own)
                for w, n in Counter(own).items():
                    s = _score(sent.value[fold], w)
                    if s:
                        seen[s] += n
        yield pd.DataFrame({"score": np.array(list(seen), float), "n": np.array(list(seen.values()), np.int64)})

    seen = {r.score: r.n for r in once.where("label = 0").mapInPandas(hits, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    n_words = seen.pop(0.0, 0)
    model = Model(odds)
    if odds and n_words:
        top = max(odds.values())
        seen[top] = seen.get(top, 0) + 1  # what was not seen in so many words may come in the next
        model.cost, model.decay = background(seen, n_words + 1, cost)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_segments(Model(sent.value[fold], model.cost), text) for text, fold in zip(batch["text"], batch["fold"], strict=True)]
            if model.spread:
                yield pd.DataFrame({"x": [surprise(model, n, x) for n, x in found], "label": batch["label"], "weight": batch["weight"]})
            else:
                yield pd.DataFrame({"n": [n for n, _ in found], "most": [max((s for _, _, s in x), default=0.0) for _, x in found]}).astype({"n": "int64", "most": float})

    if model.decay:
        # the likeliest spread, given the decay, for the maxima seen; texts without a segment say that theirs was 0 or less
        seen_of = once.where("label = 0").mapInPandas(scan, "n long, most double").agg(F.sum((F.col("most") > 0).cast("int")).alias("some"), F.sum(F.col("n") * F.exp(-model.decay * F.col("most"))).alias("mass")).first()
        model.spread = (seen_of.some + 1) / (seen_of.mass + 1)
        got = sorted((r.x, r.label, r.weight) for r in once.mapInPandas(scan, "x double, label int, weight double").collect())
    else:
        got = [(0.0, r.label, r.weight) for r in once.groupBy("label").agg(F.sum("weight").alias("weight")).orderBy("label").collect()]
    sent.unpersist()
    if got:
        x, y, of = (np.array(v, float) for v in zip(*got, strict=True))
        of = of * len(of) / of.sum()
        x, w = np.stack([np.sqrt(x), np.ones_like(x)], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (of * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (of * (p - y)) + 0.01 * w)
        model.slope, model.offset = float(max(w[0], 0.0)), float(w[1])
    return model


def _score(odds: dict[str, float], word: str) -> float | None:
    return max((s for u in units(word) if (s := odds.get(u)) is not None), default=None)


def _segments(model: Model, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """How many words a text has, and its maximal-scoring segments."""
    own = words(text)
    known = {w: s - model.cost for w in set(own) if (s := _score(model.odds, w)) is not None and s > model.cost}
    hits = [(i, known[w]) for i, w in enumerate(own) if w in known] if known else []
    return len(own), segments([i for i, _ in hits], [s for _, s in hits], model.cost)


def passages(docs: DataFrame, model: Model, significant: float = 3.0) -> DataFrame:
    """doc_id, score, and the significant passages of every row, from its text alone (null: empty).

    A passage is (first, end, score, surprise): words from the first to before the end, counted over the text's
    runs of letters. All maximal segments whose own surprise reaches ``significant`` are returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            scores, lists = [], []
            for text in batch["text"]:
                n, found = _segments(m, text)
                lists.append([{"first": a, "end": b, "score": s, "surprise": u} for a, b, s in found if (u := surprise(m, n, [(a, b, s)])) >= significant])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * math.sqrt(surprise(m, n, found)) + m.offset)))))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.array(scores, float), "passages": lists})

    schema = "doc_id long, score double, passages array<struct<first:int,end:int,score:double,surprise:double>>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def classified(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, n_passages, for ``labels`` (doc_id, toxic).

    Labels are learned from at most about ``sample`` rows of each label whose crc32(doc_id) mod 4 is not 2, weighted
    back to the labels' own shares. A null or empty text has no segment and the lowest score; a text of any length
    is scanned whole, in time and memory linear in its words. Units of equal score are the same to a word, and equal
    texts have equal scores. Repeated rows come back each; a null doc_id is not held out; other columns are left
    aside; an empty table gives an empty table.
    """
    out = remainder_is(F.col("doc_id"), 4, 2)
    model = train(sampled(docs, labels, "toxic", out, sample))
    return passages(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
