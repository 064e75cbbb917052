"""A quality classifier by nearest-neighbour voting among latent-semantic vectors.

A text's terms are the shapes of its words and of neighbouring words, how long its words are, and how much of it
repeats. Terms are weighted by how rare they are, and a truncated singular value decomposition of the labelled
sample gives the latent space. The labelled vectors (a bounded number) go to every executor, which takes the exact
cosine of each document with all of them, a block at a time; the nearest vote, weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import groups_of, remainder_is
from .labelled import sampled

#: Slots for hashed shapes and for hashed pairs of shapes; then word lengths, repetition and size.
SHAPES, PAIRS, LENGTHS, BUCKETS = 512, 1024, 24, 12
TERMS = SHAPES + PAIRS + LENGTHS + 4 * BUCKETS
_LOWERS, _UPPERS, _NUMBERS, _RUNS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Runs of small letters as a, of capitals as A, of digits as 9, of any other sign as one."""
    return _RUNS.sub(r"\1", _NUMBERS.sub("9", _LOWERS.sub("a", _UPPERS.sub("A", word))))


def vectors(texts: list[str], known: dict[str, tuple[int, int]]) -> np.ndarray:
    """Term counts, as shares of the text's words, damped. ``known`` remembers each word's shape and length."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = text.split()
        n = max(1, len(words))
        for w in set(words):
            if w not in known:
                known[w] = (zlib.crc32(shape(w).encode()), min(len(w), LENGTHS) - 1)
        pairs = [known[w] for w in words]
        shapes = np.array([a for a, _ in pairs], np.uint64)
        row[:SHAPES] = np.bincount((shapes % SHAPES).astype(np.int64), minlength=SHAPES)
        two = (shapes[1:] * np.uint64(31) + shapes[:-1]) >> np.uint64(3)
        row[SHAPES : SHAPES + PAIRS] = np.bincount((two % PAIRS).astype(np.int64), minlength=PAIRS)
        at = SHAPES + PAIRS
        row[at : at + LENGTHS] = np.bincount(np.array([b for _, b in pairs], np.int64), minlength=LENGTHS)
        row[: at + LENGTHS] = np.log1p(row[: at + LENGTHS] * (100 / n))
        lines = [x for x in text.split("\n") if x.strip()]
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        for k, share in enumerate((again / n, len(set(words)) / n, len(set(lines)) / max(1, len(lines)), np.log2(1 + len(words)) / 16)):
            row[at + LENGTHS + k * BUCKETS + min(BUCKETS - 1, int(share * BUCKETS))] = 4
    return out


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    weight: np.ndarray  # of each term
    space: np.ndarray  # terms x dimensions
    points: np.ndarray  # the labelled vectors, of length 1
    labels: np.ndarray
    share: float  # of label 1 in the sample


def train(rows: DataFrame, dimensions: int = 48) -> Model:
    """Fit on ``rows`` (text, label), whose number the caller bounds. One task gathers their sparse vectors and decomposes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            for a, b in groups_of(batch["text"].tolist(), 1 << 22):
                found = vectors(batch["text"].iloc[a:b].tolist(), known)
                yield pd.DataFrame({"terms": [np.flatnonzero(v).astype("<i2").tobytes() for v in found], "numbers": [v[v != 0].astype("<f4").tobytes() for v in found], "label": batch["label"].iloc[a:b].to_numpy()})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((r for batch in batches for r in batch.itertuples(index=False)), key=lambda r: (r.label, bytes(r.terms), bytes(r.numbers)))
        x = np.zeros((len(got), TERMS), np.float32)
        for row, r in zip(x, got, strict=True):
            row[np.frombuffer(r.terms, "<i2")] = np.frombuffer(r.numbers, "<f4")
        labels = np.array([r.label for r in got], np.float32)
        weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        x = _norm(x * weight)
        width = max(1, min(dimensions, len(x)))
        # a randomised range finder with two power steps, then the exact decomposition in that range
        basis = x.T @ np.random.default_rng(7).standard_normal((len(x), width + 16)).astype(np.float32)
        for _ in range(2):
            basis = x.T @ (x @ np.linalg.qr(basis)[0])
        basis = np.linalg.qr(basis)[0]
        space = basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :width] if len(x) else np.zeros((TERMS, 1), np.float32)
        parts = {"weight": weight, "space": space, "points": _norm(x @ space), "labels": labels}
        yield pd.DataFrame({"name": list(parts), "width": [v.shape[-1] for v in parts.values()], "numbers": [np.ascontiguousarray(v, "<f4").tobytes() for v in parts.values()]})

    # the decomposition runs in one task, on as many threads as Spark gives it; the sample is bounded
    sample = rows.mapInPandas(run, "terms binary, numbers binary, label int").repartition(1)
    found = {r.name: (r.width, np.frombuffer(r.numbers, "<f4")) for r in sample.mapInPandas(fit, "name string, width int, numbers binary").collect()}
    if not found:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    labels = found["labels"][1]
    space, points = (found[k][1].reshape(-1, found[k][0]) for k in ("space", "points"))
    return Model(found["weight"][1], space, points, labels, float(labels.mean()) if len(labels) else 0.5)


def votes(model: Model, found: np.ndarray, neighbours: int, sharpness: float, block: int = 512) -> np.ndarray:
    """The share of label 1 among the nearest, weighted by the power ``sharpness`` of their cosines.

    The nearest are all that are as near as the last of ``neighbours``, so equal ones count alike, in whatever order
    they come. Where none has a cosine above 0, the share of label 1 in the sample.
    """
    out = np.full(len(found), model.share)
    k = min(neighbours, len(model.points))
    if not k:
        return out
    for a in range(0, len(found), block):
        near = _norm((found[a : a + block] * model.weight) @ model.space) @ model.points.T
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        i, j = np.nonzero(near >= np.maximum(last, 0))
        w = near[i, j].astype(np.float64) ** sharpness
        total, ones = np.bincount(i, w, len(near)), np.bincount(i, w * model.labels[j], len(near))
        out[a : a + block] = np.where(total > 1e-12, ones / np.maximum(total, 1e-12), model.share)
    return np.clip(out, 0, 1)


def scored(docs: DataFrame, model: Model, neighbours: int = 15, sharpness: float = 8.0) -> DataFrame:
    """doc_id and score of every row, from its text alone (null: empty)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            texts, scores = batch["text"].tolist(), []
            for a, b in groups_of(texts, 1 << 22):
                scores.append(votes(sent.value, vectors(texts[a:b], known), neighbours, sharpness))
                if len(known) > 300_000:
                    known.clear()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(scores) if scores else np.empty(0)})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, sample: int = 1500, neighbours: int = 15) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, for ``labels`` (doc_id, quality).

    Labels are learned from at most about ``sample`` rows of each label whose crc32(doc_id) mod 3 is not 1. Null
    and empty texts are scored by their (empty) terms; a text of any length is read whole. Texts of equal terms, and so
    of equal shapes, have equal scores. Without any label every score is 0.5. Repeated rows come
    back each; a null doc_id is not held out; other columns are left aside; an empty table gives an empty table.
    """
    out = remainder_is(F.col("doc_id"), 3, 1)
    model = train(sampled(docs, labels, "quality", out, sample))
    return scored(docs, model, neighbours).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
