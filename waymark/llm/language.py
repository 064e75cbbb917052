"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a public vocabulary. For each language, every piece has a probability, learned by
expectation maximisation over all segmentations of the training words. A word's probability is the sum over all
its segmentations (the forward algorithm), a text's the product over its words, and the prediction is the language
under which the text is likeliest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import give_back, groups_of, remainder_is, text_hash

#: The factor of the rolling hash; the least probability of a character.
FACTOR, LEAST = np.uint64(0x9E3779B97F4A7C15), 1e-7
#: Words of more letters are learned from in stretches of half as many, and scored one by one. Languages at most.
LONG, LANGUAGES = 64, 2000
MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lowered."""
    found = _WORD.findall(text.lower())
    if found and not "".join(found).isalpha():  # numerals that are no decimal digits, such as fractions
        return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


def vocabulary(path: str) -> list[str]:
    """The lowered pieces of letters of a sentencepiece model file, with their word-start marks."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p for i in range(library.get_piece_size()) if (p := library.id_to_piece(i).lower()) and (p == MARK or p.removeprefix(MARK).isalpha())}
    return sorted(pieces | {MARK})


class Pieces:
    """Finds pieces in many words at once, by rolling hashes of their code points."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        self.numbers = {p: i for i, p in enumerate(pieces, 1)}
        keys = np.array([int(self._hash(p)) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.arange(1, self.n + 1, dtype=np.int32)[order]
        self.bits = np.uint64(64 - max(4, int(self.n * 16 - 1).bit_length()))
        slot = (self.keys * FACTOR) >> self.bits
        self.table = np.zeros(1 << int(np.uint64(64) - self.bits), np.int32)  # slot -> place in keys + 1, for the slot's first key
        self.more: dict[int, list[int]] = {}
        for place, s in enumerate(slot.tolist()):
            if self.table[s]:
                self.more.setdefault(s, []).append(place)
            else:
                self.table[s] = place + 1
        self.crowded = np.zeros(len(self.table), bool)
        self.crowded[list(self.more)] = True

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * FACTOR + np.uint64(ord(c))
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The id (from 1) of each hash's piece; 0 where there is none."""
        slot = ((hashes * FACTOR) >> self.bits).astype(np.int64)
        place = self.table[slot]
        out = np.where((place > 0) & (self.keys[place - 1] == hashes), self.ids[place - 1], 0)
        for i in np.flatnonzero(self.crowded[slot] & (out == 0)):
            for p in self.more[int(slot[i])]:
                if self.keys[p] == hashes[i]:
                    out[i] = self.ids[p]
        return out


def _blocks(unique: list[str], cells: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of about equal length: their places in ``unique`` and their code points, marked and padded with 0."""
    sizes = np.array([len(w) + 1 for w in unique])
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        stop, size = start, sizes[order[start]]
        most = max(16, size + size // 4)
        while stop < len(order) and sizes[order[stop]] <= most and (stop - start + 1) * sizes[order[stop]] <= max(cells, most):
            stop += 1
        stop = max(stop, start + 1)
        part = order[start:stop]
        width = int(sizes[part].max())
        joined = "".join((MARK + unique[i]).ljust(width, "\0") for i in part)
        yield part, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(part), width).astype(np.uint64)
        start = stop


def _found(pieces: Pieces, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, length, rows, ids) of all pieces in the words ``codes``; a character without a piece has id 0."""
    n, width = codes.shape
    prefix = np.zeros((n, width + 1), np.uint64)
    for i in range(width):
        prefix[:, i + 1] = prefix[:, i] * FACTOR + codes[:, i]
    power = np.cumprod(np.append(np.uint64(1), np.full(pieces.longest, FACTOR)))
    for i in range(1, width + 1):
        here = np.flatnonzero(codes[:, i - 1])
        for k in range(1, min(i, pieces.longest) + 1):
            ids = pieces.find(prefix[here, i] - prefix[here, i - k] * power[k])
            some = np.arange(len(here)) if k == 1 else np.flatnonzero(ids)
            if len(some):
                yield i, k, here[some], ids[some]


def _log_likelihood(pieces: Pieces, chance: np.ndarray, word: str) -> np.ndarray:
    """As ``log_likelihoods`` for one word, in time linear in its letters and room for its last few alone."""
    word, get = MARK + word, pieces.numbers.get
    last, scale = [np.ones(chance.shape[1])], np.zeros(chance.shape[1])
    for i in range(1, len(word) + 1):
        now = last[-1] * chance[get(word[i - 1], 0)]
        for k in range(2, len(last) + 1):
            if n := get(word[i - k : i]):
                now = now + last[-k] * chance[n]
        last = [*last, now][-pieces.longest :]
        if i % 16 == 0:
            top = np.maximum(np.max(last, 0), 1e-300)
            last, scale = [x / top for x in last], scale + np.log(top)
    return np.log(np.maximum(last[-1], 1e-300)) + scale


def log_likelihoods(pieces: Pieces, chance: np.ndarray, unique: list[str]) -> np.ndarray:
    """For each word and language: the log of the sum over all segmentations. ``chance``: (pieces + 1, languages)."""
    out = np.zeros((len(unique), chance.shape[1]))
    short = [i for i, w in enumerate(unique) if len(w) <= LONG]
    for i in set(range(len(unique))) - set(short):
        out[i] = _log_likelihood(pieces, chance, unique[i])
    # a block's sums are (width, words, languages) doubles: 32 MB at most, however many languages there are
    for part, codes in _blocks([unique[i] for i in short], max(LONG * 16, 4_000_000 // max(4, chance.shape[1]))):
        n, width = codes.shape
        alpha = np.zeros((width + 1, n, chance.shape[1]))
        alpha[0], scale, done = 1, np.zeros((n, chance.shape[1])), 0
        lengths = (codes > 0).sum(1)

        def scaled(i: int) -> None:  # keeps the last columns from vanishing in long words
            low = max(0, i - pieces.longest)
            top = np.maximum(alpha[low : i + 1].max(0), 1e-300)
            alpha[low : i + 1] /= top
            scale[lengths >= i] += np.log(top)[lengths >= i]
            alpha[low : i + 1, lengths < i] *= top[lengths < i]

        for i, k, rows, ids in _found(pieces, codes):
            if i != done and done and done % 16 == 0:
                scaled(done)
            done = i
            alpha[i, rows] += alpha[i - k, rows] * chance[ids]
        out[np.array(short)[part]] = np.log(np.maximum(alpha[lengths, np.arange(n)], 1e-300)) + scale
    return out


def stretches(word: str) -> list[str]:
    """What is learned from a word: itself, or where it is long, parts of half of ``LONG`` letters."""
    return [word] if len(word) <= LONG // 2 else [word[a : a + LONG // 2] for a in range(0, len(word), LONG // 2)]


def learn(pieces: Pieces, counts: Counter, rounds: int = 3) -> np.ndarray:
    """Piece probabilities (id 0: a character without a piece) of one language from the counts of its words."""
    unique = list(counts)
    weight = np.array([counts[w] for w in unique], float)
    chance = np.full(pieces.n + 1, 1.0 / (pieces.n + 1))
    for _ in range(rounds):
        expected = np.zeros(pieces.n + 1)
        for part, codes in _blocks(unique):
            n, width = codes.shape
            steps = list(_found(pieces, codes))
            lengths = (codes > 0).sum(1)
            alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            alpha[0], beta[lengths, np.arange(n)] = 1, 1
            for i, k, rows, ids in steps:
                alpha[i, rows] += alpha[i - k, rows] * chance[ids]
            for i, k, rows, ids in sorted(steps, key=lambda s: -s[0]):
                beta[i - k, rows] += chance[ids] * beta[i, rows]
            total = np.maximum(alpha[lengths, np.arange(n)], 1e-300)
            for i, k, rows, ids in steps:
                share = alpha[i - k, rows] * chance[ids] * beta[i, rows] / total[rows] * weight[part][rows]
                expected += np.bincount(ids, share, minlength=pieces.n + 1)
        chance = np.maximum((expected + 0.01) / (expected.sum() + 0.01 * len(expected)), LEAST / 100)
    chance[0] = LEAST
    return chance


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    chance: np.ndarray


def train(labelled: DataFrame, vocabulary_path: str, sample: int = 500, rounds: int = 3) -> Model:
    """Fit on at most about ``sample`` documents of each language (text, lang; both not null), chosen by a hash of the text.

    The bound holds the driver's share: the words of that many documents. Every language of the rows is learned; more
    than ``LANGUAGES`` different ones are refused, as the model grows with them.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different languages")
    pieces = vocabulary(vocabulary_path)
    if not sizes:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])
    counts: dict[str, Counter] = {k: Counter() for k in sizes}
    for r in chosen.toLocalIterator():
        counts[r.lang].update(x for w in words(r.text) for x in stretches(w))
    finder, languages = Pieces(pieces), sorted(sizes)
    return Model(pieces, languages, np.stack([learn(finder, counts[k], rounds) for k in languages], 1))


@lru_cache(maxsize=4)
def _finder(pieces: tuple[str, ...]) -> Pieces:
    """The worker's own finder of a vocabulary."""
    return Pieces(list(pieces))


def _predictions(m: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    finder, names, scores = _finder(tuple(m.pieces)), [], []
    for a, b in groups_of(texts, 1 << 20):
        split = [words(x) for x in texts[a:b]]
        number = {w: i for i, w in enumerate(set().union(*split))}
        each = log_likelihoods(finder, m.chance, list(number))
        for own in split:
            if not own or not m.languages:
                names.append("und")
                scores.append(0.0)
                continue
            odds = each[np.fromiter(map(number.__getitem__, own), np.int64, len(own))].sum(0)
            best = int(odds.argmax())
            names.append(m.languages[best])
            scores.append(float(1 / np.exp(odds - odds[best]).sum()))
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone.

    ``und`` and 0 for a null text, one without a letter, or a model that has learned no language. The score is
    the posterior of the predicted language. Equal likelihoods go to the language first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = _predictions(sent.value, batch["text"].tolist())
            yield batch.drop(columns="text").assign(lang_pred=names, score=scores)

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInPandas(run, "doc_id long, lang_pred string, score double")


def unrecognised(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id and text_hash of the rows of ``docs`` whose predicted language has a score below ``least``.

    So has a row without a letter. A model that has learned no language finds only rows without a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            if sent.value.languages:
                keep = [n != "und" and s >= least for n, s in zip(*_predictions(sent.value, texts), strict=True)]
            else:
                keep = [bool(words(x)) for x in texts]
            yield batch.loc[~np.array(keep, bool), ["doc_id", "text_hash"]]
        give_back()

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    return own.mapInPandas(run, "doc_id long, text_hash long")


def identified(docs: DataFrame, vocabulary_path: str, sample: int = 500, rounds: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from the rows whose crc32(doc_id) mod 3 is not 1 and predicts all. Repeated rows come back each; a null
    doc_id is not held out; other columns are left aside; an empty table gives an empty table. A text of any length
    is scored whole, in time linear in its letters, also where they are one unbroken word.
    """
    out = remainder_is(F.col("doc_id"), 3, 1)
    model = train(docs.where(~out), vocabulary_path, sample, rounds)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
