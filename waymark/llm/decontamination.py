"""Benchmark decontamination with a positional inverted index over the corpus.

The index is sharded by document, as search engines do: a row holds the postings of a block of documents, so that
building and searching it moves no posting between machines, and no term's list is ever in one place. Test
phrases are looked up from their rarest term: its postings, less its offset in the phrase, are where the phrase
can start, and the lists of the other terms, less their offsets, are intersected with that, rarest first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import give_back, materialise

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: Words between documents of a block, so that no phrase or nearness reaches across; documents and words in a block.
GAP, BLOCK_DOCS, BLOCK_WORDS = 1024, 4096, 500_000
#: Test words that are sent to every executor at once; a larger test set is sent in parts.
TEST_WINDOWS = 500_000


def words(text: str) -> list[str]:
    """Runs of 0-9, a-z and characters from U+0080 on, after A-Z are lowered."""
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


@dataclass
class Phrases:
    """Test phrases as term numbers, for one pass over the index."""

    terms: dict[str, int]
    phrases: list[tuple[int, ...]]
    items: list[list[str]]  # of each phrase: the items that hold it

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int) -> Phrases:
        terms: dict[str, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            own = [terms.setdefault(w, len(terms)) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(item)
        return Phrases(terms, list(found), [sorted(x) for x in found.values()])


def _block(ids: list, hashes: list[int], lists: list, terms: dict[str, int] | None) -> dict:
    """The postings of a block of documents, given as term numbers, or as words where there are no ``terms``."""
    own = {} if terms is not None else {w: k for k, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
    sizes = np.array([len(x) for x in lists], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64)
    number = np.concatenate(lists) if terms is not None else np.array([own[w] for x in lists for w in x], np.int32)
    shift = np.repeat(at - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes)
    held = np.flatnonzero(number >= 0)
    number, place = number[held], held + shift[held]
    order = np.argsort(number, kind="stable")
    number, place = number[order], place[order].astype("<i4")
    term, starts = np.unique(number, return_index=True)
    return {"vocabulary": list(own), "doc_ids": ids, "hashes": np.array(hashes, "<i8").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "term": term.astype("<i4").tobytes(), "starts": np.append(starts, len(number)).astype("<i4").tobytes(), "places": place.tobytes()}


def _blocks(rows: Iterator[tuple], terms: dict[str, int] | None) -> Iterator[dict]:
    """Blocks of (doc_id, text, text_hash). With ``terms`` a text is held as its term numbers, four bytes a word, not as words."""
    ids, hashes, lists, held = [], [], [], 0
    for i, text, text_hash in rows:
        own = words(text)
        if terms is not None:
            own = np.fromiter((terms.get(w, -1) for w in own), np.int32, len(own))
        if lists and (held + len(own) > BLOCK_WORDS or len(lists) >= BLOCK_DOCS):
            yield _block(ids, hashes, lists, terms)
            ids, hashes, lists, held = [], [], [], 0
        ids.append(i if isinstance(i, str) else None)
        hashes.append(text_hash)
        lists.append(own)
        held += len(own)
    if lists:
        yield _block(ids, hashes, lists, terms)


def build_index(docs: DataFrame, terms: dict[str, int] | None) -> DataFrame:
    """The postings of ``terms`` in ``docs`` (None: of every word): a row for each block of documents.

    block (a number of its own), vocabulary (where all words are indexed: those of the block, which its term
    numbers stand for), doc_ids, sizes (words of each document), term (those present, ascending), starts (where each term's postings
    start) and places (word positions in the block, ascending by term). Documents lie one after another with a
    gap between. Words that no test phrase has are counted but not stored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["doc_id"], batch["text"], batch["text_hash"]))
        for block in _blocks(rows, sent.value):
            yield pd.DataFrame([block])
        give_back()

    # ids travel as text: a column of numbers and nulls would become one of floats in Python
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return own.mapInPandas(run, "vocabulary array<string>, doc_ids array<string>, hashes binary, sizes binary, term binary, starts binary, places binary").withColumn("block", F.monotonically_increasing_id())


def _numbers(term: bytes, vocabulary: list[str], terms: dict[str, int]) -> np.ndarray:
    """A block's term numbers as those of ``terms``; -1 for a word that it lacks."""
    term = np.frombuffer(term, "<i4")
    return np.array([terms.get(w, -1) for w in vocabulary], np.int32)[term] if len(vocabulary) else term


def frequencies(index: DataFrame, terms: dict[str, int]) -> dict[int, int]:
    """Postings of each of ``terms`` over the whole index; a row for each at most reaches the driver."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for term, starts, vocabulary in zip(batch["term"], batch["starts"], batch["vocabulary"]):
                found = pd.DataFrame({"term": _numbers(term, vocabulary, sent.value), "n": np.diff(np.frombuffer(starts, "<i4")).astype(np.int64)})
                yield found[found["term"] >= 0]

    found = {r.term: r.n for r in index.select("term", "starts", "vocabulary").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    sent.unpersist()
    return found


def _near(list_: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``wanted`` have a posting within ``slop`` words."""
    i = np.searchsorted(list_, wanted - slop)
    there = i < len(list_)
    there[there] = list_[i[there]] <= wanted[there] + slop
    return there


def _orders(index: DataFrame, tests: Phrases) -> tuple[list[list[int]], dict[int, list[int]]]:
    """The places of each phrase, rarest term first, and the phrases by their rarest term."""
    often = frequencies(index, tests.terms)
    order = [sorted(range(len(p)), key=lambda i: (often.get(p[i], 0), i)) for p in tests.phrases]  # noqa: B023
    by_rarest: dict[int, list[int]] = {}
    for k, (p, o) in enumerate(zip(tests.phrases, order, strict=True)):
        by_rarest.setdefault(p[o[0]], []).append(k)
    return order, by_rarest


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes.astype(np.int64) + GAP)[:-1]]).astype(np.int64)


def _found(lists: dict[int, np.ndarray], sizes: np.ndarray, phrases: list, orders: list, rarest: dict, items: list, slop: int) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of a block are hit, and the items found in each of its documents."""
    at = _starts(sizes)
    change = np.zeros(int(at[-1]) + int(sizes[-1]) + 2, np.int32)
    hits: dict[int, set[str]] = {}
    for t in lists.keys() & rarest.keys():
        for k in rarest[t]:
            phrase, o = phrases[k], orders[k]
            if any(x not in lists for x in phrase):
                continue
            where = lists[t].astype(np.int64) - o[0]
            for j in o[1:]:
                where = where[_near(lists[phrase[j]], where + j, slop)]
                if not len(where):
                    break
            if len(where):
                doc = np.searchsorted(at, np.maximum(where, 0), side="right") - 1
                low, high = np.maximum(where, at[doc]), np.minimum(where + len(phrase), at[doc] + sizes[doc])
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
                for d in np.unique(doc).tolist():
                    hits.setdefault(d, set()).update(items[k])
    return np.cumsum(change) > 0, hits


def _lists(row, terms: dict[str, int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    number, (sizes, starts, places) = _numbers(row.term, row.vocabulary, terms), (np.frombuffer(x, "<i4") for x in (row.sizes, row.starts, row.places))
    return {t: places[a:b] for t, a, b in zip(number.tolist(), starts.tolist(), starts[1:].tolist()) if t >= 0}, sizes


def search(index: DataFrame, tests: Phrases, slop: int = 0) -> DataFrame:
    """Per document of the index: doc_id, text_hash, n_words, n_hit, items (sorted).

    A phrase occurs where all its terms stand at their offsets, or, with ``slop``, where each stands within that
    many words of its offset from the rarest (a proximity match; ``slop`` must stay below half the gap). A word
    inside any occurrence is hit; with ``slop``, from the phrase's start for its length.
    """
    sent = index.sparkSession.sparkContext.broadcast((tests.terms, tests.phrases, *_orders(index, tests), tests.items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, *rest = sent.value
        for batch in batches:
            for r in batch.itertuples(index=False):
                lists, sizes = _lists(r, terms)
                hit, hits = _found(lists, sizes, *rest, slop)
                at, hit = _starts(sizes), np.concatenate([[0], np.cumsum(hit)])
                n_hit = hit[at + sizes] - hit[at]
                yield pd.DataFrame({"doc_id": list(r.doc_ids), "text_hash": np.frombuffer(r.hashes, "<i8"), "n_words": sizes.astype(np.int64), "n_hit": n_hit.astype(np.int64), "items": [sorted(hits.get(d, ())) for d in range(len(sizes))]})

    found = index.drop("block").mapInPandas(run, "doc_id string, text_hash long, n_words long, n_hit long, items array<string>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def parts(benchmark: DataFrame, window: int, most: int, n_parts: int) -> Iterator[list[tuple[str, str]]]:
    """The test set as lists of (item, text) of about ``most`` words each; one of them is on the driver at a time.

    A longer item is dealt to several texts that overlap by a window less a word, so that none of its windows is lost.
    """
    step = max(1, most // 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                own = words(text)
                cut = [own[a : a + step + window - 1] for a in range(0, max(1, len(own) - window + 1) if own else 0, step)]
                yield pd.DataFrame({"item": [item] * len(cut), "text": [" ".join(x) for x in cut], "n": [len(x) for x in cut]}, columns=["item", "text", "n"]).astype({"item": object, "text": object, "n": "int64"})

    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    cut = materialise(own.mapInPandas(run, "item string, text string, n long").repartition(n_parts), "test_parts")
    held, rows = 0, []
    for r in cut.toLocalIterator():
        if rows and held + r.n > most:
            yield rows
            held, rows = 0, []
        held += r.n
        rows.append((r.item, r.text))
    if rows:
        yield rows


def search_parts(index: DataFrame, tests: Iterator[Phrases], slop: int = 0) -> DataFrame:
    """As ``search`` for a test set in parts, over an index of every word.

    Each part leaves the stretches hit and the items found of the documents that it hits; these are joined at the end.
    """
    spark, hits = index.sparkSession, None

    def one(part: Phrases) -> DataFrame:
        sent = spark.sparkContext.broadcast((part.terms, part.phrases, *_orders(index, part), part.items))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            terms, *rest = sent.value
            for batch in batches:
                for r in batch.itertuples(index=False):
                    lists, sizes = _lists(r, terms)
                    hit, found = _found(lists, sizes, *rest, slop)
                    rows = []
                    for d, a in ((d, int(_starts(sizes)[d])) for d in sorted(found)):
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a : a + sizes[d]].astype(np.int8), [0]])))
                        rows.append((r.block, d, edges[::2].tolist(), edges[1::2].tolist(), sorted(found[d])))
                    yield pd.DataFrame(rows, columns=["block", "doc", "low", "high", "items"])

        out = materialise(index.mapInPandas(run, "block long, doc int, low array<int>, high array<int>, items array<string>"), "hits")
        sent.unpersist()
        return out

    for part in tests:
        now = one(part)
        hits = now if hits is None else hits.unionByName(now)

    def joined(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        low, high = np.concatenate(batch["low"].tolist()).astype(np.int64), np.concatenate(batch["high"].tolist()).astype(np.int64)
        change = np.zeros(int(high.max(initial=0)) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
        return pd.DataFrame({"block": [key[0]], "doc": [key[1]], "n_hit": [int((np.cumsum(change) > 0).sum())], "items": [sorted(set().union(*batch["items"]))]})

    def all_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, "<i4").astype(np.int64)
                yield pd.DataFrame({"block": r.block, "doc": np.arange(len(sizes)), "doc_id": list(r.doc_ids), "text_hash": np.frombuffer(r.hashes, "<i8"), "n_words": sizes})

    docs = index.select("block", "doc_ids", "hashes", "sizes").mapInPandas(all_docs, "block long, doc int, doc_id string, text_hash long, n_words long").withColumn("doc_id", F.col("doc_id").cast("long"))
    if hits is None:
        return docs.select("doc_id", "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = hits.groupBy("block", "doc").applyInPandas(joined, "block long, doc int, n_hit long, items array<string>")
    return docs.join(found, ["block", "doc"], "left").select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, keep_hash: bool = False, test_words: int = TEST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (ids, as strings, of the items found there), and with
    ``keep_hash`` text_hash (xxhash64 of the text).

    ``benchmark`` has item_id and text; its windows are what each executor holds, so a test set of over
    ``test_words`` words is searched in parts of about that size, over one index of every word. A null text has no words; items
    without words or without an id are never found; repeated items count once. Repeated documents come back
    each, null ids included; other columns are left aside. An empty table on either side is no error.
    """
    size = benchmark.where("item_id is not null").agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    if size > test_words:
        index = materialise(build_index(docs, None), "postings", batch=1000)
        found = search_parts(index, (Phrases.of(x, window) for x in parts(benchmark, window, test_words, -(-size // test_words))), slop)
        return found if keep_hash else found.drop("text_hash")
    rows = [(str(r.item_id), r.text) for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").collect()]
    tests = Phrases.of(rows, window)
    found = search(materialise(build_index(docs, tests.terms), "postings", batch=1000), tests, slop)
    return found if keep_hash else found.drop("text_hash")


def digest(found: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated from ``items``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM i),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, s.n, ws, unnest(range(1, len(ws) - s.n + 2)) AS p FROM d, sizes s WHERE len(ws) >= s.n),
hit AS (SELECT dp.doc_id, dp.p, dp.n, win.item_id FROM dp JOIN win ON win.n = dp.n AND win.w = array_to_string(dp.ws[dp.p:dp.p + dp.n - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
