"""How the sources of a language differ in the words they use.

Every source is compared with every other of its language over the whole vocabulary, but most words are in neither
or in one of two sources. So a distance is put together by inclusion and exclusion over the sources' supports: words
of one side are priced from that side's histogram of counts (how many words it has so often), words in neither by a
constant, and words in both are set right by a join of posting lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SMALL, materialise

#: Only letters A to Z and characters beyond ASCII make a term.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LETTERS = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
#: Characters that are searched at once, and different terms that a task holds before it hands them on.
_SLICE, _HELD = 1 << 20, 500_000
#: A probability is in so many parts, after ``SMOOTH`` more of each term. Fixed values of the contract.
PARTS, SMOOTH = 1_000_000_000, 5
#: Parts among which the sources of a language are dealt, so that a language of very many is no single task.
_SALT = 16


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: how often each term occurs in each group, and in how many of its rows.

    Null text, lang and source are read as empty. Each group also has a row with an empty term and no count, so that one without
    terms is there. Tasks add up what they read before anything moves; whole texts are searched, a slice at a time.
    """
    lower = str.maketrans(*_LETTERS)

    def found(text: str) -> Iterator[list[str]]:
        find, cut, at = re.compile(TERM).findall, re.compile("[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]"), 0
        while at < len(text):
            end = len(text)
            if at + _SLICE < end:
                stop = cut.search(text, at + _SLICE)
                end = stop.end() if stop else end
            yield find(text[at:end].translate(lower))
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], Counter] = {}
        rows: dict[tuple[str, str], Counter] = {}

        def out() -> pd.DataFrame:
            frames = [pd.DataFrame({"lang": k[0], "source": k[1], "term": list(v), "count": list(v.values()), "docs": [rows[k][t] for t in v]}) for k, v in total.items()]
            total.clear()
            rows.clear()
            return pd.concat(frames)

        for batch in batches:
            for text, lang, source in zip(batch["text"], batch["lang"], batch["source"], strict=True):
                own, in_rows = total.setdefault((lang, source), Counter({"": 0})), rows.setdefault((lang, source), Counter())
                if len(text) <= _SLICE:
                    words = next(found(text), [])
                    own.update(words)
                    in_rows.update(set(words))
                else:
                    seen: set[str] = set()
                    for words in found(text):
                        own.update(words)
                        seen.update(words)
                    in_rows.update(seen)
            if sum(map(len, total.values())) > _HELD:
                yield out()
        if total:
            yield out()

    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    each = docs.select(empty("text"), empty("lang"), empty("source")).mapInPandas(run, "lang string, source string, term string, count long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, for every executor where it has ``SMALL`` rows at most."""
    return F.broadcast(table) if table.count() <= SMALL else table


def _share(count: str, total: str, terms: str) -> Column:
    """p of a count in a group of ``total`` over a vocabulary of ``terms`` (names of columns); exact, null without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({PARTS} AS DECIMAL(12, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))) DIV CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0)) END")


def priced(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, term, source, count, p, q, none) of kept terms, and groups (lang, source, total, support, terms, none).

    p is the group's share of the term, q its language's, and none the share of a term that the group does not have.
    """
    words = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang")).where(F.col("docs") >= least_docs).drop("docs")
    words = materialise(words, "words")
    posts = materialise(counts.join(words, ["lang", "term"]).select("lang", "source", "term", "count", "in_lang"), "posts")
    own = posts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("support"))
    langs = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *map(zero, ("total", "support", "terms", "lang_total"))).withColumn("none", F.coalesce(_share("0L", "total", "terms"), F.lit(0)))
    groups = materialise(groups, "groups")
    out = posts.join(_small(groups), ["lang", "source"]).select("lang", "term", "source", "count", _share("count", "total", "terms").alias("p"), _share("in_lang", "lang_total", "terms").alias("q"), "none")
    return materialise(out, "priced"), groups


def one_sided(posts: DataFrame, groups: DataFrame, block: int = 1024) -> DataFrame:
    """lang, a, b (a before b), value: what every two sources of a language differ by, as if they shared no term.

    A source's histogram (its shares and how many terms have each, no more than the square root of twice its words)
    meets the other sources in blocks; a binary search in its running sums prices it against each of them.
    """
    bars = posts.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("bars"))
    left = groups.join(bars, ["lang", "source"], "left").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(_SALT)))
    counted = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    right = groups.join(counted, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    right = right.groupBy("lang", "block").agg(F.collect_list(F.struct("source", "none", "support")).alias("others")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALT - 1).cast("long"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                p = np.array([x["p"] for x in r.bars] if r.bars is not None else [], np.int64)
                n = np.array([x["n"] for x in r.bars] if r.bars is not None else [], np.int64)
                many, mass = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * p))
                names = np.array([x["source"] for x in r.others], object)
                none, support = (np.array([x[k] for x in r.others], np.int64) for k in ("none", "support"))
                at = np.searchsorted(p, none)
                value = none * (2 * many[at] - many[-1]) + mass[-1] - 2 * mass[at]
                first = np.array([r.source.encode() < x.encode() for x in names], bool)
                # the constant for terms of neither, once for each two
                value += np.where(first, np.abs(r.none - none) * (r.terms - r.support - support), 0)
                keep = names != r.source
                yield pd.DataFrame({"lang": r.lang, "a": np.where(first, r.source, names)[keep], "b": np.where(first, names, r.source)[keep], "value": value[keep]})

    return left.join(right, ["lang", "salt"]).select("lang", "source", "none", "support", "terms", "bars", "others").mapInPandas(run, "lang string, a string, b string, value long")


def both_sided(posts: DataFrame) -> DataFrame:
    """lang, a, b, value: what terms of both sources change in ``one_sided``, from a join of posting lists."""
    side = lambda k: posts.select("lang", "term", F.col("source").alias(k), F.col("p").alias(f"p_{k}"), F.col("none").alias(f"z_{k}"))
    met = side("a").join(side("b"), ["lang", "term"]).where("a < b")
    value = F.expr("abs(p_a - p_b) - abs(p_a - z_b) - abs(z_a - p_b) + abs(z_a - z_b)")
    return met.groupBy("lang", "a", "b").agg(F.sum(value).alias("value"))


def audited(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others, and by which terms.

    ``pair``: item is another source, value the sum over all kept terms of how far the two shares lie apart, in parts
    of 1,000,000,000. ``term``: item is a term that the source has more of than its language, the ``top`` by value.
    Ranks go by value, the largest first, then by item in UTF-8 order; so ties have a fixed order. A term is kept if ``least_docs`` rows of the language have it (repeated rows count each). Null and empty texts, languages
    and sources are read as empty: their groups are there and have no terms of their own. Long texts are read whole.
    Arithmetic is exact. Other columns are left aside; doc_id is not looked at; an empty table gives an empty table.
    """
    posts, groups = priced(materialise(term_counts(docs), "counts", batch=2000), least_docs)
    apart = one_sided(posts, groups).unionByName(both_sided(posts)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = apart.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = posts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER h + 5 * count(*) OVER h) AS p FROM x WINDOW h AS (PARTITION BY lang, source)),
y AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER h + 5 * count(*) OVER h) AS q FROM y WINDOW h AS (PARTITION BY lang)),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 50
"""
