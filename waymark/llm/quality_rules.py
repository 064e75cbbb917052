"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

The sketch is a histogram with 64 buckets to each doubling of the value (exact below 64, within 1/64 above), so
sketches of parts merge by adding counts, and a quantile is the same however the rows were dealt out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SMALL, materialise

#: Metric: whether low values are odd too. Per mille, but for mean word length in hundredths.
METRICS = {"symbols": False, "dup_lines": False, "repeats": False, "word_length": True}
#: The quantiles, in hundredths, that bounds are made of.
QUANTILES = (1, 25, 75, 99)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode().split()  # bytes: only \x20 \x09-\x0D split
    n, repeats = len(words), 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeats, len(lines)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row; a null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([counted(x) for x in batch["text"]], columns=list(COUNTS), index=batch.index, dtype="int64")
            yield pd.concat([batch[["doc_id", "lang", "source"]].astype({"lang": object, "source": object}), found], axis=1)

    return docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _metrics() -> dict[str, Column]:
    share = lambda a, b, by: F.floor(F.lit(by) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbols": share("n_symbols", "n_words", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000), "word_length": share("word_chars", "n_words", 100)}


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds a value (a long of 0 or more)."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor(value / unit) * unit).cast("long")


def sketch(rows: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """keys, metric, bucket, n: one mergeable sketch for each key and metric."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics.items()])
    return rows.select(*keys, F.inline(each)).groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, total and the ``QUANTILES`` (q1, q25, ...) of each sketch."""
    w = Window.partitionBy(*keys, "metric")
    run = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[at(q).alias(f"q{q}") for q in QUANTILES])


def thresholds(rows: DataFrame, least_rows: int = 200, spread: int = 4) -> DataFrame:
    """lang, source and the bounds of each metric, from the group's own sketch alone.

    A value is odd if it lies more than ``spread`` times the quartile distance beyond the quartiles, and beyond the
    first or last hundredth of its group too: where the quartiles coincide, as where most texts have no repeated
    line, the outer quantile is the bound. A language and source with fewer than ``least_rows`` rows takes the bounds
    of its language, and one of those with fewer those of all rows. ``rows`` are ``features``; only those that didn't
    fail the base rules shape the sketches, but every pair of language and source (nulls included) gets a row.
    """
    own = sketch(rows.where("not base_failed"), ["lang", "source"], _metrics())
    own = materialise(own, "sketches")
    by_lang, by_all = merged(own, ["lang"]), merged(own, [])
    pairs = rows.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    a, b, c = (quantiles(x, k).withColumnsRenamed({y: f"{n}_{y}" for y in ("total", "lang", "source", "metric", *(f"q{q}" for q in QUANTILES))}) for n, x, k in (("a", own, ["lang", "source"]), ("b", by_lang, ["lang"]), ("c", by_all, [])))
    wide = (
        pairs.join(a, F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")) & (F.col("metric") == F.col("a_metric")), "left")
        .join(b, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("metric") == F.col("b_metric")), "left")
        .join(c, F.col("metric") == F.col("c_metric"), "left")
    )
    pick = lambda q: F.when(F.col("a_total") >= least_rows, F.col(f"a_{q}")).when(F.col("b_total") >= least_rows, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    wide = wide.select("lang", "source", "metric", *[pick(f"q{q}").alias(f"q{q}") for q in QUANTILES])
    far, bounds = (F.col("q75") - F.col("q25")) * spread, []
    for m, both in METRICS.items():
        of = lambda x: F.max(F.when(F.col("metric") == m, x))  # noqa: B023, E731
        bounds.append(of(F.greatest(F.col("q75") + far, F.col("q99"))).alias(f"most_{m}"))
        if both:
            bounds.append(of(F.least(F.col("q25") - far, F.col("q1"))).alias(f"least_{m}"))
    return wide.groupBy("lang", "source").agg(*bounds)


def filtered(docs: DataFrame, least_rows: int = 200, spread: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept.

    A null or empty text has no words and fails the base rules; a text of any length is counted whole. Null
    languages and sources are groups like any other. The bounds go to every executor where there are ``SMALL`` pairs
    of language and source at most. Repeated rows come back each; other columns are left aside; an empty table gives
    an empty table.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialise(features(docs).withColumn("base_failed", base), "features")
    limits = materialise(thresholds(rows, least_rows, spread).withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), "limits")
    limits = F.broadcast(limits) if limits.count() <= SMALL else limits
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    within = F.lit(True)
    for m, v in _metrics().items():
        within = within & (v <= F.coalesce(F.col(f"most_{m}"), v))
        if METRICS[m]:
            within = within & (v >= F.coalesce(F.col(f"least_{m}"), v))
    return joined.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & within).alias("kept"))


ORACLE = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM t),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM tri WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM t),
f AS (SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM t JOIN w USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  1000 * n_symbols // greatest(n_words, 1) AS m_symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS m_dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS m_repeats, 100 * word_chars // greatest(n_words, 1) AS m_word_length FROM f),
m AS (UNPIVOT (SELECT lang, source, m_symbols, m_dup_lines, m_repeats, m_word_length FROM g WHERE NOT base_failed) ON m_symbols, m_dup_lines, m_repeats, m_word_length INTO NAME metric VALUE v),
b AS (SELECT lang, source, metric, (v // CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT)) * CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bucket FROM m),
q AS (SELECT 'a' AS level, lang, source, metric, count(*) AS total, list_sort(list(bucket))[(1 * count(*) + 99) // 100] AS q1, list_sort(list(bucket))[(25 * count(*) + 99) // 100] AS q25, list_sort(list(bucket))[(75 * count(*) + 99) // 100] AS q75, list_sort(list(bucket))[(99 * count(*) + 99) // 100] AS q99 FROM b GROUP BY lang, source, metric
  UNION ALL SELECT 'b', lang, NULL, metric, count(*), list_sort(list(bucket))[(1 * count(*) + 99) // 100], list_sort(list(bucket))[(25 * count(*) + 99) // 100], list_sort(list(bucket))[(75 * count(*) + 99) // 100], list_sort(list(bucket))[(99 * count(*) + 99) // 100] FROM b GROUP BY lang, metric
  UNION ALL SELECT 'c', NULL, NULL, metric, count(*), list_sort(list(bucket))[(1 * count(*) + 99) // 100], list_sort(list(bucket))[(25 * count(*) + 99) // 100], list_sort(list(bucket))[(75 * count(*) + 99) // 100], list_sort(list(bucket))[(99 * count(*) + 99) // 100] FROM b GROUP BY metric),
p AS (SELECT DISTINCT lang, source, metric FROM g, (VALUES ('m_symbols'), ('m_dup_lines'), ('m_repeats'), ('m_word_length')) v(metric)),
r AS (SELECT p.lang, p.source, p.metric,
  CASE WHEN a.total >= 200 THEN a.q1 WHEN b.total >= 200 THEN b.q1 ELSE c.q1 END AS q1,
  CASE WHEN a.total >= 200 THEN a.q25 WHEN b.total >= 200 THEN b.q25 ELSE c.q25 END AS q25,
  CASE WHEN a.total >= 200 THEN a.q75 WHEN b.total >= 200 THEN b.q75 ELSE c.q75 END AS q75,
  CASE WHEN a.total >= 200 THEN a.q99 WHEN b.total >= 200 THEN b.q99 ELSE c.q99 END AS q99
  FROM p LEFT JOIN q a ON a.level = 'a' AND a.lang IS NOT DISTINCT FROM p.lang AND a.source IS NOT DISTINCT FROM p.source AND a.metric = p.metric
  LEFT JOIN q b ON b.level = 'b' AND b.lang IS NOT DISTINCT FROM p.lang AND b.metric = p.metric LEFT JOIN q c ON c.level = 'c' AND c.metric = p.metric),
h AS (SELECT lang, source, metric, greatest(q75 + 4 * (q75 - q25), q99) AS most, least(q25 - 4 * (q75 - q25), q1) AS lowest FROM r),
s AS (SELECT lang, source, max(CASE WHEN metric = 'm_symbols' THEN most END) AS hs, max(CASE WHEN metric = 'm_dup_lines' THEN most END) AS hd, max(CASE WHEN metric = 'm_repeats' THEN most END) AS hr,
  max(CASE WHEN metric = 'm_word_length' THEN most END) AS hw, max(CASE WHEN metric = 'm_word_length' THEN lowest END) AS lw FROM h GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND m_symbols <= coalesce(hs, m_symbols) AND m_dup_lines <= coalesce(hd, m_dup_lines) AND m_repeats <= coalesce(hr, m_repeats) AND m_word_length BETWEEN coalesce(lw, m_word_length) AND coalesce(hw, m_word_length) AS kept
FROM g JOIN s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
"""
