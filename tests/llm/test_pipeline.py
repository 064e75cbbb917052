import corpus_pipeline
from waymark.llm import minhash
from waymark.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_queries_match_sql(spark):
    import duckdb

    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        want, got = base.sql(sql).df(), queries()[name](spark, DATA).toPandas()
        by = ["doc_id"] if "doc_id" in want else ["lang", "source", "part", "rank"]
        want, got = want.sort_values(by), got.sort_values(by)
        for c in want.columns:
            assert want[c].astype(str).tolist() == got[c].astype(str).tolist(), (name, c)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("lang", "lang")
    extra = docs.selectExpr("*", "1 AS keep", "'x' AS text_hash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, extra, DATA)
        assert now.columns == extra.columns, name
        extra = now.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, DATA)
    assert packed.select("doc_id").distinct().count() == extra.count()
    # near copies are gone: no two of the texts left share 0.8 of their shingles
    sets = [set(minhash.Shingles(5)(r.text).tolist()) for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a | b)


ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "½ ² ①", "en", "a", 5), (4, "the same words again and again in this text", "en", None, 43),
    (4, "the same words again and again in this text", "en", None, 43), (None, "a row without an id but with mail x.y@example.com in it", "de", "a", 9), (6, "long words " * 30_000 + "x" * 5000, "en", "c", 170_000),
]


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(ROWS, schema).selectExpr("*", "1 AS keep", "'x' AS text_hash", "2 AS own_id", "3 AS row", "array(1) AS pii_spans")
    counts = lambda rows: sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)
    want = {"language_id": [-1, 4, 4, 6], "simhash_near_dedup": [-1, 1, 4, 6], "decontamination": [-1, 1, 2, 3, 4, 4, 6], "pii": [-1, 1, 2, 3, 4, 4, 6]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, DATA)
        if name in want:
            assert got.columns == odd.columns
            rows = got.collect()
            ids = counts(rows)
            assert ids == want[name] or name == "simhash_near_dedup" and sorted(set(ids) & {-1, 4, 6}) == [-1, 4, 6], (name, ids)
            assert all(r.own_id == 2 and r.row == 3 and r.keep == 1 for r in rows)
        else:
            assert got.where("piece = 0").count() == len(ROWS)
        assert stage(spark, odd.limit(0), DATA).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert counts(corpus_pipeline.identify_language(spark, unlabelled, DATA).collect()) == [-1, 4, 4, 6]


def test_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "other words are here now too", "en", "s", 28), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "a b c d e f g"), (1, "other words are here now too"), (2, "")]


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
