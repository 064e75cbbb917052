import pytest
from pyspark.sql import functions as F

from waymark.plans import dialect as D
from waymark.sources.versions import Conflict, Versions, broken_rules


@pytest.fixture
def table(spark, tmp_path):
    made = Versions(spark, str(tmp_path / "t"))
    made.save(spark.range(10).toDF("id"))
    made.append(spark.range(100, 103).toDF("id"))
    return made


def fails(df):
    """The rows, but for a write that breaks off half way."""
    return df.select(F.when(F.col("id") > 5, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_a_failed_write_changes_nothing(table):
    seen = table.read()
    data = table.files.names(f"{table.folder}/data")
    with pytest.raises(Exception, match="half way"):
        table.save(fails(table.read()))
    with pytest.raises(Exception, match="half way"):
        table.append(fails(table.read()))
    assert table.current() == 1 and table.files.names(f"{table.folder}/data") == data
    assert table.read().count() == seen.count() == 13


def test_readers_keep_their_version(table):
    before = table.read()
    table.save(table.read().where("id < 3"))
    assert before.count() == 13 and table.read().count() == 3 and table.read(0).count() == 10


def test_snapshot_and_restore(table):
    table.snapshot("before")
    with pytest.raises(ValueError, match="already"):
        table.snapshot("before")
    table.save(table.read().where("id < 3"), "cut")
    table.save(table.read().where("id < 2"), "cut")
    assert table.vacuum() and table.read("before").count() == 13
    assert table.restore("before") == 4
    assert sorted(r.id for r in table.read().collect()) == [*range(10), 100, 101, 102]
    assert [(r.version, r.note) for r in table.history().orderBy("version").collect()] == [(1, "appended"), (3, "cut"), (4, "restored 1")]
    with pytest.raises(ValueError, match="no version"):
        table.read(2)


def test_a_block_that_fails_is_undone(table):
    with pytest.raises(RuntimeError, match="after"), table.guarded() as rows:
        table.save(rows.where("id < 3"))
        assert table.read().count() == 3
        raise RuntimeError("after the write")
    assert table.read().count() == 13


def test_of_two_writers_one_is_told(table, monkeypatch):
    other = Versions(table.spark, table.folder)
    monkeypatch.setattr(other, "current", lambda n=table.current(): n)
    table.save(table.read().where("id < 3"))
    with pytest.raises(Conflict):
        other.save(table.read().where("id < 2"))
    assert table.read().count() == 3


def test_kept_constraints(table):
    with pytest.raises(ValueError, match="3 rows break check id < 100"):
        table.constrain([{"kind": "check", "condition": "id < 100"}])
    table.constrain([{"kind": "unique", "columns": ["id"]}, {"kind": "not_null", "columns": ["id"]}, {"kind": "check_type", "columns": ["id"], "type": "int"}])
    with pytest.raises(ValueError, match="1 rows break unique id"):
        table.append(table.spark.range(1).toDF("id"))
    with pytest.raises(ValueError, match="not_null id"):
        table.append(table.spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    with pytest.raises(ValueError, match="check_type id"):
        table.append(table.spark.sql("SELECT 5000000000 AS id"))
    table.save(table.read().where("id < 3"))
    assert len(table.manifest()["constraints"]) == 3 and table.read().count() == 3
    assert broken_rules(table.read().limit(0), table.manifest()["constraints"]).count() == 0


def test_rows_by_position(table, capsys):
    table.save_ordered(table.spark.range(1000).select((999 - F.col("id")).alias("id"), F.lit("x").alias("v")).repartition(7), ["id"])
    assert [table.row(i).first().id for i in (0, 1, 700, 999, -1, -1000)] == [0, 1, 700, 999, 999, 0]
    for i in (1000, -1001):
        with pytest.raises(IndexError):
            table.row(i)
    table.row(700).explain()
    assert "PartitionFilters: [isnotnull(_run" in capsys.readouterr().out
    assert table.read().columns == ["id", "v"] and table.read().count() == 1000


def test_catalog_moves_a_tables_place(spark):
    c = D.Catalog(spark, "owner2", enforce=True)
    c.execute("DROP TABLE IF EXISTS t")
    c.save("t", spark.range(10).select("id", F.lit("a").alias("name")))
    with pytest.raises(ValueError, match="exists"):
        c.save("t", spark.range(1))
    assert c.execute("UPDATE t SET name = 'b' WHERE id < 4") == 4
    assert c.execute("SELECT * FROM t WHERE name = 'b'").count() == 4
    c.undo("t")
    assert c.execute("SELECT * FROM t WHERE name = 'b'").count() == 0
    c.constrain("t", [{"kind": "unique", "columns": ["id"]}, {"kind": "references", "columns": ["id"], "table": "t", "key": "id"}, {"kind": "check", "condition": "name <> 'z''s'"}])
    assert c.validate("t").count() == 0 and len(c.rules("t")) == 3
    with pytest.raises(ValueError, match="unique id"):
        c.execute("INSERT INTO t VALUES (3, 'c')")
    with pytest.raises(ValueError, match="unique id"):
        c.execute("UPDATE t SET id = 1")
    assert c.execute("SELECT id FROM t").count() == 10
    with pytest.raises(Exception, match="half way"):
        c.save("u", fails(spark.range(10)))
    assert not spark.catalog.tableExists("owner2.u")
    c.save("u", spark.range(2))
    c.execute("DROP TABLE u")
    c.execute("DROP TABLE t")
