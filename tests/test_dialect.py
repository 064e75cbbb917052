import pytest

from waymark.plans import dialect as D


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "5", None, 1), (2, "x", 2.5, 2), (3, None, 7.0, 3)], "id long, name string, v double, seq long")


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    ("where", "want"),
    [("name = 5", []), ("name != 5", [1, 2, 3]), ("name = '5'", [1]), ("name >= 5", [1]), ("v != 2.5", [1, 3]), ("v = null", [1]), ("v != none", [2, 3]), ("v < 5 or id = 3", [2, 3]), ("id > 1 AND v > 2 AND v < 3", [2]), ("nothing = 1", []), ("name = 'a or b'", [])],
)
def test_where(table, where, want):
    assert ids(D.select(table, D.parse(f"SELECT * FROM t WHERE {where}"))) == want


def test_unknown_columns_are_dropped(table):
    with pytest.warns(UserWarning):
        assert D.select(table, D.parse("SELECT ID, nope FROM t ORDER BY v DESC LIMIT 2 ;")).columns == ["id"]


def test_bad_statements():
    for text in ("", "MERGE INTO t", "SELECT FROM t"):
        with pytest.raises(ValueError):
            D.parse(text)
    with pytest.raises(ValueError):
        D.predicate(None, "a between 1 and 2")


def test_catalog_round_trip(spark, tmp_path):
    c = D.Catalog(spark, "owner1")
    c.execute("DROP TABLE IF EXISTS t")
    c.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    assert c.execute("INSERT INTO t VALUES (1, 'a,b')") == 1
    c.execute("INSERT INTO t (id) VALUES (2)")
    assert c.execute("UPDATE t SET name = 'z' WHERE name = null") == 1
    assert sorted((r.id, r.name) for r in c.execute("SELECT * FROM t").collect()) == [(1, "a,b"), (2, "z")]
    assert c.execute("DELETE FROM t WHERE id = 1") == 1
    assert c.execute("SELECT id FROM t").count() == 1
    with pytest.raises(PermissionError):
        c.execute("SELECT * FROM other:t")
    c.execute("DELETE TABLE t")
    assert c.tables().count() == 0
    with pytest.raises(ValueError):
        D.inserted(spark.range(1), D.parse("INSERT INTO t (nope) VALUES (1)"))
