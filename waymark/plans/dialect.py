"""The small SQL dialect: one table, SELECT, INSERT, UPDATE, DELETE, CREATE and DROP.

Comparisons are typed and two-valued (``!=`` holds for null, text never equals a number), which Spark SQL's are not;
so statements become DataFrame calls here. Plain ``spark.sql`` serves everything else. A superset of what the
dialect must do: any number of AND and OR with AND binding first, IN, BETWEEN, LIKE and IS NULL are left to Spark.
"""

from __future__ import annotations

import json
import re
import uuid
import warnings
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import feature_bbox
from ..functions.values import split_outside, sql_literal
from ..sources.versions import broken_rules
from .steps import Files

OPERATORS = (">=", "<=", "!=", "=", ">", "<")
_NAME = r"[\w.:`]+"


@dataclass
class Select:
    columns: list[str]
    table: str
    where: str | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None


@dataclass
class Change:
    kind: str  # insert, update, delete, create, drop
    table: str
    columns: list[str] | None = None
    values: list[Any] = field(default_factory=list)
    where: str | None = None
    primary_key: list[str] = field(default_factory=list)
    if_exists: bool = False


def parse(text: str) -> Select | Change:
    text = text.strip().rstrip(";").strip()
    word = text.split(None, 1)[0].lower() if text else ""
    parts = {"select": _select, "insert": _insert, "update": _update, "delete": _delete, "create": _create, "drop": _drop}
    if word not in parts:
        raise ValueError(f"unsupported statement: {word or 'empty'}")
    return parts[word](text)


def _matched(pattern: str, text: str, what: str) -> re.Match:
    m = re.fullmatch(pattern, text, re.I | re.S)
    if not m:
        raise ValueError(f"not a {what} statement of this dialect: {text}")
    return m


def _select(text: str) -> Select:
    m = _matched(rf"select\s+(?P<c>.+?)\s+from\s+(?P<t>{_NAME})(?:\s+where\s+(?P<w>.+?))?(?:\s+order\s+by\s+(?P<o>[\w.`]+)(?:\s+(?P<d>asc|desc))?)?(?:\s+limit\s+(?P<l>\d+))?", text, "SELECT")
    return Select([c.strip() for c in m["c"].split(",")], m["t"], m["w"], m["o"], (m["d"] or "").lower() == "desc", int(m["l"]) if m["l"] else None)


def _insert(text: str) -> Change:
    m = _matched(rf"insert\s+into\s+(?P<t>{_NAME})\s*(?:\((?P<c>[^)]*)\))?\s*values\s*\((?P<v>.*)\)", text, "INSERT")
    return Change("insert", m["t"], [c.strip() for c in m["c"].split(",")] if m["c"] else None, [sql_literal(v) for v in split_outside(m["v"])])


def _update(text: str) -> Change:
    m = _matched(rf"update\s+(?P<t>{_NAME})\s+set\s+(?P<s>.+?)(?:\s+where\s+(?P<w>.+))?", text, "UPDATE")
    pairs = [p.split("=", 1) for p in split_outside(m["s"])]
    return Change("update", m["t"], [a.strip() for a, _ in pairs], [sql_literal(b) for _, b in pairs], m["w"])


def _delete(text: str) -> Change:
    if m := re.fullmatch(rf"delete\s+table\s+(?P<e>if\s+exists\s+)?(?P<t>{_NAME})", text, re.I):
        return Change("drop", m["t"], if_exists=bool(m["e"]))
    m = _matched(rf"delete\s+from\s+(?P<t>{_NAME})(?:\s+where\s+(?P<w>.+))?", text, "DELETE")
    return Change("delete", m["t"], where=m["w"])


def _create(text: str) -> Change:
    """Column names; declared types are kept where Spark knows them (else text); the key is the first column by default."""
    m = _matched(rf"create\s+table\s+(?P<t>{_NAME})\s*\((?P<c>.*)\)", text, "CREATE")
    columns, types, key = [], [], []
    for part in split_outside(m["c"]):
        if k := re.fullmatch(r"primary\s+key\s*\((.*)\)", part, re.I | re.S):
            key = [x.strip() for x in k[1].split(",")]
            continue
        words = part.split()
        columns.append(words[0])
        types.append(words[1].lower() if len(words) > 1 else "string")
        if re.search(r"\bprimary\s+key\b", part, re.I):
            key.append(words[0])
    if len(set(columns)) < len(columns):
        raise ValueError("column names must differ")
    return Change("create", m["t"], columns, types, primary_key=key or columns[:1])


def _drop(text: str) -> Change:
    m = _matched(rf"drop\s+table\s+(?P<e>if\s+exists\s+)?(?P<t>{_NAME})", text, "DROP")
    return Change("drop", m["t"], if_exists=bool(m["e"]))


def comparison(df: DataFrame, name: str, op: str, literal: Any) -> Column:
    """``name op literal``; false for every row where there is no such column."""
    found = {c.lower(): (c, t) for c, t in df.dtypes}.get(name.strip("`").lower())
    if not found:
        return F.lit(False)
    value, kind = F.col(f"`{found[0]}`"), found[1]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    is_number = isinstance(literal, (int, float)) and not isinstance(literal, bool)
    if op in ("=", "!="):
        if literal is None:
            same = value.isNull()
        elif (numeric and is_number) or (kind == "boolean" and isinstance(literal, bool)) or (kind == "string" and isinstance(literal, str)):
            same = value.eqNullSafe(F.lit(literal))
        else:
            same = F.lit(False)
        return same if op == "=" else ~same
    if literal is None or isinstance(literal, bool):
        return F.lit(False)
    if is_number:
        # text that reads as a number is one here, and only here
        left = value if numeric else F.when(value.cast("string").rlike(r"^-?(?:\d+|\d*\.\d+)$"), value.cast("string").try_cast("double")) if kind == "string" else F.lit(None).cast("double")
    else:
        left = F.when(~value.rlike(r"^-?(?:\d+|\d*\.\d+)$"), value) if kind == "string" else F.lit(None).cast("string")
    right = F.lit(literal)
    return F.coalesce({">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op], F.lit(False))


def _pieces(text: str, word: str) -> list[str]:
    """Split at a word outside quotes."""
    out, quote, start, i = [], "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif m := re.compile(rf"\s{word}\s", re.I).match(text, i):
            out.append(text[start:i])
            start = i = m.end()
            continue
        i += 1
    return [*out, text[start:]]


def predicate(df: DataFrame, where: str | None) -> Column:
    if not where:
        return F.lit(True)
    whole = None
    for either in _pieces(where.strip(), "or"):
        part = None
        for one in _pieces(either, "and"):
            op = next((o for o in OPERATORS if o in one), None)
            if op is None:
                raise ValueError(f"not a condition of this dialect: {one.strip()}")
            name, literal = one.split(op, 1)
            now = comparison(df, name.strip(), op, sql_literal(literal))
            part = now if part is None else part & now
        whole = part if whole is None else whole | part
    return whole


def select(df: DataFrame, query: Select, max_rows: int | None = None, seq: str | None = "seq") -> DataFrame:
    """Filter, then sort (ties by ``seq`` where there is one), limit, and project.

    Unknown columns are dropped with a warning, repeated ones count once, and ``*`` anywhere means all.
    ``max_rows`` caps the rows at 1 to 500, as the API does.
    """
    names = {c.lower(): c for c in df.columns}
    out = df.where(predicate(df, query.where))
    if query.order_by and query.order_by.strip("`").lower() in names:
        key = F.col(f"`{names[query.order_by.strip('`').lower()]}`")
        ties = [F.col(seq)] if seq and seq in df.columns else []
        out = out.orderBy(key.desc_nulls_last() if query.descending else key.asc_nulls_first(), *ties)
    if query.limit is not None:
        out = out.limit(query.limit)
    if max_rows is not None:
        out = out.limit(min(500, max(1, max_rows)))
    if "*" in query.columns:
        return out
    known = list(dict.fromkeys(names[c.strip("`").lower()] for c in query.columns if c.strip("`").lower() in names))
    if len(known) < len(query.columns):
        warnings.warn("unknown or repeated columns were dropped", stacklevel=2)
    return out.select(*[F.col(f"`{c}`") for c in known])


def answered(df: DataFrame, query: Select, max_rows: int | None = None, seq: str | None = "seq") -> tuple[DataFrame, DataFrame]:
    """The rows of ``select``, and id (as text) and box of the rows kept, whatever columns the query names.

    Boxes are null where a feature has no geometry; a table without id or geometry gives no boxes at all.
    """
    kept_rows = select(df, replace(query, columns=["*"]), max_rows, seq)
    names = {c.lower(): c for c in df.columns}
    rows = select(kept_rows, replace(query, where=None, order_by=None, limit=None), None, None)
    if "id" not in names or "parts" not in names:
        return rows, df.sparkSession.createDataFrame([], "id string, minx double, miny double, maxx double, maxy double")
    b = feature_bbox(F.col(f"`{names['parts']}`"))
    return rows, kept_rows.select(F.col(f"`{names['id']}`").cast("string").alias("id"), *[b[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def changed_rows(df: DataFrame, change: Change) -> DataFrame:
    """``matched``: how many rows an UPDATE or DELETE touches."""
    return df.agg(F.count_if(predicate(df, change.where)).alias("matched"))


def inserted(df: DataFrame, change: Change) -> DataFrame:
    """``df`` and one row; columns that aren't named are null."""
    columns = change.columns or df.columns
    names = {c.lower(): c for c in df.columns}
    if unknown := [c for c in columns if c.lower() not in names]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    if not change.columns and len(change.values) != len(columns):
        raise ValueError("as many values as columns are needed")
    given = {names[c.lower()]: v for c, v in zip(columns, change.values, strict=False)}
    row = df.sparkSession.range(1).select(*[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(row)


def updated(df: DataFrame, change: Change) -> DataFrame:
    names = {c.lower(): f for c, f in zip(df.columns, df.schema.fields, strict=True)}
    if unknown := [c for c in change.columns or () if c.lower() not in names]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    hit = predicate(df, change.where)
    return df.withColumns({names[c.lower()].name: F.when(hit, F.lit(v).cast(names[c.lower()].dataType)).otherwise(F.col(f"`{names[c.lower()].name}`")) for c, v in zip(change.columns, change.values, strict=True)})


def deleted(df: DataFrame, change: Change) -> DataFrame:
    return df.where(~predicate(df, change.where))


class Catalog:
    """Tables of the dialect in Spark's catalog; one database for each owner.

    UPDATE and DELETE write the rows anew in another folder, to which the table's place then moves (Parquet tables have no
    UPDATE): a reader sees the rows before or after, never half of them. Kept constraints are held when rows are written if ``enforce``,
    else only when asked for. Only ``admin`` reads tables of others.
    """

    def __init__(self, spark: SparkSession, owner: str = "admin", enforce: bool = False):
        self.spark, self.owner, self.enforce = spark, owner.lower(), enforce
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.owner}`")

    def resolve(self, name: str) -> str:
        owner, _, table = name.strip("`").replace(":", ".").rpartition(".")
        owner = (owner or self.owner).lower()
        if owner != self.owner and self.owner != "admin":
            raise PermissionError(f"{self.owner} may not read tables of {owner}")
        return f"`{owner}`.`{table.lower()}`"

    def tables(self) -> DataFrame:
        """owner, table and column names of what this owner sees."""
        owners = [d.name for d in self.spark.catalog.listDatabases()] if self.owner == "admin" else [self.owner]
        rows = [(o, t.name, ",".join(c.name for c in self.spark.catalog.listColumns(f"`{o}`.`{t.name}`"))) for o in owners for t in self.spark.catalog.listTables(o) if not t.isTemporary]
        return self.spark.createDataFrame(rows, "owner string, table string, columns string")

    def _home(self, name: str) -> str:
        """The folder of a table; each change of its rows makes a new one in it."""
        owner, table = (x.strip("`") for x in name.split("."))
        return f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{owner}.tables/{table}"

    def _properties(self, name: str) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}

    def _put(self, name: str, **properties: str) -> None:
        listed = ", ".join(f"'{k}' = '{v.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'" for k, v in properties.items())
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({listed})")

    def _replace(self, name: str, df: DataFrame) -> None:
        """New rows are written whole in a folder of their own; then the table's place moves there, at once."""
        folder = f"{self._home(name)}/{uuid.uuid4().hex}"
        try:
            df.write.parquet(folder)
            self._hold(name, self.spark.read.schema(df.schema).parquet(folder))
        except Exception:
            Files(self.spark, folder).remove(folder)
            raise
        before = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first().data_type
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
        self.spark.catalog.refreshTable(name)
        self._put(name, previous_location=before)

    def undo(self, table: str) -> None:
        """The table as it was before the last UPDATE or DELETE (an undo again takes that back)."""
        name = self.resolve(table)
        before = self._properties(name).get("previous_location")
        if not before:
            raise ValueError(f"{table} has no earlier rows")
        now = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first().data_type
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{before}'")
        self.spark.catalog.refreshTable(name)
        self._put(name, previous_location=now)

    def save(self, table: str, df: DataFrame) -> DataFrame:
        """A new table of any rows; it must not exist, and a write that fails leaves none."""
        name = self.resolve(table)
        if self.spark.catalog.tableExists(name.replace("`", "")):
            raise ValueError(f"{table} exists")
        folder = f"{self._home(name)}/{uuid.uuid4().hex}"
        try:
            df.write.parquet(folder)
            self.spark.catalog.createTable(name.replace("`", ""), path=folder, source="parquet", schema=df.schema)
        except Exception:
            Files(self.spark, folder).remove(folder)
            raise
        return self.spark.table(name)

    def constrain(self, table: str, rules: list[dict]) -> None:
        """Keep constraints with a table: rules of ``sources.versions`` (not_null, unique, check_type, check), and
        {"kind": "references", "columns": [c], "table": other, "key": k}."""
        self._put(self.resolve(table), constraints=json.dumps(rules))

    def rules(self, table: str) -> list[dict]:
        return json.loads(self._properties(self.resolve(table)).get("constraints", "[]"))

    def validate(self, table: str) -> DataFrame:
        """rule and n of each kept constraint that the table breaks."""
        name = self.resolve(table)
        return self._broken(name, self.spark.table(name))

    def _broken(self, name: str, df: DataFrame) -> DataFrame:
        rules = json.loads(self._properties(name).get("constraints", "[]"))
        found = broken_rules(df, [r for r in rules if r["kind"] != "references"])
        for r in rules:
            if r["kind"] == "references":
                found = found.unionByName(violations(df, references=(r["columns"][0], self.spark.table(self.resolve(r["table"])), r["key"])))
        return found

    def _hold(self, name: str, df: DataFrame) -> None:
        if self.enforce and (broken := self._broken(name, df).collect()):
            raise ValueError("; ".join(f"{r.n} rows break {r.rule}" for r in broken))

    def execute(self, text: str) -> DataFrame | int:
        """Rows of a SELECT; of a change, how many rows it touched."""
        query = parse(text)
        name = self.resolve(query.table)
        if isinstance(query, Select):
            return select(self.spark.table(name), query)
        if query.kind == "create":
            kinds = {"int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "real": "double", "bool": "boolean", "boolean": "boolean"}
            schema = T.StructType([T.StructField(c, T._parse_datatype_string(kinds.get(t, "string"))) for c, t in zip(query.columns, query.values, strict=True)])
            self.save(query.table, self.spark.createDataFrame([], schema))
            self._put(name, primary_key=",".join(query.primary_key))
            return 0
        if query.kind == "drop":
            self.spark.sql(f"DROP TABLE {'IF EXISTS ' if query.if_exists else ''}{name}")
            Files(self.spark, self._home(name)).remove(self._home(name))
            return 0
        df = self.spark.table(name)
        if query.kind == "insert":
            row = inserted(df.limit(0), query)
            if self.enforce:
                self._hold(name, df.unionByName(row))
            row.write.insertInto(name)
            return 1
        touched = df.where(predicate(df, query.where)).count()
        self._replace(name, updated(df, query) if query.kind == "update" else deleted(df, query))
        return touched


def violations(df: DataFrame, primary_key: list[str] | None = None, not_null: list[str] | None = None, unique: list[str] | None = None, references: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """``rule`` and ``n`` of each broken constraint. Constraints are checked when asked for, not when writing."""
    spark, found = df.sparkSession, []
    for c in not_null or []:
        found.append(df.where(F.col(c).isNull()).agg(F.count("*").alias("n")).select(F.lit(f"not null {c}").alias("rule"), "n"))
    for keys in [k for k in [primary_key, *[[u] for u in unique or []]] if k]:
        found.append(df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"unique {','.join(keys)}").alias("rule"), "n"))
    if references:
        column, other, key = references
        found.append(df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"foreign key {column}").alias("rule"), "n"))
    out = spark.createDataFrame([], "rule string, n long")
    for f in found:
        out = out.unionByName(f)
    return out.where("n > 0")
