"""Versioned tables: immutable data, and a pointer that moves at once.

A table is a folder. Its rows lie in folders of Parquet files that are never changed; a version is a small manifest
that names the folders whose rows it has, and the newest manifest is the table. A manifest is written beside and renamed
into its place, which fails if another writer was there first: so a reader sees a whole version or the one before, never a half-written one,
and of two writers that began from one version, one is told so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.steps import Files


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


class Versions:
    """A table of versions in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json")]

    def current(self) -> int | None:
        """The number of the newest version; None before the first."""
        return max(self.numbers(), default=None)

    def manifest(self, version: int | str | None = None) -> dict:
        """What a version is made of, by number or by the name of a snapshot; the newest by default."""
        if isinstance(version, str):
            version = json.loads(self.files.text(f"{self.folder}/snapshots/{version}.json"))["version"]
        version = self.current() if version is None else version
        if version is None or version not in self.numbers():
            raise ValueError(f"{self.folder} has no version {version}")
        return json.loads(self.files.text(f"{self.folder}/versions/{version:012d}.json"))

    def _rows(self, made: dict) -> DataFrame:
        schema = T.StructType.fromJson(made["schema"])
        paths = [f"{self.folder}/data/{x}" for x in made["folders"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if made.get("runs"):
            schema = T.StructType([*schema.fields, T.StructField("_at", T.LongType()), T.StructField("_run", T.LongType())])
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | str | None = None) -> DataFrame:
        return self._rows(self.manifest(version)).drop("_at", "_run")

    def history(self) -> DataFrame:
        """version, parent, rows, note of every version."""
        rows = [(m["version"], m["parent"], m["rows"], m["note"]) for m in map(self.manifest, self.numbers())]
        return self.spark.createDataFrame(rows, "version long, parent long, rows long, note string")

    def _written(self, df: DataFrame, by: tuple[str, ...] = ()) -> str:
        """Rows in a folder of their own; a failed write leaves nothing."""
        name = uuid.uuid4().hex
        try:
            df.write.partitionBy(*by).parquet(f"{self.folder}/data/{name}")
        except Exception:
            self.files.remove(f"{self.folder}/data/{name}")
            raise
        return name

    def _committed(self, parent: int | None, **made: object) -> int:
        version = 0 if parent is None else parent + 1
        if not self.files.put(f"{self.folder}/versions/{version:012d}.json", json.dumps({"version": version, "parent": parent} | made)):
            raise Conflict(f"version {version} of {self.folder} was made by another writer")
        return version

    def _checked(self, made: dict, new: str, added: DataFrame, parent: int | None) -> int:
        """Commit a version whose newest folder is ``new``, if its constraints hold; else that folder goes."""
        try:
            self._hold(self._rows(made), made["constraints"])
            return self._committed(parent, **made | {"rows": made["rows"] + added.count()})
        except Exception:
            self.files.remove(f"{self.folder}/data/{new}")
            raise

    def save(self, df: DataFrame, note: str = "saved") -> int:
        """Make ``df`` the table; returns the version. ``df`` may read the table itself.

        Rows are held against the table's constraints (see ``constrain``) before the version counts.
        """
        parent = self.current()
        rules = self.manifest(parent)["constraints"] if parent is not None else []
        name = self._written(df)
        made = {"folders": [name], "rows": 0, "note": note, "schema": json.loads(df.schema.json()), "constraints": rules}
        return self._checked(made, name, self._rows(made), parent)

    def append(self, df: DataFrame, note: str = "appended") -> int:
        """The table and the rows of ``df``; what is there isn't written again."""
        before = self.manifest()
        schema = T.StructType.fromJson(before["schema"])
        if before.get("runs"):
            raise ValueError("an ordered table is saved whole")
        name = self._written(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]))
        kept = {k: before[k] for k in ("rows", "schema", "constraints")}
        return self._checked(kept | {"folders": [*before["folders"], name], "note": note}, name, self._rows(kept | {"folders": [name]}), before["version"])

    def save_ordered(self, df: DataFrame, order: list[str], note: str = "ordered") -> int:
        """Make ``df`` the table, kept in ``order``, so that rows can be had by position (``row``).

        Rows are range-partitioned, sorted and written a folder for each range; the ranges' sizes are kept in the manifest.
        """
        parent = self.current()
        rules = self.manifest(parent)["constraints"] if parent is not None else []
        at = F.monotonically_increasing_id()
        runs = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), F.shiftright(at, 33).alias("_run"))
        name = self._written(runs, ("_run",))
        made = {"folders": [name], "rows": 0, "note": note, "schema": json.loads(df.schema.json()), "constraints": rules, "runs": [[0, 0, 0]]}
        sizes = self._rows(made).groupBy("_run").agg(F.count("*").alias("n")).orderBy("_run").collect()  # a row for each range
        ends = list(accumulate((r.n for r in sizes), initial=0))
        return self._checked(made | {"runs": [[r["_run"], first, r.n] for r, first in zip(sizes, ends, strict=False)]}, name, self._rows(made), parent)

    def row(self, place: int, version: int | str | None = None) -> DataFrame:
        """The row at a position of an ordered table, from 0, or from the end if negative; IndexError where there is none.

        Only the folder of the range that holds it is read.
        """
        made = self.manifest(version)
        if "runs" not in made:
            raise ValueError("only a table that was saved in an order has positions")
        at = place + made["rows"] if place < 0 else place
        run = next(((r, first) for r, first, n in made["runs"] if first <= at < first + n), None)
        if run is None:
            raise IndexError(f"no row {place}")
        return self._rows(made).where((F.col("_run") == run[0]) & (F.col("_at") == at - run[1])).drop("_at", "_run")

    def snapshot(self, name: str, version: int | None = None) -> int:
        """Give a version a name that keeps its data; returns its number."""
        made = self.manifest(version)
        if not self.files.put(f"{self.folder}/snapshots/{name}.json", json.dumps({"version": made["version"]})):
            raise ValueError(f"there is a snapshot {name} already")
        return made["version"]

    def restore(self, version: int | str) -> int:
        """Make an earlier version, or a snapshot, the table again: a new version that names the old data."""
        made = self.manifest(version)
        kept = {k: v for k, v in made.items() if k not in ("version", "parent", "note")}
        return self._committed(self.current(), note=f"restored {made['version']}", **kept)

    @contextmanager
    def guarded(self) -> Iterator[DataFrame]:
        """The table as it is now, for a block of work on it; if the block fails, the table becomes that again."""
        before = self.current()
        try:
            yield self.read(before)
        except BaseException:
            if self.current() != before:
                self.restore(before)
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove data that neither the newest ``keep`` versions nor a snapshot names; older versions go with it."""
        numbers = self.numbers()
        pinned = {json.loads(self.files.text(f"{self.folder}/snapshots/{n}"))["version"] for n in self.files.names(f"{self.folder}/snapshots")}
        stay = {*numbers[-keep:], *pinned}
        used = {x for n in stay for x in self.manifest(n)["folders"]}
        for n in set(numbers) - stay:
            self.files.remove(f"{self.folder}/versions/{n:012d}.json")
        gone = [x for x in self.files.names(f"{self.folder}/data") if x not in used]
        for x in gone:
            self.files.remove(f"{self.folder}/data/{x}")
        return gone

    def constrain(self, rules: list[dict]) -> int:
        """Keep constraints with the table, from the next version on; rows that are there must hold them.

        A rule is {"kind", "columns"} with kind not_null, unique, check_type (and "type", a Spark type's name) or check
        (and "condition", a SQL expression that a row breaks where it is false).
        """
        made = self.manifest()
        self._hold(self.read(), rules)
        kept = {k: v for k, v in made.items() if k not in ("version", "parent", "note", "constraints")}
        return self._committed(made["version"], note="constraints", constraints=rules, **kept)

    def _hold(self, df: DataFrame, rules: list[dict]) -> None:
        if rules and (broken := [(r.rule, r.n) for r in broken_rules(df, rules).collect()]):
            raise ValueError("; ".join(f"{n} rows break {rule}" for rule, n in broken))


def broken_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``rule`` and ``n`` (how many rows, or keys, break it) of the rules that don't hold; one pass for all but unique ones."""
    spark = df.sparkSession
    names, counts, uniques = [], [], []
    for rule in rules:
        kind, columns = rule["kind"], rule.get("columns", [])
        name = f"{kind} {','.join(columns) or rule.get('condition', '')}"
        if kind == "unique":
            many = df.groupBy(*columns).agg(F.count("*").alias("many")).where("many > 1")
            uniques.append(many.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n"))
            continue
        names.append(name)
        if kind == "not_null":
            bad: Column = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
        elif kind == "check_type":
            bad = F.col(columns[0]).isNotNull() & F.expr(f"try_cast(`{columns[0]}` AS {rule['type']})").isNull()
        elif kind == "check":
            bad = ~F.coalesce(F.expr(rule["condition"]), F.lit(True))
        else:
            raise ValueError(f"no such constraint: {kind}")
        counts.append(F.coalesce(F.sum(bad.cast("long")), F.lit(0)))
    out = spark.createDataFrame([], "rule string, n long")
    if counts:
        row = df.agg(F.array(*[F.struct(F.lit(a).alias("rule"), b.alias("n")) for a, b in zip(names, counts, strict=True)]).alias("all"))
        out = out.unionByName(row.select(F.inline("all")))
    for x in uniques:
        out = out.unionByName(x)
    return out.where("n > 0")
