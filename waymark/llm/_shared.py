"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is made, set as its checkpoint folder, and
    removed at exit. On a cluster, whose executors could not see such a folder, that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN = "_waymark_written"
#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    Cuts the lineage: a lost executor costs only the tasks that it ran, and several uses don't recompute. The
    shuffle files of the write go with it, as nothing reads them again. ``batch`` bounds the rows that Python gets at
    once, for steps whose rows are whole texts or long lists.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _WRITTEN, path)
    return out


def freed(*tables: DataFrame) -> None:
    """Empties what ``materialise`` wrote; nothing that is still to be computed may read it."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(getattr(t, _WRITTEN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """At the end of a task on whole texts: memory it no longer needs goes back to the system.

    Python workers live on from step to step; what their allocators keep would add up over the stages of a pipeline.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def remainder_is(doc_id: Column, divisor: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def groups_of(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``most`` characters each (one text at least)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Rows of two longs that may go to every executor: some 100 MB there.
SMALL = 1_000_000


def text_hash(text: Column) -> Column:
    """xxhash64 of a text (null: empty), so that rows with one id but other texts are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, text_hash) are in ``gone``; all columns stay, whatever their names.

    ``gone`` is a written table. Where it has ``SMALL`` rows at most it goes to every executor and the documents stay
    where they are; a larger one is joined by id and hash.
    """
    names = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    if gone.count() <= SMALL:
        names = F.broadcast(names)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), text_hash(docs["text"]).alias("own_hash"))
    left = own.join(names, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def salted_join(rows: DataFrame, table: DataFrame, key: str, total: int, part: int = 1000) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``table`` on ``key``; ``table`` has each key once and ``n``, its rows.

    A key of more than ``part`` rows is dealt out in as many parts, and its row of ``table`` copied to each, so no
    task gets all its rows. Which keys those are goes to every executor: one in ``part`` rows at most, and
    ``part`` grows with the rows so that there are 100,000 at most. Parts follow from a hash of the row, so a
    task that runs again deals its rows as before.
    """
    parts = F.ceil(F.col("n") / max(part, total // 100_000)).cast("int")
    hot = F.broadcast(table.select(F.col(key).alias("hot_key"), parts.alias("hot_parts")).where("hot_parts > 1"))
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce(F.col("hot_parts"), F.lit(1))).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("salt", salt).drop("hot_key", "hot_parts")
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(copies, [key, "salt"]).drop("salt")
