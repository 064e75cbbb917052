"""Large feature collections: one JSON document read by many tasks.

Spark's text reader cuts a file into byte ranges; with a closing brace as line separator no token is ever cut. A range can't know
whether it starts inside a string, or how deep, so a first pass sums each range up under both assumptions, and a scan over
those sums (a row a range) tells every range its true start. In a second pass each range finds the features that start in
it by arrays of bytes, not by parsing; what runs on into the next range is put together by its number. Then features
are parsed as rows, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.steps import kept

_QUOTE, _BACK, _OPEN, _CLOSE, _IN, _OUT = (ord(c) for c in '"\\{}[]')


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of JSON bytes that start ``inside`` a string or not: which bytes are outside strings, what each adds to the depth,
    and whether the end is inside a string. The first byte must not be escaped."""
    quote = data == _QUOTE
    back = data == _BACK
    if back.any():
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(back, -1, at))  # the last byte that is no backslash
        run = np.empty(len(data), np.int64)  # backslashes just before each byte
        run[0], run[1:] = 0, at[:-1] - last[:-1]
        quote &= run % 2 == 0
    within = (np.cumsum(quote) + inside) % 2 == 1  # from an opening quote up to before the closing one
    outside = ~within & ~quote
    step = np.zeros(len(data), np.int64)
    step[outside & ((data == _OPEN) | (data == _IN))] = 1
    step[outside & ((data == _CLOSE) | (data == _OUT))] = -1
    return outside, step, bool(within[-1]) if len(data) else inside


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, value: the text in runs up to a closing brace, in order within each range (file, block)."""
    text = spark.read.option("lineSep", "}").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """Consecutive rows of one range as bytes; a range may come in several of them."""
    for batch in batches:
        edges = np.flatnonzero((batch["file"].to_numpy()[1:] != batch["file"].to_numpy()[:-1]) | (batch["block"].to_numpy()[1:] != batch["block"].to_numpy()[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
            if b > a:
                yield (batch["file"].iloc[a], int(batch["block"].iloc[a])), np.frombuffer(("}".join(batch["value"].iloc[a:b]) + "}").encode(), np.uint8)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file, block, part, flips (an odd number of quotes), and by how much the depth changes from outside and from inside a string."""
    for part, ((file, block), data) in enumerate(_ranges(batches)):
        _, step0, ends = structure(data, False)
        _, step1, _ = structure(data, True)
        yield pd.DataFrame({"file": [file], "block": [block], "part": [part], "flips": [int(ends)], "from_outside": [int(step0.sum())], "from_inside": [int(step1.sum())]})


def starts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, inside, depth: how each range of the files starts."""
    summed = _pieces(spark, paths).mapInPandas(_summed, "file string, block long, part long, flips int, from_outside long, from_inside long")
    # parts of a range (batches of one task) in their order, then ranges: a scan in two steps over a row each
    own = Window.partitionBy("file", "block").orderBy("part")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    parity = (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).alias("parity")
    parts = kept(summed, "ranges").select("*", parity)
    flipped = F.when(F.col("parity") == 0, F.struct(F.col("from_outside").alias("o"), F.col("from_inside").alias("i"))).otherwise(F.struct(F.col("from_inside").alias("o"), F.col("from_outside").alias("i")))
    whole = parts.groupBy("file", "block").agg((F.sum("flips") % 2).alias("flips"), F.sum(flipped["o"]).alias("from_outside"), F.sum(flipped["i"]).alias("from_inside"))
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = whole.withColumn("inside", F.coalesce(F.sum("flips").over(by_file), F.lit(0)) % 2 == 1)
    scanned = scanned.withColumn("adds", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    return scanned.select("file", "block", "inside", F.coalesce(F.sum("adds").over(by_file), F.lit(0)).cast("long").alias("depth"))


class _Reader:
    """Features of one range, whose state at the start is known.

    A feature is an object that opens at depth 2, in the list under the key "features" of the document. Where a range starts at
    that depth or deeper, only ranges before tell whether that list is open: until the list opens or closes, what is found is unsure.
    """

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.in_list: bool | None = None if depth >= 2 else False
        self.open = depth > 2  # within what began in a range before
        self.number = -1 if self.open else 0  # -1: the rest of what began before
        self.held: list[bytes] = []
        self.root: list[bytes] = []
        self.rows: list[tuple[int, bool, bool, str]] = []

    def feed(self, data: np.ndarray) -> None:
        outside, step, ends = structure(data, self.inside)
        depth = self.depth + np.cumsum(step)
        before = depth - step
        listed, unsure = np.zeros(len(data), bool), np.zeros(len(data), bool)
        edges = np.flatnonzero(((data == _IN) & (step == 1) & (depth == 2)) | ((step == -1) & (depth == 1)))
        at = 0
        for i in [*edges.tolist(), len(data)]:  # few: a document opens its lists once
            listed[at:i], unsure[at:i] = self.in_list is not False, self.in_list is None
            if i < len(data):
                self.in_list = bool(step[i] == 1) and data[max(0, i - 256) : i].tobytes().rstrip().removesuffix(b":").rstrip().endswith(b'"features"')
            at = i
        first = np.flatnonzero((data == _OPEN) & (step == 1) & (before == 2) & listed)
        last = np.flatnonzero((data == _CLOSE) & (step == -1) & (depth == 2) & listed)
        self.root.append(data[(before <= 1) & (depth <= 1) | (step == 1) & (depth == 2) & (data == _IN)].tobytes())
        at = 0
        for i, begins in sorted([(i, True) for i in first.tolist()] + [(i, False) for i in last.tolist()]):
            if begins:
                at, self.open = i, True
            elif self.open:
                self.held.append(data[at : i + 1].tobytes())
                self._out(True, bool(unsure[i]))
                self.open = False
        if self.open:
            self.held.append(data[at:].tobytes())
        self.inside, self.depth = ends, int(depth[-1])

    def _out(self, ends: bool, unsure: bool) -> None:
        self.rows.append((self.number, ends, unsure, b"".join(self.held).decode()))
        self.held = []
        self.number += 1

    def close(self) -> None:
        if self.open:
            self._out(False, self.in_list is None)
        self.open = False


_FOUND = "file string, block long, number long, ends boolean, unsure boolean, value string"


def _found(batches: Iterator[pd.DataFrame], known: dict[tuple[str, int], tuple[bool, int]]) -> Iterator[pd.DataFrame]:
    """file, block, number (in the range), ends, unsure, value; number -2: the text of the document's own level, and whether its list is open at the end
    (``ends``; null: as it was at the start)."""
    reader, at = None, None

    def out(last: bool) -> pd.DataFrame:
        rows = list(reader.rows)
        if last:
            reader.close()
            rows = [*reader.rows, (-2, reader.in_list, False, b"".join(reader.root).decode(errors="replace"))]
        reader.rows = []
        return pd.DataFrame(rows, columns=["number", "ends", "unsure", "value"]).assign(file=at[0], block=at[1])[["file", "block", "number", "ends", "unsure", "value"]]

    for key, data in _ranges(batches):
        if key != at:
            if reader:
                yield out(True)
            if key not in known:
                raise RuntimeError("the ranges of the files changed between two passes; read them again")
            reader, at = _Reader(*known[key]), key
        reader.feed(data)
        if len(reader.rows) > 2000:
            yield out(False)
    if reader:
        yield out(True)


def collection_texts(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features (file, seq, esri, value) of the collections, and files without a list of features (file, seq).

    ``seq`` numbers features through all files, by path and place; a file without a list counts one.
    """
    # a row for each range: the size of the input over that of a range, as many as Spark's own list of splits
    known = {(r.file, r.block): (r.inside, r.depth) for r in starts(spark, paths).collect()}
    sent = spark.sparkContext.broadcast(known)
    rows = kept(_pieces(spark, paths).mapInPandas(lambda batches: _found(batches, sent.value), _FOUND), "found")
    by_file = Window.partitionBy("file").orderBy("block")
    root = rows.where("number = -2").select("file", "block", "value", F.coalesce(F.last("ends", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("open_before"))
    root = kept(root, "ranges")
    files = root.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "").alias("root"), F.min("block").alias("head"))
    kinds = files.select("file", "head", F.regexp_extract("root", r'"type"\s*:\s*"(\w+)"', 1).alias("kind"), F.col("root").rlike(r'"features"\s*:\s*\[').alias("listed"))
    kinds = kinds.withColumn("listed", F.col("listed") & F.col("kind").isin("", "FeatureCollection"))
    sure = rows.where("number >= -1").join(F.broadcast(root.select("file", "block", "open_before")), ["file", "block"]).where("open_before or not unsure").drop("open_before")
    counts = sure.where("number >= 0").groupBy("file", "block").agg(F.count("*").alias("n"))
    counted = root.select("file", "block").join(counts, ["file", "block"], "left").join(kinds, "file")
    n = F.when(F.col("listed"), F.coalesce("n", F.lit(0))).otherwise((F.col("block") == F.col("head")).cast("long"))
    before = F.coalesce(F.sum(n).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = kept(counted.select("file", "block", "kind", "listed", before.alias("before")), "counted")
    placed = sure.join(F.broadcast(counted.where("listed").select("file", "block", (F.col("kind") == "").alias("esri"), "before")), ["file", "block"])
    # the rest of a feature that began in a range before belongs to the last that did
    numbered = placed.withColumn("seq", F.col("before") + F.col("number"))
    whole = numbered.where("number >= 0 and ends").select("file", "seq", "esri", "value")
    cut = numbered.where("number < 0 or not ends").groupBy("file", "seq", "esri").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"))
    texts = whole.unionByName(cut.select("file", "seq", "esri", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))
    single = counted.where("not listed").groupBy("file").agg(F.min("before").alias("seq"))
    return texts, single
