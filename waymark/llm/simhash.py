"""SimHash fingerprints, and the exact components of those that differ in a few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from ._shared import materialise, salted_join
from .graph import Forest, components

#: Fingerprints in one tile at most, and the parts of a fingerprint whose bits are counted apart.
TILE, PARTS = 4096, 4


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    import xxhash

    split = text.encode().lower().split()  # bytes: only A-Z are lowered, and only \x20 \x09-\x0D split
    if not split:
        return 0
    h = xxhash.xxh64_intdigest
    if len(split) <= words:
        return h(b" ".join(split), seed)
    total, step = np.zeros(64, np.int64), 1 << 15
    for a in range(0, len(split) - words + 1, step):
        part = split[a : a + step + words - 1]
        hashes = np.array([h(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(words)))], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(split) - words + 1).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of every row; null text: no words, fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, words, seed) for x in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _counts(fp: Column, parts: int) -> Column:
    """The population counts of the parts of a fingerprint, as the digits of one long to the base 100."""
    width = 64 // parts
    out = F.lit(0).cast("long")
    for i in range(parts):
        out = out * 100 + F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return out.cast("long")


def _steps(parts: int, radius: int) -> list[int]:
    """What to add to a tile's key for the keys after it that are within the radius; 0 for itself."""
    steps = [x for x in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, x)) <= radius]
    return sorted(k for x in steps if (k := sum(d * 100 ** (parts - 1 - i) for i, d in enumerate(x))) >= 0)


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of one tile (b None), or of two, that differ in ``radius`` bits at most."""
    both = a if b is None else np.concatenate([a, b])
    forest, low = Forest(len(both)), 0 if b is None else len(a)
    other = both[low:]
    rows = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, len(a), rows):
        near = np.bitwise_count(a[i : i + rows, None] ^ other[None, :]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + low
        keep = x < y
        x, y = x[keep], y[keep]
        # most rows of a dense tile link to the same few: one link of each row and of each column first
        first = np.unique(np.concatenate([np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1]])) if len(x) else x
        forest.add(x[first], y[first])
        up = np.array([forest.root(k) for k in range(len(both))]) if len(x) > len(first) else forest.up
        rest = up[x] != up[y]
        forest.add(x[rest], y[rest])
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return both[pairs[:, 0]], both[pairs[:, 1]]


def near_links(distinct: DataFrame, radius: int = 2, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(u, v): links between the different fingerprints ``fp`` that differ in ``radius`` bits at most, as a forest in each pair of tiles.

    A tile holds fingerprints whose parts have the same population counts, ``tile`` of them at most (more make
    more blocks of that tile). Two fingerprints within the radius have counts that differ by the radius at most
    in sum, so every other pair of tiles is skipped unread. The pairs left are compared exactly with exclusive-or
    and bit counts. Each pair of tiles keeps a spanning forest of its links: what is connected stays so, and a
    dense tile yields no more links than it has members.
    """
    keyed = distinct.select("fp", _counts(F.col("fp"), parts).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    # with four parts there are 17 ** 4 keys at most, so their sizes can go to every executor
    placed = keyed.join(F.broadcast(sizes) if (64 // parts + 1) ** parts <= 100_000 else sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    tiles = materialise(placed.groupBy("key", "block").agg(F.collect_list("fp").alias("fps")), "tiles")
    # first the names of the pairs of blocks, then their fingerprints: a crowded key's pairs are dealt out by block
    steps = F.array(*[F.lit(x).cast("long") for x in _steps(parts, radius)])
    names = tiles.select("key", "block")
    asked = names.select(F.col("key").alias("a_key"), F.col("block").alias("a_block"), F.explode(steps).alias("step")).withColumn("key", F.col("a_key") + F.col("step"))
    named = asked.join(names.select("key", F.col("block").alias("b_block")), "key").where("step > 0 or a_block <= b_block")
    first = tiles.select(F.col("key").alias("a_key"), F.col("block").alias("a_block"), F.col("fps").alias("a"))
    second = tiles.select("key", F.col("block").alias("b_block"), F.col("fps").alias("b"))
    pairs = named.join(second, ["key", "b_block"]).join(first, ["a_key", "a_block"]).select("a", F.when(F.expr("step = 0 and a_block = b_block"), F.lit(None)).otherwise(F.col("b")).alias("b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch["a"], batch["b"]):
                u, v = linked(np.asarray(a, np.int64).view(np.uint64), None if b is None else np.asarray(b, np.int64).view(np.uint64), radius)
                us.append(u)
                vs.append(v)
            yield pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    return pairs.mapInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Rows with one fingerprint are one node, reduced before any comparison, so a group of copies of any size costs
    one node. Null and empty texts have the fingerprint 0 and link like any other. A component is named after
    the smallest doc_id reachable. Repeated rows come back each; rows with a null doc_id take part in the links
    but never name a component (null if all are null). Other columns are left aside; an empty table gives an
    empty table.
    """
    marked = materialise(fingerprints(docs, words, seed), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = components(near_links(nodes.select("fp"), radius))
    named = materialise(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    size = nodes.count()
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = materialise(salted_join(named.select("fp", "component", F.col("n").alias("rows")), least, "component", size).select("fp", "component_id", F.col("rows").alias("n")), "ids")
    out = salted_join(marked, ids, "fp", marked.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """doc_id, text_hash, keep: for each row of ``docs``, whether it stands for its group of near copies.

    Near copies have word shingles with a Jaccard similarity of ``similarity`` or more; groups are the components
    of such links, and the row with the smallest doc_id (null first, then text hash) stands for its group. Rows with one set
    of shingles are one node before any comparison. The population counts of such copies' fingerprints tell nothing apart, as those differ in
    some ten bits: so what is compared are the tiles of min-max bands (see ``minhash.linked_sets``), members of which are thinned by exclusive-or and
    bit counts (``radius``, five deviations above what the similarity makes) and by their signatures, and then compared on whole sets. What that passes
    over by chance is found after it (``minhash.remaining_links``): no two texts that are near stay in different groups.

    Null texts are empty; texts without words are copies of each other. Rows that repeat an id and text count
    once: the caller drops them by (doc_id, text_hash). A text of any length is read whole. An empty table gives an empty table.
    """
    percent = round(100 * similarity)
    marked = materialise(minhash.signed(docs, words, fingerprints=True), "signed", minhash.TEXTS)
    nodes, links = minhash.linked_sets(docs, marked, words, percent, radius)
    links = materialise(links, "links")
    links = links.unionByName(minhash.remaining_links(docs, nodes, links, words, percent))
    found = components(links).withColumnRenamed("node", "of_node")
    # the rows that stand for their components, by nodes; a row stands if it is one of them, so no row is joined by component
    named = nodes.select("node", "least").join(found, F.col("node") == F.col("of_node"), "left")
    stands = named.groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("of_doc"), F.col("least.text_hash").alias("of_hash"))
    is_it = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash"))
    return marked.select("doc_id", "text_hash").join(stands, is_it, "left").select("doc_id", "text_hash", F.col("of_hash").isNotNull().alias("keep"))
