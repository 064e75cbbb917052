"""A Merkle manifest of a dataset: a store of all nodes, inclusion proofs by coordinate, and their check.

Each row is a leaf; each language is a tree, and the trees' roots are the leaves of one last tree. A node's coordinate
is (tree, level, place). The store is a folder of Parquet files by level, written in parts of ``BITS`` levels, and no
task ever holds more than one block: the 2 ** ``BITS`` nodes below one node of the next part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir

#: Levels that one pass over the store climbs; a block has 2 ** BITS nodes at its lowest level.
BITS = 8
_TOP = "top"
_NODE = "tree string, n long, level int, place long, hash binary"


def fields_hash(*columns: Column) -> Column:
    """sha256, as 32 bytes, of the values: each ``-`` if null, else its UTF-8 byte count, a colon, and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*[x.cast("binary") for x in shown]), 256))


def leaves(docs: DataFrame, n_chars: Column | None = None) -> Column:
    """The leaf of each row of a documents table, as it is or with another ``n_chars``."""
    return fields_hash(docs["doc_id"], docs["source"], docs["lang"], n_chars if n_chars is not None else docs["n_chars"], docs["text"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 within each ``tree``, by ``order``) and ``n`` (the rows of the tree).

    Sorted runs, one for each range of (tree, order), are written first, so that places hang on files and not on
    what an executor remembers. A row's place is its place in its run's part of the tree, and the sizes of the parts before.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    runs = materialise(ranged.select("*", F.shiftright(at, 33).alias("run"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "runs")
    parts = runs.groupBy("run", "tree").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("many").over(by_tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("run", "tree", (before - F.col("first")).alias("shift"), F.sum("many").over(by_tree).alias("n"))
    return runs.join(parts, ["run", "tree"]).withColumn("place", F.col("at") + F.col("shift")).drop("run", "at", "shift")


def _levels(n: int, low: int) -> int:
    """How many levels above ``low`` the tree of n leaves has, ``BITS`` at most."""
    return max(0, min(BITS, (n - 1).bit_length() - low))


def _climb(hashes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, from ``hashes`` upwards."""
    out = [hashes]
    for _ in range(levels):
        now = [x.hex().encode() for x in out[-1]]
        out.append([sha256(b"".join(now[i : i + 2])).digest() for i in range(0, len(now), 2)])
    return out


@dataclass
class Store:
    """Where the nodes are: ``path/part=k/level=j``; part k has levels k * BITS + 1 to (k + 1) * BITS of every tree that has them."""

    spark: SparkSession
    path: str
    leaves: DataFrame  # tree, n, place, hash
    parts: int

    def part(self, k: int) -> DataFrame:
        return self.spark.read.schema(_NODE).parquet(f"{self.path}/part={k}")

    def base(self, k: int) -> DataFrame:
        """tree, n, place, hash of the nodes from which part k climbs."""
        if not k:
            return self.leaves
        return self.part(k - 1).where(F.col("level") == k * BITS).select("tree", "n", "place", "hash")

    def roots(self) -> DataFrame:
        """tree, n, hash of each tree's root."""
        height = F.length(F.bin(F.col("n") - 1))  # for n above 1
        out = self.leaves.where("n = 1").select("tree", "n", "hash")
        for k in range(self.parts):
            ends_here = (F.col("n") > (1 << (k * BITS))) & (F.col("n") <= (1 << ((k + 1) * BITS))) & (F.col("n") > 1)
            out = out.unionByName(self.part(k).where(ends_here & (F.col("place") == 0) & (F.col("level") == height)).select("tree", "n", "hash"))
        return out


def build(leaves: DataFrame, path: str) -> Store:
    """Write the nodes above ``leaves`` (tree, n, place, hash; a written table) to ``path``, a part at a time.

    Each part reads the lowest level's nodes of the part before, in blocks: sorted by place, joined two by two, a last
    node without a partner alone. A tree ends at the level on which it has one node.
    """
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 1
    store = Store(spark, path, leaves, 0)

    def blocks(low: int):  # noqa: ANN202
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            tree, n, block = rows["tree"].iloc[0], int(rows["n"].iloc[0]), int(key[1])
            made = _climb(rows["hash"].tolist(), _levels(n, low))
            out = [(tree, n, low + up, (block << (BITS - up)) + i, x) for up in range(1, len(made)) for i, x in enumerate(made[up])]
            return pd.DataFrame(out, columns=["tree", "n", "level", "place", "hash"])

        return one

    while (most - 1).bit_length() > store.parts * BITS:
        k = store.parts
        base = store.base(k).where(F.col("n") > (1 << (k * BITS)))
        grouped = base.groupBy("tree", F.shiftright("place", BITS).alias("block"))
        grouped.applyInPandas(blocks(k * BITS), _NODE).write.partitionBy("level").parquet(f"{path}/part={k}")
        store.parts += 1
    return store


def _extended(low: int, columns: list[str]):  # noqa: ANN202
    """The part of ``paths`` for one block: its nodes with level ``low`` get their way through it and the path above."""

    def one(nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        own = nodes[nodes["level"] == low].sort_values("place")
        if not len(own):
            return pd.DataFrame(columns=[*columns, "path"])
        rest = list(path["path"].iloc[0])
        levels = _levels(int(own["n"].iloc[0]), low)
        names = {(int(a), int(b)): h.hex() for a, b, h in zip(nodes["level"], nodes["place"], nodes["hash"], strict=True)}
        out = []
        for place in own["place"].tolist():
            way = []
            for up in range(levels):
                at = place >> up
                beside = names.get((low + up, at ^ 1))
                way.append("" if beside is None else ("<" if at & 1 else ">") + beside)
            out.append(way + rest)
        return own[columns].assign(path=out)

    return one


def paths(store: Store, roots: DataFrame) -> DataFrame:
    """The store's leaves (all columns) with ``path``: the siblings from the leaf to what ``roots`` (tree, n, path) adds.

    A merge scan by coordinate, from the top part down: each block's nodes meet the path of the node above the block.
    An entry is ``<`` or ``>`` (the sibling is to the left or right) and the sibling in hex, or empty for a node that
    has none. Blocks bound what a task holds, whatever the size of a tree.
    """
    above = roots.select("tree", "n", F.lit(0).cast("long").alias("block"), "path")
    for k in reversed(range(max(1, store.parts))):
        low, rows = k * BITS, store.base(k).withColumn("level", F.lit(k * BITS))
        if k < store.parts:
            up = store.part(k).select("tree", "n", "level", "place", "hash")
            rows = rows.unionByName(up, allowMissingColumns=True)
        rows = rows.where(F.col("n") > (1 << low) if k else F.lit(True)).withColumn("block", F.shiftright("place", BITS) if k >= store.parts else F.expr(f"shiftright(place, {BITS + low} - level)"))
        payload = [c for c in store.leaves.columns if c not in ("tree", "n", "place", "hash")] if not k else []
        columns = ["tree", "n", "place", "hash", *payload]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

        schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", path array<string>"
        done = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(_extended(low, columns), schema)
        if not k:
            return done
        # a tree that ends below this part passes its path down as it is
        below = above.where(F.col("n") <= (1 << low))
        above = materialise(done.select("tree", "n", F.col("place").alias("block"), "path").unionByName(below), "paths")
    raise AssertionError


def fold(leaf: bytes, path: list[str]) -> bytes:
    """The root that follows from a leaf and its path."""
    now = leaf.hex()
    for step in path:
        now = sha256((now if not step else step[1:] + now if step[0] == "<" else now + step[1:]).encode()).hexdigest()
    return bytes.fromhex(now)


@dataclass
class Manifest:
    """A dataset's trees: ``store`` (one tree for each language) and ``top`` (their roots), each with its leaves."""

    store: Store
    top: Store
    root: str | None  # None for no rows

    def proofs(self) -> DataFrame:
        """The rows the manifest was made of (tree, doc_id, leaf as ``hash``, and what came with them) with subroot and path."""
        heads = paths(self.top, self.top.roots().select("tree", "n", F.array().cast("array<string>").alias("path")))
        sizes = self.store.roots().select("tree", "n")
        named = heads.select(F.col("name").alias("tree"), F.concat("path", F.array(F.lower(F.hex("hash")))).alias("path"))
        found = paths(self.store, materialise(named.join(sizes, "tree"), "roots"))
        return found.select(*self.store.leaves.columns, F.element_at("path", -1).alias("subroot"), F.slice("path", F.lit(1), F.size("path") - 1).alias("path"))

    @property
    def spark(self) -> SparkSession:
        return self.store.spark


def tree_name(lang: Column) -> Column:
    """A tree's name: empty for no language, else ``=`` and the language, so that names sort as languages, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text), in a new folder below the shared one.

    ``altered`` is another n_chars for rows that it isn't null for: their leaf with it goes along as ``other``, for
    tests of proofs. Texts are read once and hashed in the JVM; what moves is a row of some hundred bytes a document.
    """
    spark = docs.sparkSession
    other = F.when(altered.isNotNull(), leaves(docs, altered)) if altered is not None else F.lit(None).cast("binary")
    rows = materialise(docs.select(tree_name(docs["lang"]).alias("tree"), docs["doc_id"].alias("doc_id"), leaves(docs).alias("hash"), other.alias("other")), "leaves")
    own = materialise(numbered(rows, ["doc_id", "hash"]), "numbered")
    folder = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    store = build(own, f"{folder}/trees")
    heads = store.roots().select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), "hash")
    top = build(materialise(numbered(heads, ["name"]), "heads"), f"{folder}/top")
    root = top.roots().first()
    return Manifest(store, top, bytes(root["hash"]).hex() if root else None)


def audited(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf hashes (doc_id, source, lang, n_chars, text); leaves of a language ascend by doc_id (null first; rows
    that share an id by their leaf, so repeated rows stand side by side), and every two nodes make one until one is left.
    The languages' roots, null first, are joined likewise. proof_sha256 hashes the siblings on the way up, and
    folded_root is computed again from the siblings and the leaf, or from that with ``altered`` n_chars where that isn't
    null; verified tells whether it is the root. Nulls in any column hash as ``-``, an empty text as ``0:``; a text of any length is hashed whole.
    Other columns are left aside; an empty table gives an empty table.
    """
    made = manifest(docs, altered)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, leaf, other, way, sub in zip(batch["doc_id"], batch["hash"], batch["other"], batch["path"], batch["subroot"], strict=True):
                proof = sha256("".join(x[1:] for x in way).encode()).hexdigest()
                folded = fold(bytes(leaf if other is None else other), list(way)).hex()
                out.append((name, bytes(leaf).hex(), sub, made_root, proof, folded, folded == made_root))
            frame = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
            yield frame.astype({"doc_id": batch["doc_id"].dtype})

    made_root = made.root
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return made.proofs().select("doc_id", "hash", "other", "path", "subroot").mapInPandas(run, schema)


def tampered(docs: DataFrame) -> Column:
    """n_chars and one more where 7 divides the crc32 of the id as text; null elsewhere, and where n_chars is null."""
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, docs["n_chars"] + 1)


#: The same in SQL: a recursive table of levels, siblings by coordinate, and a fold along each path.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
  concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
  list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)), lambda a, c: list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, c)), 4294967295) AS crc FROM documents),
l AS (SELECT *, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS other FROM d),
p AS (SELECT doc_id, tree, leaf, other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
t AS (SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS left_ FROM p
  UNION ALL SELECT tree, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (left_ + 1) // 2 FROM t WHERE left_ > 1 GROUP BY tree, level, place // 2, left_),
r AS (SELECT tree, hash AS subroot, level AS height FROM t WHERE left_ = 1),
q AS (SELECT row_number() OVER (ORDER BY tree) - 1 AS place, tree, subroot FROM r),
u AS (SELECT 0 AS level, place, subroot AS hash, count(*) OVER () AS left_ FROM q
  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (left_ + 1) // 2 FROM u WHERE left_ > 1 GROUP BY level, place // 2, left_),
s AS (SELECT p.doc_id, p.tree, p.place AS spot, t.level AS step, t.hash AS beside, (p.place >> t.level) & 1 AS side FROM p JOIN t ON t.tree = p.tree AND t.left_ > 1 AND t.place = xor(p.place >> t.level, 1)
  UNION ALL SELECT p.doc_id, p.tree, p.place, r.height + u.level, u.hash, (q.place >> u.level) & 1 FROM p JOIN r ON r.tree = p.tree JOIN q ON q.tree = p.tree JOIN u ON u.left_ > 1 AND u.place = xor(q.place >> u.level, 1)),
h AS (SELECT p.tree, p.place, r.height + (SELECT max(level) FROM u) AS height FROM p JOIN r ON r.tree = p.tree),
f AS (SELECT tree, place, 0 AS step, coalesce(other, leaf) AS hash FROM p
  UNION ALL SELECT f.tree, f.place, f.step + 1, sha256(CASE WHEN s.side IS NULL THEN f.hash WHEN s.side = 1 THEN s.beside || f.hash ELSE f.hash || s.beside END)
  FROM f JOIN h ON h.tree = f.tree AND h.place = f.place AND f.step < h.height LEFT JOIN s ON s.tree = f.tree AND s.spot = f.place AND s.step = f.step),
g AS (SELECT tree, spot, sha256(string_agg(beside, '' ORDER BY step)) AS proof FROM s GROUP BY tree, spot)
SELECT p.doc_id, p.leaf, r.subroot, (SELECT hash FROM u WHERE left_ = 1) AS root, coalesce(g.proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = (SELECT hash FROM u WHERE left_ = 1) AS verified
FROM p JOIN r ON r.tree = p.tree JOIN h ON h.tree = p.tree AND h.place = p.place JOIN f ON f.tree = p.tree AND f.place = p.place AND f.step = h.height LEFT JOIN g ON g.tree = p.tree AND g.spot = p.place
"""
