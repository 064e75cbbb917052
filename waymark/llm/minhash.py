"""Near duplicates by min-max hashing: both the least and the greatest value under each permutation make the signature.

A permutation costs one product a shingle and gives two values of the signature, each equal for two sets as often as their
Jaccard similarity says, and together of less variance than two minima. Values are kept as bytes; bands of them
bring sets together, and every link is confirmed on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SMALL, freed, give_back, materialise, salted_join, text_hash
from .graph import Forest, components

#: Permutations (two bytes each) and bytes in a band. Sets at a similarity of 0.85 miss all of the 42 bands with a
#: chance of 2e-9, sets at 0.5 meet in one with a chance of a half.
PERMUTATIONS, ROWS = 126, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Bands whose buckets are settled by their first member before anything else is compared.
FIRST = 8
_FACTORS = np.random.default_rng(11).integers(1 << 62, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a bucket on the two sides of one comparison, and bytes of sets that a task takes with one first member.
LEFT, RIGHT, BYTES = 256, 1024, 4 << 20
#: Bits of a set's parities, and documents and shingles by which ``common`` tells what many texts have.
PARITY, LOOKED, COMMON = 512, 4000, 50_000
FIELDS = ("node", "component", "size", "sig", "fp")
#: Rows that Python gets at once where they hold whole texts or sets, and where they hold a tile's members.
TEXTS, TILES = 1000, 64
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """64-bit hashes of the different word shingles of texts; words that came before are remembered, up to a bound."""

    def __init__(self, words: int = 3, most: int = 300_000):
        self.words, self.most, self.known = words, most, {}

    def __call__(self, text: str) -> np.ndarray:
        """Ascending; of the whole sequence for fewer words; empty for none."""
        import xxhash

        split = text.encode().lower().split()  # bytes: only A-Z are lowered, and only \\x20 \\x09-\\x0D split
        if not split:
            return np.empty(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(split).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
        n, out = min(self.words, len(split)), None
        for i in range(n):
            part = hashes[i : len(hashes) - n + 1 + i]
            out = _mixed(part + _STEP[2] * np.uint64(n)) if out is None else _mixed(out * _STEP[0] + part)
        return np.unique(out)


def signature(hashes: np.ndarray) -> bytes:
    """Least and greatest value of each permutation, a byte of each."""
    low, high = np.full(PERMUTATIONS, (1 << 64) - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(hashes), 256):
        now = hashes[a : a + 256, None] * _FACTORS[None, :]
        low, high = np.minimum(low, now.min(0)), np.maximum(high, now.max(0))
    return ((np.stack([low, high], 1).ravel() >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes()


def _name(hashes: np.ndarray) -> int:
    """A 64-bit name of a set."""
    parts = np.array([np.bitwise_xor.reduce(_mixed(hashes)), hashes.sum(dtype=np.uint64), len(hashes)], np.uint64)
    return int(_mixed(np.array([np.sum(_mixed(parts * _STEP))], np.uint64)).view(np.int64)[0])


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is ``percent`` times the union or more; of ascending sets, exact."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sign(hashes: np.ndarray) -> int:
    """The SimHash of a set: each bit that over half of its hashes have."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def signed(docs: DataFrame, words: int = 3, fingerprints: bool = False) -> DataFrame:
    """doc_id, text_hash, node, size, sig, fp of every row: a name of its set, how many shingles that has, its signature and its SimHash (else 0).

    A null text has no words; then node and size are 0 and the signature empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for batch in batches:
            found = [(_name(h), len(h), signature(h), sign(h) if fingerprints else 0) if len(h) else (0, 0, b"", 0) for h in map(shingles, batch["text"])]
            numbers = {c: np.array([x[i] for x in found], np.int64) for i, c in ((0, "node"), (1, "size"), (3, "fp"))}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "node": numbers["node"], "size": numbers["size"], "sig": [x[2] for x in found], "fp": numbers["fp"]})
        shingles.known.clear()
        give_back()

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    return own.mapInPandas(run, "doc_id long, text_hash long, node long, size long, sig binary, fp long")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int = 3) -> DataFrame:
    """node and its whole set (ascending 64-bit hashes) for ``nodes`` (node, least: the doc_id and text hash of a row that has it).

    Where the nodes are few enough they go to the documents; else whole texts move once.
    """
    wanted = nodes.select("node", F.col("least.doc_id").alias("of_doc"), F.col("least.text_hash").alias("of_hash"))
    if nodes.count() <= SMALL:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingles(x).tobytes() for x in batch["text"]]})
        shingles.known.clear()
        give_back()

    is_it = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (text_hash(F.col("text")) == F.col("of_hash"))
    texts = docs.select("doc_id", "text").where("text is not null").join(wanted, is_it)
    return texts.select("node", "text").mapInPandas(run, "node long, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of those ``pairs`` (first, node) whose whole sets are near.

    The nodes of one first member are dealt out so that a task holds ``BYTES`` of sets or one of them.
    """
    size = sets.select("node", F.octet_length("shingles").alias("bytes"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.col("bytes") / BYTES))
    heads = pairs.groupBy("first").agg(F.count("*").alias("n")).join(size.withColumnRenamed("node", "first"), "first").select("first", parts.alias("parts"))
    heads = materialise(heads, "heads")
    # one row in so many of a first member's pairs needs the number of its parts; few have more than one
    dealt = pairs.join(F.broadcast(heads.where("parts > 1")) if heads.where("parts > 1").count() <= SMALL else heads, "first", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))).drop("parts")
    own = heads.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).withColumn("node", F.col("first"))
    rows = dealt.select("first", "part", "node").unionByName(own.select("first", "part", "node")).join(sets, "node")

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        sets = {n: np.frombuffer(x, "<u8") for n, x in zip(batch["node"].tolist(), batch["shingles"], strict=True)}
        head = sets.pop(int(key[0]), None)
        hit = sorted(n for n, x in sets.items() if near(head, x, percent)) if head is not None else []
        return pd.DataFrame({"u": np.full(len(hit), key[0], np.int64), "v": np.array(hit, np.int64)})

    return rows.groupBy("first", "part").applyInPandas(run, "u long, v long")


def candidates(band: int, left: Mapping, right: Mapping, percent: int, radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of ``left`` and ``right`` that one bucket of ``band`` must compare (columns node, component, size, sig, fp).

    Two of one component are linked already. Sizes must allow the similarity; with ``radius``, fingerprints differ in so many bits at most; and the share of equal bytes
    is no more than six deviations below what the similarity makes. Two that also share a bucket of a band before are compared there.
    """
    a, b = (np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(x["sig"]), 2 * PERMUTATIONS) for x in (left, right))
    (ca, cb), (sa, sb), (fa, fb) = ([np.asarray(x[c], np.int64) for x in (left, right)] for c in ("component", "size", "fp"))
    fa, fb = fa.view(np.uint64), fb.view(np.uint64)
    least = percent / 100
    bound = (least - 6 * (least * (1 - least) / (2 * PERMUTATIONS)) ** 0.5) * 2 * PERMUTATIONS
    out = []
    for i in range(0, len(a), 32):
        part = slice(i, i + 32)
        fits = (ca[part, None] != cb[None, :]) & (100 * np.minimum(sa[part, None], sb[None, :]) >= percent * np.maximum(sa[part, None], sb[None, :]))
        if radius is not None:
            fits &= np.bitwise_count(fa[part, None] ^ fb[None, :]) <= radius
        x, y = np.nonzero(fits)
        for at in range(0, len(x), 1 << 14):
            p, q = x[at : at + (1 << 14)] + i, y[at : at + (1 << 14)]
            same = a[p] == b[q]
            keep = (same.sum(1) >= bound) & ~same[:, : band * ROWS].reshape(len(p), -1, ROWS).all(2).any(1)
            out.append(np.stack([p[keep], q[keep]]))
    both = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
    return both[0], both[1]


def _tiles(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Members dealt to comparisons (key, band, l, r): all of a bucket on the right, those outside its main component on the left too."""
    left = members.where("not main").select("key", "band", "node", F.col("lb").alias("l"), F.explode(F.expr("sequence(0L, rights - 1)")).alias("r"), F.lit(True).alias("on_left"))
    right = members.select("key", "band", "node", F.explode(F.expr("sequence(0L, lefts - 1)")).alias("l"), F.col("rb").alias("r"), F.lit(False).alias("on_left"))
    return left.unionByName(right).join(rows, "node")


def _dealt_tiles(placed: DataFrame, named: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row for each comparison (key, band, l, r), with ``fields`` of its members and the side they are on, in lists.

    Of a bucket only members outside its largest component are held against all others, in blocks.
    """
    at = placed.join(named.select("node", "component"), "node")
    each = at.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = each.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("components > 1")
    buckets = materialise(buckets.select("key", F.col("most.component").alias("main_component"), "n", F.ceil((F.col("n") - F.col("most.n")) / LEFT).alias("lefts"), F.ceil(F.col("n") / RIGHT).alias("rights")), "buckets")
    total = at.count()
    members = salted_join(at, buckets, "key", total)
    members = members.select("key", "band", "node", (F.col("component") == F.col("main_component")).alias("main"), "lefts", "rights", F.pmod(F.xxhash64("node"), "lefts").alias("lb"), F.pmod(F.xxhash64("node", F.lit(1)), "rights").alias("rb"))
    members = materialise(members, "members")
    return _tiles(members, named).groupBy("key", "band", "l", "r").agg(*[F.collect_list(f).alias(f) for f in (*fields, "on_left")])


def _sides(tile: tuple, fields: tuple[str, ...]) -> list[dict]:
    on_left = np.asarray(tile.on_left, bool)
    order = np.argsort(np.asarray(tile.node, np.int64), kind="stable")
    return [{f: np.asarray(getattr(tile, f), object if f in ("sig", "bits") else np.int64)[order[on_left[order] == side]] for f in fields} for side in (True, False)]


def between(placed: DataFrame, named: DataFrame, sets: DataFrame, percent: int, radius: int | None = None) -> DataFrame:
    """(u, v): links between components, from every bucket that holds more than one.

    ``placed`` (key, band, node), ``named`` (node, component, size, sig, fp), ``sets`` (node, shingles).
    Only members outside a bucket's largest component are held against all others, in blocks. A first pass over the signatures
    tells who is in question; then their whole sets are compared.
    """
    columns = ["key", "band", "l", "r"]

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # a row a tile: most are of a few members, and cost no more than their bytes
            out = []
            for tile in batch.itertuples(index=False):
                sides = _sides(tile, FIELDS)
                i, j = candidates(tile.band, *sides, percent, radius)
                for side, hit in zip((True, False), (i, j), strict=True):
                    out += [(tile.key, tile.band, tile.l, tile.r, n, side) for n in sides[1 - side]["node"][np.unique(hit)].tolist()]
            yield pd.DataFrame(out, columns=[*columns, "node", "on_left"])
        give_back()

    schema = "key long, band int, l long, r long, node long, on_left boolean"
    question = materialise(_dealt_tiles(placed, named, FIELDS).mapInPandas(asked, schema), "question", TILES)

    def settled(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node")
        left, right = batch[batch["on_left"]].reset_index(drop=True), batch[~batch["on_left"]].reset_index(drop=True)
        i, j = candidates(int(key[1]), left, right, percent, radius)
        a, b = ([np.frombuffer(x, "<u8") for x in side["shingles"]] for side in (left, right))
        # what a link or a component joins need not be compared again
        names, at = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
        forest, links = Forest(len(names)), []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = int(at[p]), int(at[len(left) + q])
            if forest.root(x) != forest.root(y) and near(a[p], b[q], percent):
                forest.add(np.array([x]), np.array([y]))
                links.append((left["node"][p], right["node"][q]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    whole = question.join(named, "node").join(sets, "node")
    return whole.groupBy(*columns).applyInPandas(settled, "u long, v long")


def _keys() -> Column:
    """(key, band) of each band of ``sig``."""
    each = [F.struct(F.xxhash64(F.lit(k), F.substring("sig", k * ROWS + 1, ROWS)).alias("key"), F.lit(k).alias("band")) for k in range(BANDS)]
    return F.inline(F.array(*each))


def linked_sets(docs: DataFrame, marked: DataFrame, words: int, percent: int, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, least, size, n) of ``marked`` (see ``signed``), and links (u, v) that connect what is near.

    1. Buckets of the bands that hold more than one node. 2. In the first bands, each member against one member of its
    bucket, on whole sets; components of what is linked. 3. In all bands, what lies in one bucket but in different components.
    Buckets of any size are dealt out in blocks. Of the texts, only those in question are read again.
    """
    nodes = marked.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("fp").alias("fp"), F.count("*").alias("n"))
    nodes = materialise(nodes, "nodes")
    rows = nodes.where("size > 0").select("node", _keys())
    shared = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    placed = rows.join(F.broadcast(shared.select("key")), "key") if shared.count() <= SMALL else salted_join(rows, shared, "key", nodes.count() * BANDS)
    placed = materialise(placed.select("key", "band", "node"), "placed")
    open_ = materialise(nodes.join(placed.select("node").distinct(), "node").select("node", "least", "size", "sig", "fp"), "open")
    sets = materialise(sets_of(docs, open_, words), "sets", TEXTS)

    first = placed.where(F.col("band") < FIRST)
    heads = first.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key"), "node")).alias("head"), F.count("*").alias("n")).select("key", F.col("head.node").alias("first"), "n")
    stars = salted_join(first.select("key", "node"), heads, "key", placed.count()).where("first <> node").select("first", "node").distinct()
    links = materialise(confirmed(materialise(stars, "stars"), sets, percent), "links")
    quick = components(links).withColumnRenamed("node", "of_node")
    named = open_.join(quick, F.col("node") == F.col("of_node"), "left").select("node", F.coalesce("component", "node").alias("component"), "size", "sig", "fp")
    named = materialise(named, "named")
    rest = materialise(between(placed, named, sets, percent, radius), "links", TEXTS)
    return nodes.select("node", "least", "size", "n"), links.unionByName(rest)


def common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that several of some ``LOOKED`` texts have, ascending; ``COMMON`` at most. They only order shingles, and leave none out."""
    share = max(1, docs.count() // LOOKED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for batch in batches:
            yield pd.DataFrame({"h": np.concatenate([shingles(x) for x in batch["text"]] or [np.empty(0, np.uint64)]).view(np.int64)})

    looked = docs.select("text").where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    often = looked.mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in often.collect()], np.int64).view(np.uint64))


def prefix(hashes: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set by one order for all (those of ``often`` last): two sets that are near have one of them in common.

    Of near sets, each lacks less of the other than its prefix holds, so that the first shingle that both have is in both prefixes.
    """
    most = len(hashes) + percent * len(hashes) // -100 + 1
    at = np.minimum(np.searchsorted(often, hashes), max(0, len(often) - 1))
    late = often[at] == hashes if len(often) else np.zeros(len(hashes), bool)
    return np.concatenate([hashes[~late], hashes[late]])[:most]


def parities(hashes: np.ndarray) -> bytes:
    """Whether each place holds an odd number of a set's shingles: two sets differ in at least as many shingles as in places."""
    places = (_mixed(hashes) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def differing(left: Mapping, right: Mapping, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``candidates``, but by sizes and ``parities`` alone: no two that are near are passed over."""
    a, b = (np.frombuffer(b"".join(x["bits"]), np.uint64).reshape(len(x["bits"]), PARITY // 64) for x in (left, right))
    (ca, cb), (sa, sb) = ([np.asarray(x[c], np.int64) for x in (left, right)] for c in ("component", "size"))
    out = []
    for i in range(len(a)):
        x = np.nonzero((ca[i] != cb) & (100 * np.minimum(sa[i], sb) >= percent * np.maximum(sa[i], sb)))[0]
        apart = np.bitwise_count(a[i] ^ b[x]).sum(1, dtype=np.int64)
        # of sets at that similarity, what only one has is so much of the sum of both at most
        x = x[(100 + percent) * apart <= (100 - percent) * (sa[i] + sb[x])]
        out.append(np.stack([np.full(len(x), i, np.int64), x]))
    both = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
    return both[0], both[1]


def remaining_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): links between the components of ``links``, whatever bands they share: with those, all that is near is connected.

    Sets that are near share a shingle of their prefixes (see ``prefix``). What shares one, but no component, and is not told apart by sizes
    and parities, is compared on whole sets. No step passes over a link by chance.
    """
    often = common(docs, words)
    found = components(links).withColumnRenamed("node", "of_node")
    named = nodes.where("size > 0").join(found, F.col("node") == F.col("of_node"), "left").select("node", "least", "size", F.coalesce("component", "node").alias("component"))
    wanted = named.select("node", "size", "component", F.col("least.doc_id").alias("of_doc"), F.col("least.text_hash").alias("of_hash"))
    wanted = F.broadcast(wanted) if nodes.count() <= SMALL else wanted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for batch in batches:
            sets = [shingles(x) for x in batch["text"]]
            yield batch.drop(columns="text").assign(bits=[parities(h) for h in sets], keys=[prefix(h, often, percent).view(np.int64) for h in sets])
        shingles.known.clear()
        give_back()

    is_it = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (text_hash(F.col("text")) == F.col("of_hash"))
    texts = docs.select("doc_id", "text").where("text is not null").join(wanted, is_it).select("node", "size", "component", "text")
    once = texts.mapInPandas(run, "node long, size long, component long, bits binary, keys array<long>")
    held = materialise(once, "prefixes", TEXTS)
    rows = held.select("node", "component", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    shared = materialise(shared, "shared")
    placed = rows.join(F.broadcast(shared.select("key")) if shared.count() <= SMALL else shared.select("key"), "key")
    placed = materialise(placed.select("key", F.lit(0).alias("band"), "node"), "placed")
    # repeated rows of a document are one node
    open_ = held.join(placed.select("node").distinct(), "node", "left_semi").select("node", "component", "size", "bits").dropDuplicates(["node"])
    open_ = materialise(open_, "open")
    freed(held, shared)
    fields = ("node", "component", "size", "bits")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for tile in batch.itertuples(index=False):
                left, right = _sides(tile, fields)
                i, j = differing(left, right, percent)
                us.append(np.minimum(left["node"][i], right["node"][j]))
                vs.append(np.maximum(left["node"][i], right["node"][j]))
            yield pd.DataFrame({"first": np.concatenate(us), "node": np.concatenate(vs)}).drop_duplicates()
        give_back()

    # two sets share many shingles, and are compared once
    pairs = materialise(_dealt_tiles(placed, open_, fields).mapInPandas(asked, "first long, node long"), "asked", TILES)
    freed(placed, open_)
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = materialise(nodes.join(pairs.select("node").union(pairs.select("first")).distinct(), "node", "left_semi"), "wanted")
    return materialise(confirmed(pairs, materialise(sets_of(docs, wanted, words), "sets", TEXTS), percent), "links")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows whose sets of shingles have a Jaccard similarity of ``percent`` hundredths or more are linked, and a component is
    named after the smallest doc_id in it; ``kept`` is the row that has it. Rows with one set are one node before any
    comparison, so copies cost nothing. A text of fewer words has one shingle, the whole; null, empty and blank texts have none and
    are linked with nothing. Repeated rows come back each, and are kept or not together; a null doc_id never
    names a component, is null and not kept if alone. A text of any length is read whole. Other columns are left aside; an
    empty table gives an empty table.

    No link is lost but by the chance of missing all bands (see ``linked_sets``).
    """
    marked = materialise(signed(docs, words), "signed", TEXTS)
    nodes, links = linked_sets(docs, marked, words, percent)
    nodes = nodes.where("size > 0")
    found = components(links).withColumnRenamed("node", "of_node")
    all_named = materialise(nodes.join(found, F.col("node") == F.col("of_node"), "left").select("node", F.coalesce("component", "node").alias("component"), F.col("n").alias("rows")), "components")
    # the least doc_id of a node may be null only if all are: nulls take no part in the naming
    named_rows = marked.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = all_named.join(named_rows, "node", "left").groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = materialise(salted_join(all_named.select("node", "component", "rows"), least, "component", nodes.count()).select("node", "component_id", F.col("rows").alias("n")), "ids")
    out = salted_join(marked.where("size > 0").select("doc_id", "node", "size"), ids, "node", marked.count()).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = marked.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
