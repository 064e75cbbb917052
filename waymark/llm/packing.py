"""Best-fit packing of token sequences by linear grouping.

The plan is made on the driver from the histogram of lengths alone: at most ``capacity`` rows, whatever the size of
the corpus. Everything in it is run-length coded (``n`` bins that look alike), so its size depends on the number of
different lengths, not on the number of documents. Executors then place each piece by its rank among the pieces
of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import give_back, groups_of, materialise
from .tokens import REMEMBERED, codec, encoded


#: Whole texts that Python gets at once.
TEXTS = 1000


@dataclass
class Plan:
    """Where the pieces of each length go: a piece of ``length`` with rank in [lo, hi) goes to sequence
    ``base + (rank - lo) // each``, at offset ``at + (rank - lo) % each * length``."""

    length: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    sequences: int = 0

    def put(self, length: int, lo: int, n: int, base: int, each: int, at: int) -> None:
        if n:
            for to, x in zip((self.length, self.lo, self.hi, self.base, self.each, self.at), (length, lo, lo + n, base, each, at), strict=True):
                to.append(int(x))

    def arrays(self) -> dict[str, np.ndarray]:
        order = np.lexsort((self.lo, self.length))
        return {k: np.array(getattr(self, k), np.int64)[order] for k in ("length", "lo", "hi", "base", "each", "at")}


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, in plain array steps: threads of a linear algebra library, which may
    wait for each other for minutes beside a busy JVM, never start."""
    k = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(k)])
    for i in range(k):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        if pivot != i:
            work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, k:]


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (rows: how many of each size) and how often to use each, by column generation.

    A linear programme over all sets of sizes that fit: the basis starts with sequences of one size; a knapsack
    over the dual prices finds the next configuration worth using, until none is.
    """
    k = len(sizes)
    basis = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    inverse = _inverse(basis)
    for step in range(most):
        if step % 50 == 49:
            inverse = _inverse(basis)
        price = inverse.sum(0)
        # best value at each fill with one item more a round; few sizes fit, so rounds are few
        best, rounds = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            now, pick = best.copy(), np.full(capacity + 1, -1)
            for i in np.flatnonzero(price > 1e-12):
                s = sizes[i]
                value = best[: capacity + 1 - s] + price[i]
                better = value > now[s:] + 1e-12
                now[s:][better] = value[better]
                pick[s:][better] = i
            rounds.append(pick)
            if (pick < 0).all():
                break
            best = now
        if best[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(k), capacity
        for pick in reversed(rounds):
            if pick[left] >= 0:
                column[pick[left]] += 1
                left -= sizes[pick[left]]
        use, d = (inverse * demand).sum(1), (inverse * column).sum(1)
        ratio = np.where(d > 1e-9, np.maximum(use, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / d[out]
        inverse = inverse - d[:, None] * row
        inverse[out] = row
    return np.rint(basis.T).astype(np.int64), np.maximum((_inverse(basis) * demand).sum(1), 0)


#: Groups, and what share of the capacity a large piece has at least: the plan with the fewest sequences is taken.
TRIED = ((48, 8), (128, 3), (24, 4))


def shortest_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, tried: tuple[tuple[int, int], ...] = TRIED) -> Plan:
    """The best of ``plan`` for several group counts and bounds of what is large: few groups leave room that small
    pieces fill, many leave little where there are few small ones."""
    return min((plan(lengths, counts, capacity, groups, capacity // share) for groups, share in tried), key=lambda p: p.sequences)


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int = 48, large: int | None = None) -> Plan:
    """Pack ``counts[i]`` pieces of ``lengths[i]`` (1 to ``capacity``) into few sequences.

    1. Pieces of ``large`` tokens or more (default: an eighth of the capacity), longest first, form ``groups``
       groups of equal cardinality; in each, lengths are rounded up to the longest.
    2. A linear programme over configurations of those few sizes; its solution is rounded down, then up where
       enough pieces are left.
    3. Actual pieces take the places of the rounded ones.
    4. All that is left, longest first, goes where it fits best, or opens a sequence.
    """
    order = np.argsort(-lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    taken, out = np.zeros(len(lengths), np.int64), Plan()
    spaces: list[list[int]] = []  # [room, n, base] of n sequences with as much room
    large = capacity // 8 if large is None else large

    def opened(n: int) -> int:
        out.sequences += n
        return out.sequences - n

    full = lengths == capacity
    for i in np.flatnonzero(full):
        out.put(capacity, 0, counts[i], opened(int(counts[i])), 1, 0)
        taken[i] = counts[i]
    big = np.flatnonzero((lengths >= large) & ~full)
    if len(big):
        # a length belongs to the group in which its middle piece falls, so that groups are runs of lengths
        middle = np.cumsum(counts[big]) - counts[big] / 2
        group = np.minimum((middle * groups / counts[big].sum()).astype(int), groups - 1)
        names = np.unique(group)
        sizes = np.array([lengths[big[group == g]].max() for g in names])
        demand = np.array([counts[big[group == g]].sum() for g in names])
        configurations, use = _configurations(sizes, demand.astype(float), capacity)
        whole = np.floor(use + 1e-6).astype(np.int64)
        left = demand - whole @ configurations
        while (left < 0).any():  # rounding errors of the programme
            p = int(np.flatnonzero((whole > 0) & (configurations[:, left < 0].sum(1) > 0))[0])
            whole[p] -= 1
            left = demand - whole @ configurations
        for p in np.argsort(-(use - whole)):
            more = min((left[configurations[p] > 0] // configurations[p][configurations[p] > 0]).min(initial=1 << 60), 1)
            if use[p] > whole[p] + 0.02 and more > 0:
                whole[p] += 1
                left = left - configurations[p]
        queues = {g: list(big[group == g]) for g in names}
        for configuration, n in zip(configurations, whole, strict=True):
            if not n or not configuration.sum():
                continue
            base, slots = opened(int(n)), []
            for g, many in zip(names, configuration, strict=True):
                for _ in range(many):
                    runs, need = [], int(n)  # (index of a length, first rank, how many)
                    while need:
                        i = queues[g][0]
                        got = min(need, int(counts[i] - taken[i]))
                        runs.append((i, int(taken[i]), got))
                        taken[i] += got
                        need -= got
                        if taken[i] == counts[i]:
                            queues[g].pop(0)
                    slots.append(runs)
            cuts = sorted({0, int(n)}.union(*(np.cumsum([r[2] for r in runs]).tolist() for runs in slots)))
            at = [[0, 0] for _ in slots]  # of each slot: its run, and how far into that
            for a, b in zip(cuts, cuts[1:], strict=False):
                used = 0
                for runs, pointer in zip(slots, at, strict=True):
                    i, first, many = runs[pointer[0]]
                    out.put(lengths[i], first + pointer[1], b - a, base + a, 1, used)
                    used += int(lengths[i])
                    pointer[1] += b - a
                    if pointer[1] == many:
                        pointer[:] = [pointer[0] + 1, 0]
                spaces.append([capacity - used, b - a, base + a])
    rooms: dict[int, list[list[int]]] = {}  # room -> [n, base]
    for room, n, base in spaces:
        rooms.setdefault(room, []).append([n, base])
    for i, size in enumerate(lengths.tolist()):
        need = int(counts[i] - taken[i])
        while need:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                each = capacity // size
                n = -(-need // each)
                rooms.setdefault(capacity, []).append([n, opened(n)])
                continue
            n, base = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // size
            whole_bins = min(n, need // each)
            if whole_bins:
                out.put(size, taken[i], whole_bins * each, base, each, capacity - room)
                rooms.setdefault(room - each * size, []).append([whole_bins, base])
                taken[i] += whole_bins * each
                need -= whole_bins * each
            rest = n - whole_bins
            if rest and 0 < need < each:
                out.put(size, taken[i], need, base + whole_bins, each, capacity - room)
                rooms.setdefault(room - need * size, []).append([1, base + whole_bins])
                taken[i] += need
                need = 0
                rest, whole_bins = rest - 1, whole_bins + 1
            if rest:
                rooms.setdefault(room, []).append([rest, base + whole_bins])
        if 0 in rooms:
            del rooms[0]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves) of every row's tokens, cut at ``capacity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = codec(tokenizer, remembered)
        for batch in batches:
            texts, names = batch["text"].tolist(), batch["doc_id"]
            for a, b in groups_of(texts, 1 << 20):
                rows = []
                for i, found in zip(range(a, b), encoded(library, texts[a:b]), strict=True):
                    found = np.append(found.astype("<u4"), np.array([end_id], "<u4"))
                    for piece, start in enumerate(range(0, len(found), capacity)):
                        part = found[start : start + capacity]
                        rows.append((names.iloc[i], piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int64)] if ids else [])))
                frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])
                yield frame.astype({"doc_id": names.dtype})
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, tried: tuple[tuple[int, int], ...] = TRIED, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A row's tokens are its text's ids and then ``end_id``; only what is longer than ``capacity`` is cut. A null
    text counts as empty (the end id alone). Repeated rows are packed each; a null doc_id is kept. Other columns
    are left aside; an empty table gives an empty table. Pieces of one length are numbered in parts of bounded
    size (the histogram says how many parts a length needs), so that a length that very many documents share is
    no single task. A worker remembers the ids of some ``remembered`` words: more take more memory and less time.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, ids, remembered), "pieces", TEXTS)
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()  # capacity rows at most
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    lengths, counts = np.array([r.length for r in histogram]), np.array([r.n for r in histogram])
    part = max(2048, int(counts.sum()) // 100_000)
    split = spark.createDataFrame([(int(a), int(-(-b // part))) for a, b in zip(lengths, counts)], "length long, parts long")
    dealt = cut.join(F.broadcast(split), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts").cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").collect()  # 100,000 and capacity rows at most
    table = pd.DataFrame(sizes, columns=["length", "part", "n"])
    table["before"] = table.groupby("length")["n"].cumsum() - table["n"]
    before = F.broadcast(spark.createDataFrame(table[["length", "part", "before"]].astype({"part": "int32"})))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(order)).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("row") - 1).drop("row", "before", "part", "parts")
    place = shortest_plan(lengths, counts, capacity, tried).arrays()
    sent = spark.sparkContext.broadcast(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        shift = np.int64(1) << 40
        keys = p["length"] * shift + p["lo"]
        for batch in batches:
            size, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            i = np.searchsorted(keys, size * shift + rank, side="right") - 1
            into = rank - p["lo"][i]
            yield batch.drop(columns="rank").assign(sequence_id=p["base"][i] + into // p["each"][i], offset=p["at"][i] + into % p["each"][i] * size)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<long>, " * ids + "sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each packed sequence, from ``pack(..., ids=True)``; at most one capacity of ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
