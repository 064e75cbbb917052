"""Removal of repeated byte strings with suffix arrays, over a corpus that no machine holds.

1. In each document, each window of ``length`` bytes is represented by an anchor: the place of the least hash of
   the ``gram``-byte strings in it (the leftmost of equals). Equal windows have equal anchors at equal offsets, so
   windows can only repeat where anchors do. Neighbouring windows with one anchor place form a segment.
2. Segments are reduced by (anchor hash, segment hash), first within each batch and then over all: of equal
   segments the earliest stays and the others are removed whole. No text moves for that, and a passage that very
   many documents share costs one row for each batch.
3. Anchors that differing segments share are contested (the edges of shared passages). Only those segments' texts
   move, to where their anchor is decided; a crowded anchor's segments get longer anchors first. There a suffix array is built by two-stage sorting: suffixes smaller
   than their successors are sorted directly, the others are induced from them by bucket scans. Windows that are
   equal are then neighbours with a common prefix of ``length``; the earliest stays.
4. Each document's removed spans are joined to its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import groups_of, materialise

#: Bytes of segments sorted at once. Segments of an anchor with more are told apart by a
#: longer anchor, and if that still has more, window by window.
BATCH = 1 << 20
_FIRST = -(1 << 63)
_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(4) + _rng.integers(4, size=256, dtype=np.uint64)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f)])) for f in (_FACTOR, _INVERSE)]
    return _POWERS


def _gram_hashes(buffer: bytes, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place, from one running sum."""
    n = len(buffer)
    power, inverse = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[np.frombuffer(buffer, np.uint8)] * power[:n])])
    h = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _FACTOR
    h ^= h >> np.uint64(29)
    return h


def finer(anchor: int, start: int, windows: int, text: bytes, length: int, gram: int) -> list[tuple[int, int, int, bytes]]:
    """(anchor, start, windows, text): a segment's windows by what half of their rest lies left of, or right of, the anchor.

    Every window holds its anchor and at least half of the other bytes on one side; windows that hold them on the left
    (else on the right) get an anchor that is a hash of those too. Equal windows fall on one side, with one anchor.
    """
    import xxhash

    half = (length - gram) // 2
    place = int(np.flatnonzero(_gram_hashes(text[: length], gram).view(np.int64) == anchor)[0])
    left = min(windows, max(0, place - half + 1))  # windows that start ``half`` or more before the anchor
    out = []
    for first, n, side, context in ((0, left, b"l", text[max(0, place - half) : place + gram]), (left, windows - left, b"r", text[place : place + length - half])):
        if n:
            out.append((int(np.uint64(xxhash.xxh3_64_intdigest(side + context)).view(np.int64)), start + first, n, text[first : first + n + length - 1]))
    return out


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of ``texts``: (text, start, windows, anchor hash, segment hash)."""
    import xxhash

    buffer = b"".join(texts)
    n = len(buffer)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = _gram_hashes(buffer, gram)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window's anchor
    windows = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, begin, (windows > 0).astype(np.int32))
    np.add.at(valid, begin + windows, -(windows > 0).astype(np.int32))
    valid = np.cumsum(valid[: len(place)]) > 0
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    new[begin[(windows > 0)]] = True
    starts = np.flatnonzero(new)
    text = np.searchsorted(begin, starts, side="right") - 1
    last = begin + windows  # of each text: after its last window
    ends = np.minimum(np.append(starts[1:], n), last[text])
    digest = xxhash.xxh3_64_intdigest
    segment = np.array([digest(buffer[a:b]) for a, b in zip(starts.tolist(), (ends + length - 1).tolist(), strict=True)], np.uint64)
    return text, starts - begin[text], ends - starts, h[place[starts]].view(np.int64), segment.view(np.int64)


def _runs(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans, with those of one document that touch or overlap made one."""
    order = np.lexsort((start, copy, doc))
    doc, copy, start, end = doc[order], copy[order], start[order], end[order]
    if not len(doc):
        return pd.DataFrame({"doc_id": doc, "copy": copy, "start": start, "end": end})
    head = np.append(True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]))
    owner = np.cumsum(head) - 1
    shift = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1])
    i = np.flatnonzero(new)
    return pd.DataFrame({"doc_id": doc[i], "copy": copy[i], "start": start[i], "end": reach[np.append(i[1:], len(doc)) - 1] - shift[i]})


def suffix_array(buffer: bytes, depth: int) -> np.ndarray:
    """The suffixes of ``buffer`` in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    n = len(buffer)
    t = np.frombuffer(buffer, np.uint8).astype(np.int64)
    # type: smaller than the successor, decided where bytes first differ; the last suffix is larger than the empty one
    differs = np.append(t[:-1] != t[1:], True)
    rises = np.append(t[:-1] < t[1:], False)
    at = np.where(differs, np.arange(n), n)
    smaller = rises[np.minimum.accumulate(at[::-1])[::-1]]
    direct = np.flatnonzero(smaller)
    keys = [buffer[p : p + depth] for p in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else direct
    del keys
    size = np.bincount(t, minlength=257)
    larger = np.bincount(t[~smaller], minlength=257)
    head = np.concatenate([[0], np.cumsum(size)])
    out = np.full(n, -1, np.int64)
    first = t[direct]
    rank = np.arange(len(direct)) - np.searchsorted(first, first)
    out[head[first] + larger[first] + rank] = direct
    fill = head[:257].copy()
    out[fill[t[n - 1]]] = n - 1
    fill[t[n - 1]] += 1

    def induce(part: np.ndarray) -> None:
        """Put the predecessors of ``part``, in its order, at the heads of their buckets."""
        q = part[part > 0] - 1
        q = q[~smaller[q]]
        if len(q):
            c = t[q]
            order = np.argsort(c, kind="stable")
            q, c = q[order], c[order]
            out[fill[c] + np.arange(len(c)) - np.searchsorted(c, c)] = q
            fill[: 256] += np.bincount(c, minlength=256)

    for c in np.flatnonzero(size).tolist():
        done = head[c]
        while done < fill[c]:  # what a scan of this bucket adds to the bucket itself is scanned next
            upto = int(fill[c])
            induce(out[done:upto])
            done = upto
        induce(out[head[c] + larger[c] : head[c + 1]])
    return out


def common_prefixes(buffer: bytes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The common prefixes, in bytes and up to ``most``, of the suffixes at ``a`` and ``b``, eight bytes at a time."""
    padded = np.frombuffer(buffer + bytes(8), np.uint8).astype(np.uint64)
    word = np.zeros(len(buffer) + 1, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(8 * k)
    out, same, end = np.full(len(a), most, np.int64), np.arange(len(a)), len(buffer)
    for k in range(0, most, 8):
        differ = word[np.minimum(a[same] + k, end)] ^ word[np.minimum(b[same] + k, end)]
        other = np.flatnonzero(differ)
        # the bytes below the lowest bit that differs
        low = np.bitwise_count((differ[other] & (~differ[other] + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        out[same[other]] = k + low // 8
        same = same[differ == 0]
    return np.minimum(np.minimum(out, most), end - np.maximum(a, b))


def later_windows(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the windows of ``rows`` (doc_id, copy, start, windows, text) that also start earlier in them."""
    texts, windows = rows["text"].tolist(), rows["windows"].to_numpy(np.int64)
    buffer = b"\0".join(texts) + b"\0"
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])[:-1]])
    owner = np.full(len(buffer), -1, np.int64)
    for i, (a, n) in enumerate(zip(begin.tolist(), windows.tolist(), strict=True)):
        owner[a : a + n] = i
    order = suffix_array(buffer, length)
    order = order[owner[order] >= 0]
    new = np.append(True, common_prefixes(buffer, order[:-1], order[1:], length) < length)[: len(order)]
    group = np.cumsum(new)
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return _runs(*[np.empty(0, np.int64)] * 4)
    i = owner[order]
    doc, copy = rows["doc_id"].to_numpy(np.int64)[i], rows["copy"].to_numpy(np.int64)[i]
    start = rows["start"].to_numpy(np.int64)[i] + order - begin[i]
    by = np.lexsort((start, copy, doc, group))
    later = by[np.append(False, group[by][1:] == group[by][:-1])]
    return _runs(doc[later], copy[later], start[later], start[later] + length)


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 20) -> DataFrame:
    """doc_id, copy, start, end: the bytes of ``docs`` (doc_id, copy, text; no nulls) covered by a later window."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, parts = batch["text"].tolist(), []
            for a, b in groups_of(texts, 1 << 20):
                text, start, windows, anchor, segment = anchors([x.encode() for x in texts[a:b]], length, gram)
                parts.append((text + a, start, windows, anchor, segment))
            text, start, windows, anchor, segment = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, copy = batch["doc_id"].to_numpy(np.int64)[text], batch["copy"].to_numpy(np.int64)[text]
            order = np.lexsort((start, copy, doc, segment, anchor))
            later = np.append(False, (anchor[order][1:] == anchor[order][:-1]) & (segment[order][1:] == segment[order][:-1]))
            i = order[~later]
            yield pd.DataFrame({"doc_id": doc[i], "copy": copy[i], "start": start[i], "end": start[i] + windows[i] + length - 1, "decided": False, "anchor": anchor[i], "segment": segment[i]})
            i = order[later]
            yield _runs(doc[i], copy[i], start[i], start[i] + windows[i] + length - 1).assign(decided=True, anchor=0, segment=0)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by anchor, segment, document, place; of the last anchor: itself, its last segment, and its first row if nothing contests it yet
        known, last, alone = None, None, None
        for batch in batches:
            spans = batch[batch["decided"]]
            rows = batch[~batch["decided"]].reset_index(drop=True)
            if len(spans):
                yield spans.drop(columns="segment")
            if not len(rows):
                continue
            anchor, segment = rows["anchor"].to_numpy(np.int64), rows["segment"].to_numpy(np.int64)
            new_anchor = np.append(known is None or anchor[0] != known, anchor[1:] != anchor[:-1])
            new_segment = new_anchor | np.append(last is None or segment[0] != last, segment[1:] != segment[:-1])
            yield _runs(*(rows.loc[~new_segment, c].to_numpy(np.int64) for c in ("doc_id", "copy", "start", "end"))).assign(decided=True, anchor=0)
            group = np.cumsum(new_anchor)  # 0: goes on from the batch before
            firsts = np.bincount(group, weights=new_segment, minlength=group[-1] + 1)
            contested = new_segment & ((firsts[group] > 1) | (group == 0))
            out = rows[contested].drop(columns="segment")
            if alone is not None and firsts[0]:
                out = pd.concat([alone, out])
                alone = None
            yield out
            if new_anchor.any():
                alone = rows[new_segment & (group == group[-1])].drop(columns="segment") if firsts[group[-1]] == 1 else None
            known, last = anchor[-1], segment[-1]

    keyed = "doc_id long, copy int, start long, end long, decided boolean, anchor long"
    segments = docs.mapInPandas(cut, keyed + ", segment long")
    dealt = segments.repartition(F.when(F.col("decided"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))).sortWithinPartitions("decided", "anchor", "segment", "doc_id", "copy", "start")
    found = materialise(dealt.mapInPandas(reduce, keyed), "segments")
    # an anchor with more than a batch is told apart by a longer one before its segments move
    contested = found.where("not decided")
    size = F.sum(F.col("end") - F.col("start"))
    total = contested.agg(F.coalesce(size, F.lit(0))).first()[0]
    crowded = contested.groupBy("anchor").agg(size.alias("size")).where(F.col("size") > max(BATCH // 4, total // 100_000)).select("anchor", F.lit(True).alias("crowded"))
    told = contested.join(F.broadcast(crowded), "anchor", "left")  # 100,000 rows at most
    lists = told.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "start", "end", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("parts"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in groups_of(batch["text"].tolist(), 1 << 20):
                rows = []
                for doc, copy, text, parts in batch[["doc_id", "copy", "text", "parts"]].iloc[a:b].itertuples(index=False):
                    data = text.encode()
                    for p in parts:
                        part, windows = data[p["start"] : p["end"]], p["end"] - p["start"] - length + 1
                        if p["crowded"]:
                            rows += [(doc, copy, s, n, k, t, -1, True) for k, s, n, t in finer(p["anchor"], p["start"], windows, part, length, gram)]
                        else:
                            rows.append((doc, copy, p["start"], windows, p["anchor"], part, -1, False))
                frame = pd.DataFrame(rows, columns=["doc_id", "copy", "start", "windows", "anchor", "text", "end", "fine"])
                # of equal texts of one longer anchor in a batch the first stays and the others go whole
                fine = frame[frame["fine"]].sort_values(["anchor", "text", "doc_id", "copy", "start"], kind="stable")
                again = fine.duplicated(["anchor", "text"])
                gone = fine[again]
                start = gone["start"].to_numpy(np.int64)
                yield pd.concat([frame[~frame["fine"]], fine[~again]])
                yield _runs(gone["doc_id"].to_numpy(np.int64), gone["copy"].to_numpy(np.int64), start, start + gone["windows"].to_numpy(np.int64) + length - 1).assign(windows=0, anchor=0, text=b"", fine=True)

    moved = materialise(docs.join(lists, ["doc_id", "copy"]).mapInPandas(fetch, "doc_id long, copy int, start long, windows long, anchor long, text binary, end long, fine boolean"), "moved")
    segment = ("doc_id", "copy", "start", "windows", "anchor", "text")

    placed = "doc_id long, copy int, start long, end long, windows long, anchor long, text binary, w1 long, w2 long"

    def settle(level: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spans (end set) of rows that come by anchor and text; of an anchor with too much, finer rows or single windows."""
        import xxhash

        none = {"end": -1, "windows": 0, "anchor": 0, "text": b"", "w1": 0, "w2": 0}
        held: list[pd.DataFrame] = []
        # bytes held, those of the last anchor, that anchor, one that has too much, the last row's anchor and text
        size, group, key, hot, last = 0, 0, None, None, None

        def shaped(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.assign(**{k: v for k, v in none.items() if k not in frame})

        def apart(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for part in range(0, len(rows), 2000):
                out = []
                for doc, copy, start, n, anchor, text in rows[["doc_id", "copy", "start", "windows", "anchor", "text"]].iloc[part : part + 2000].itertuples(index=False):
                    if level == 1:
                        out += [(doc, copy, s, -1, m, k, t, 0, 0) for k, s, m, t in finer(anchor, start, n, text, length, gram)]
                    else:
                        out += [(doc, copy, start + i, -1, 0, 0, b"", *np.frombuffer(xxhash.xxh3_128_digest(text[i : i + length]), np.int64)) for i in range(n)]
                yield pd.DataFrame(out, columns=["doc_id", "copy", "start", "end", "windows", "anchor", "text", "w1", "w2"])

        for batch in batches:
            keys, texts = batch["anchor"].to_numpy(np.int64), batch["text"].tolist()
            # of equal texts of one anchor, the first stays and the others go whole
            again = np.array([(k, t) == (last if i == 0 else (keys[i - 1], texts[i - 1])) for i, (k, t) in enumerate(zip(keys.tolist(), texts, strict=True))], bool)
            last = (keys[-1], texts[-1]) if len(keys) else last
            if again.any():
                gone = batch[again]
                start = gone["start"].to_numpy(np.int64)
                yield shaped(_runs(gone["doc_id"].to_numpy(np.int64), gone["copy"].to_numpy(np.int64), start, start + gone["windows"].to_numpy(np.int64) + length - 1))
                batch, keys = batch[~again], keys[~again]
            upto = np.append(0, np.cumsum([len(x) for x in batch["text"]])).tolist()
            edges, done = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), 0
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True) if len(keys) else ():
                now = int(keys[a])
                if now == hot:
                    yield from apart(batch.iloc[a:b])
                    done = b
                    continue
                if now != key:
                    if size >= BATCH // 2:
                        yield shaped(later_windows(pd.concat([*held, batch.iloc[done:a]], ignore_index=True), length))
                        held, size, done = [], 0, a
                    key, group, hot = now, 0, None
                size, group = size + upto[b] - upto[a], group + upto[b] - upto[a]
                if group > 2 * BATCH:  # one anchor with more than a batch
                    whole = pd.concat([*held, batch.iloc[done:b]], ignore_index=True)
                    yield from apart(whole[whole["anchor"] == now])
                    held, size, hot, done = [whole[whole["anchor"] != now]], size - group, now, b
            held.append(batch.iloc[done:])
        held = [x for x in held if len(x)]
        if held:
            yield shaped(later_windows(pd.concat(held, ignore_index=True), length))

    def settled(rows: DataFrame, level: int) -> DataFrame:
        dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "text", "doc_id", "copy", "start")
        return materialise(dealt.mapInPandas(lambda batches: settle(level, batches), placed), "settled")

    first_level = settled(moved.where("not fine").select(*segment), 1)
    second_level = settled(first_level.where("windows > 0").select(*segment).unionByName(moved.where("fine and end < 0").select(*segment)), 2)
    singles = second_level.where("end < 0")
    first = singles.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "copy", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = singles.join(first, ["w1", "w2"]).where(F.struct("doc_id", "copy", "start") > F.col("first")).select("doc_id", "copy", "start", (F.col("start") + length).alias("end"))
    columns = ["doc_id", "copy", "start", "end"]
    return found.where("decided").select(*columns).unionByName(moved.where("end >= 0").select(*columns)).unionByName(first_level.where("end >= 0").select(*columns)).unionByName(second_level.where("end >= 0").select(*columns)).unionByName(later)


def deduplicated(docs: DataFrame, length: int = 100, gram: int = 20, texts: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with ``texts``, the kept bytes).

    Each byte covered by a string of ``length`` bytes that also starts earlier is removed; strings are of the
    UTF-8 input, and lie within one document. Earlier is: in a smaller doc_id (null is smallest), in an earlier
    row of the same doc_id by text, or in the same row further left. A null text is empty. Other columns are left
    aside; an empty table gives an empty table.
    """
    own = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        own = own.select("doc_id", F.lit(0).alias("copy"), "text")
    else:
        own = own.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1).alias("copy"), "text")
        own = materialise(own, "numbered")
    lists = repeated_spans(own, length, gram).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in batch[["doc_id", "text", "spans"]].itertuples(index=False):
                data, at, kept, n = text.encode(), 0, [], 0
                for s in sorted((x["start"], x["end"]) for x in spans) if spans is not None else ():
                    if s[0] > at or not n:
                        kept.append(data[at : s[0]])
                        n += 1
                    at = max(at, s[1])
                whole = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(whole), n, hashlib.sha256(whole).hexdigest(), *([whole] if texts else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return own.join(lists, ["doc_id", "copy"], "left").mapInPandas(run, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(_FIRST)))
