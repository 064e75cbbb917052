"""The Merkle manifest, the divergence audit and min-max hashing against plain loops, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, SCHEMA
from waymark.llm import divergence, merkle, minhash


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> a Counter of the rows of ``audited``."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha("".join(map(shown, (r[0], r[3], r[2], n, r[1]))))

    def climbed(level):
        ways = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            for k, i in enumerate(at):
                ways[k].append((i & 1, level[i ^ 1]) if i ^ 1 < len(level) else None)
            level, at = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)], [i // 2 for i in at]
        return level[0], ways

    def folded(now, way):
        for step in way:
            now = sha(now if step is None else step[1] + now if step[0] else now + step[1])
        return now

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for k in names}
    climbs = {k: climbed([leaf(r, r[4]) for r in own[k]]) for k in names}
    root, tops = climbed([climbs[k][0] for k in names])
    out = Counter()
    for k, top in zip(names, tops, strict=True):
        for r, way in zip(own[k], climbs[k][1], strict=True):
            whole = way + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            again = folded(leaf(r, r[4] + 1) if hit else leaf(r, r[4]), whole)
            out[r[0], leaf(r, r[4]), climbs[k][0], root, sha("".join(x[1] for x in whole if x)), again, again == root] += 1
    return out


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1, 3), (257, 1, 256, 2, 5), (600,)])
def test_manifest_against_plain_loops(spark, sizes):
    langs = [None, "a", "", "é", "zz"]
    rows = [(i * 5 + k, f"text {i}", langs[k], "s", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r) for r in merkle.audited(frame, merkle.tampered(frame)).collect())
    assert got == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, odd):
    got = merkle.audited(odd, merkle.tampered(odd)).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(ODD)
    assert merkle.audited(odd.limit(0)).count() == 0
    assert all(r.verified for r in merkle.audited(odd).collect())


def test_store_holds_every_node(spark):
    rows = [(i, f"t{i}", "a", "s", 1) for i in range(600)]
    made = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    levels = {r.level: r.n for k in range(made.store.parts) for r in made.store.part(k).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {1: 300, 2: 150, 3: 75, 4: 38, 5: 19, 6: 10, 7: 5, 8: 3, 9: 2, 10: 1}
    row = made.proofs().where("doc_id = 333").first()
    assert merkle.fold(bytes(row["hash"]), row["path"]).hex() == made.root != merkle.fold(b"\0" * 32, row["path"]).hex()


def plain_divergence(rows, least, top):
    word = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups, docs = {}, {}
    for _, text, lang, source, _ in rows:
        found = word.findall((text or "").translate(lower))
        groups.setdefault((lang or "", source or ""), Counter()).update(found)
        docs.setdefault(lang or "", Counter()).update(set(found))
    out = set()
    for lang, n in docs.items():
        kept = [t for t, k in n.items() if k >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        own = {s: c for (x, s), c in groups.items() if x == lang}
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, name, -v, i + 1) for part, rank in (("pair", pairs), ("term", terms)) for i, (v, _, name) in enumerate(rank)}
    return out


@pytest.mark.parametrize(("least", "top"), [(1, 50), (2, 2), (30, 50)])
def test_divergence_against_plain_loops(spark, odd, least, top):
    assert {tuple(r) for r in divergence.audited(odd, least, top).collect()} == plain_divergence(ODD, least, top)
    rng = random.Random(least)
    words = ["alpha", "Beta", "ÇA", "ça", "d-e", "zeta9eta", "q"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["x", "y", None]), rng.choice("abcde"), 0) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r) for r in divergence.audited(frame, least, top).collect()} == plain_divergence(rows, least, top)
    assert divergence.audited(frame.limit(0), least, top).count() == 0


def test_long_texts_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 50)  # closures of the tasks take the constant from the module they import: the size of slices must not matter
    rows = [(i, "alpha Beta " * 400_000, "x", "a", 0) for i in range(2)] + [(2, "gamma", "x", "b", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r) for r in divergence.audited(frame, 1, 50).collect()} == plain_divergence(rows, 1, 50)


def plain_components(rows, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        k = min(3, len(w))
        return {b" ".join(x) for x in zip(*(w[i:] for i in range(k)), strict=False)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    out = Counter()
    for i, r in enumerate(rows):
        name = least.get(root(i))
        out[r[0], len(sets[i]), name, r[0] is not None and r[0] == name] += 1
    return out


def near_texts(n, seed):
    rng, words = random.Random(seed), [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=90) for _ in range(4)]
    rows = []
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 8])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i * 3 % n, " ".join(own), None, None, None))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_minhash_loses_no_link(spark, monkeypatch, small):
    if small:  # many blocks of a bucket, and many parts of a first member
        monkeypatch.setattr(minhash, "LEFT", 4)
        monkeypatch.setattr(minhash, "RIGHT", 16)
        monkeypatch.setattr(minhash, "BYTES", 2000)
        monkeypatch.setattr(minhash, "FIRST", 1)
    rows = near_texts(400, 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame).collect())
    assert got == plain_components(rows, 85)


def test_minhash_of_odd_rows(spark, odd):
    got = Counter(tuple(r) for r in minhash.near_duplicates(odd).collect())
    assert got == plain_components(ODD, 85)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_minhash_on_documents(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs).collect()) == plain_components(rows, 85)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    for both in (50, 200, 380):
        x = rng.integers(1 << 63, size=800 - both, dtype=np.uint64)
        a, b = np.sort(x[:400]), np.sort(x[400 - both :])
        same = np.mean(np.frombuffer(minhash.signature(a), np.uint8) == np.frombuffer(minhash.signature(b), np.uint8))
        assert abs(same - both / (800 - both)) < 0.12
        assert minhash.near(a, b, 85) == (100 * both >= 85 * (800 - both))
