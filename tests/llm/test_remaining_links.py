"""Near copies that no band brings together are found all the same."""

import random

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import minhash, simhash


def edits(seed, texts=25):
    """Texts with edits close to the bound, that share a line with all others."""
    rng = random.Random(seed)
    out, line = [], " ".join(f"license{i}" for i in range(12))
    for _ in range(texts):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 40, 120)))]
        out.append(" ".join(words) + " " + line)
        for _ in range(2):
            copy = list(words)
            for _ in range(max(1, len(copy) // rng.choice((20, 45, 60)))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy) + " " + line)
    return out


def test_no_near_pair_is_passed_over():
    sets = [minhash.Shingles(5)(t) for t in edits(1)]
    often = np.sort(np.unique(np.concatenate(sets))[::3])
    bits = [minhash.parities(s) for s in sets]
    side = {"component": list(range(len(sets))), "size": [len(s) for s in sets], "bits": bits}
    asked = set(zip(*(x.tolist() for x in minhash.differing(side, side, 80)), strict=True))
    hits = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and minhash.near(sets[i], sets[j], 80)]
    assert len(hits) > 20 and len(asked) < len(sets) ** 2 / 2
    for i, j in hits:
        assert (i, j) in asked
        for order in (often, np.empty(0, np.uint64)):
            assert len(np.intersect1d(minhash.prefix(sets[i], order, 80), minhash.prefix(sets[j], order, 80)))


def test_near_copies_do_not_hang_on_bands(spark, monkeypatch):
    texts = edits(2)
    # no two sets share a bucket of a band
    monkeypatch.setattr(minhash, "_keys", lambda: F.inline(F.array(F.struct(F.xxhash64("node").alias("key"), F.lit(0).alias("band")))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.near_copies(docs).collect() if r.keep}
    sets, up = [minhash.Shingles(5)(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if minhash.near(sets[i], sets[j], 80):
                up = [up[j] if x == up[i] else x for x in up] if up[j] < up[i] else [up[i] if x == up[j] else x for x in up]
    assert got == {min(i for i, x in enumerate(up) if x == root) for root in set(up)}
    assert len(got) < len(texts)
