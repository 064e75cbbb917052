"""A block of the index holds a few bytes a word while it is built."""

import random
import tracemalloc

from waymark.llm import decontamination as D


def test_words_without_postings_cost_few_bytes():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(400)) for _ in range(500)]
    tracemalloc.start()
    blocks = list(D._blocks(((str(i), x, i) for i, x in enumerate(texts)), {"w1": 0}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 1 and peak < 45 * 400 * 500  # words held as text are over 60
