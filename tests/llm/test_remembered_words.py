"""Ids of words that came before are not made again."""

import numpy as np
import public_tokenizers

from waymark.llm import tokens


def test_remembered_stems_are_not_encoded_again():
    library = tokens.JsonCodec(public_tokenizers.path("word_bpe_49k.json"))
    library.whole(["some thorhaen words"])
    asked, plain = [], library.plain

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    library.plain = Counted()
    text = "Thorhaen words, Words other THORHAEN!"
    found = library.whole([text])[0]
    assert asked == ["other"]
    assert np.array_equal(found, library.library.encode(text, add_special_tokens=False).ids)


def test_more_words_are_remembered_on_demand():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(a, a + 50)) for a in (0, 25, 50, 0)]
    learned = []
    for most in (10, 1000):
        library = tokens.codec(path, most)
        library.young, library.old, n, own = {"": b""}, {}, [0], library._learned
        library._learned = lambda words, n=n, own=own: (n.__setitem__(0, n[0] + len(words)), own(words))[1]
        found = [library.whole([x])[0] for x in texts]
        del library._learned
        learned.append(n[0])
        assert all(np.array_equal(a, library.library.encode(x, add_special_tokens=False).ids) for a, x in zip(found, texts, strict=True))
    assert learned[1] == 100 < learned[0]


def test_packing_gets_few_whole_texts_at_once(spark, monkeypatch):
    from waymark.llm import packing

    kept, batches = packing.materialise, []
    monkeypatch.setattr(packing, "materialise", lambda df, label, batch=None: (batches.append(batch), kept(df, label, batch))[1])
    docs = spark.createDataFrame([(i, "a b c") for i in range(5)], "doc_id long, text string")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 5
    assert batches[0] is not None and batches[0] <= 1000
