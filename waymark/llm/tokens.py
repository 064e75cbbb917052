"""Token counts and ids of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``huge`` characters is encoded at once. A longer one is cut into chunks that overlap; each chunk
is encoded with offsets, and neighbours are spliced where both have the same proven boundary. A boundary is
proven where a letter, one space and a letter meet: none of the supported vocabularies has a token that goes on
past it, their splitting looks no further, and normalisation does not join across a space. So what stands left of
it can't change what stands right of it. Where a vocabulary drops white space before its merges, any space is
proven. If neighbours share no such place, the overlap is doubled, until at last the chunk reaches the end of the
text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import groups_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: splits text before the merges of the rank files.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256
#: Words whose ids a worker remembers, in two generations: some 160 bytes each.
REMEMBERED = 60_000


#: Letters that normalisation leaves as they are, but for their case.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGNED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]{1,16})")


#: Proven boundaries: the space of a match.
_PROVEN, _SPACE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])"), re.compile(" ")


class JsonCodec:
    """A ``.json`` file of the tokenizers library."""

    proven = _PROVEN

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        import json

        kind = json.loads(self.library.to_str())
        first = ((kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        added = kind.get("added_tokens") or []
        #: White space is dropped before the merges and no added token holds or eats any: a text's ids are its words' ids.
        self.by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in added)
        if self.by_word:
            self.proven = _SPACE
        #: For stems: which ids end a word, where the merges mark that, and the same merges behind a split at spaces alone.
        self.ending, self.plain, mark = None, None, (kind.get("model") or {}).get("end_of_word_suffix")
        last = ((kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
        if self.by_word and mark and last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex"):
            self.ending = np.zeros(self.library.get_vocab_size(), bool)
            self.ending[[i for x, i in self.library.get_vocab().items() if x.endswith(mark)]] = True
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.remembered = REMEMBERED
        self.signs = {"": b""}
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_word:
            return self._words(texts)
        out = []
        for a, b in groups_of(texts):
            out += [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        return out

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a, b in groups_of(texts, 1 << 20):
            split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts[a:b]]
            if len(self.young) > self.remembered:
                self.old, self.young = self.young, {"": b""}
            new = set().union(*split).difference(self.young)
            again = new & self.old.keys()
            self.young.update((w, self.old[w]) for w in again)
            known = self._learned(new - again)
            self.young.update(known)
            out += [np.frombuffer(b"".join(map(self.young.__getitem__, words)), "<u4") for words in split]
            for w in known:  # a very long word is forgotten at once
                if len(w) > 40:
                    del self.young[w]
        return out

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each of ``words``.

        A word of Latin letters, and a run of ASCII signs or nothing, has the ids of its lowered letters and those of
        the run: the splitting keeps them apart (a contraction has letters after its apostrophe) and the
        normalisation lowers each letter by itself. Many such stems are encoded together, split at spaces alone; each
        ends with the one token that ends a word. A stem that is remembered as a word is not encoded again.
        """
        whole_words, stems, signs, rest = [], [], [], []  # of a word with a stem, each
        for w in words:
            stem, sign = (w[:-1], w[-1]) if w[-1] in ".," else (w, "")
            if not stem.isalpha() and (m := _SIGNED.fullmatch(w)):
                stem, sign = m[1], m[2]
            if self.plain is not None and stem.isalpha() and (stem.isascii() or _LATIN.fullmatch(stem)):
                whole_words.append(w)
                stems.append(stem.lower())
                signs.append(sign)
            else:
                rest.append(w)
        for sign in set(signs) - self.signs.keys():
            self.signs[sign] = np.array(self.library.encode(sign, add_special_tokens=False).ids, "<u4").tobytes()
        unique = set(stems)
        ids = {stem: known[stem] for known in (self.old, self.young) for stem in unique & known.keys()}
        new = list(unique - ids.keys())
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            found = np.concatenate([np.array(e.ids, "<u4") for e in self.plain.encode_batch_fast([" ".join(part[j : j + 128]) for j in range(0, len(part), 128)], add_special_tokens=False)])
            cuts = np.flatnonzero(self.ending[found]) + 1
            if len(cuts) != len(part):
                raise ValueError("a word of the vocabulary ends with other than one token that ends words")
            whole, at = found.tobytes(), 0
            for stem, cut in zip(part, (cuts * 4).tolist(), strict=True):
                ids[stem] = whole[at:cut]
                at = cut
        known = {w: ids[stem] + self.signs[sign] if sign else ids[stem] for w, stem, sign in zip(whole_words, stems, signs, strict=True)}
        if len(self.signs) > 10_000:
            self.signs = {"": b""}
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return known

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.library.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.array([b for _, b in e.offsets], np.int64)


def _characters(text: str, ends: np.ndarray) -> np.ndarray:
    """Offsets in characters of offsets in UTF-8 bytes."""
    starts = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return np.searchsorted(starts, ends)


class PieceCodec:
    """A ``.model`` file of the sentencepiece library."""

    proven = _PROVEN

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for a, b in groups_of(texts) for x in self.library.encode(texts[a:b], num_threads=1)]

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.library.encode(text, return_type="proto").pieces
        return np.array([p.id for p in pieces], np.uint32), _characters(text, np.array([p.end for p in pieces], np.int64))


class RankCodec:
    """A ``.tiktoken`` file of merge ranks; every text is ordinary text."""

    proven = _PROVEN

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("waymark", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.library.encode_ordinary(x), np.uint32) for x in texts]

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library.encode_ordinary(text)
        lengths = np.cumsum([len(x) for x in self.library.decode_tokens_bytes(ids)])
        return np.array(ids, np.uint32), _characters(text, lengths)


_CODECS: dict[str, JsonCodec | PieceCodec | RankCodec] = {}


def codec(path: str, remembered: int = REMEMBERED) -> JsonCodec | PieceCodec | RankCodec:
    """The worker's own codec of a vocabulary file, read once; ``remembered`` words are kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = {".json": JsonCodec, ".model": PieceCodec, ".tiktoken": RankCodec}[os.path.splitext(path)[1]](path)
    _CODECS[path].remembered = remembered
    return _CODECS[path]


def spliced(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of ``text`` from overlapping chunks; the same as those of the text encoded at once."""
    n, out = len(text), []
    start = cut = 0  # where this chunk starts; the proven boundary from which its tokens count
    end = min(n, chunk)
    ids, ends = library.ends(text[:end])
    ends = ends + start
    while end < n:
        width, joined = overlap, None
        while joined is None and end < n:
            begin = max(cut, end - width)
            to = min(n, max(end, begin + chunk))
            ids2, ends2 = library.ends(text[begin:to])
            ends2 = ends2 + begin
            shared = np.intersect1d(ends[(ends > begin) & (ends < end)], ends2[ends2 < end])
            inner = [p for m in library.proven.finditer(text, begin + 1, end - 1) if (p := m.start()) > cut]
            both = shared[np.isin(shared, inner)]
            # of the places that both have, one by the middle: far from either chunk's cut edge
            if len(both):
                joined = int(both[len(both) // 2])
            elif begin <= cut:  # the overlap is as wide as it can be: let this chunk grow instead
                end = min(n, end + (end - start))
                ids, ends = library.ends(text[start:end])
                ends = ends + start
                width = overlap
            else:
                width *= 2
        if joined is None:
            break
        out.append(ids[(ends > cut) & (ends <= joined)] if cut else ids[ends <= joined])
        ids, ends, start, end, cut = ids2, ends2, begin, to, joined
    out.append(ids[ends > cut] if cut else ids)
    return np.concatenate(out)


def encoded(library, texts: list[str], huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Ids of each text: at once, or spliced from chunks where it is longer than ``huge``."""
    small = [i for i, x in enumerate(texts) if len(x) <= huge]
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    for i, ids in zip(small, library.whole([texts[i] for i in small]), strict=True):
        out[i] = ids
    for i in set(range(len(texts))) - set(small):
        out[i] = spliced(library, texts[i], chunk, overlap)
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a vocabulary file that every executor can read. A null text counts as empty (no
    token). Repeated rows are counted each; other columns are left aside, whatever their names. An empty table
    gives an empty table. No shuffle: one pass, and a text is the largest thing held.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = codec(tokenizer)
        for batch in batches:
            texts = batch["text"].tolist()
            tokens, sizes = [], []
            for a, b in groups_of(texts, 1 << 20):
                part = texts[a:b]
                tokens += [len(x) for x in encoded(library, part, huge, chunk, overlap)]
                sizes += [len(x.encode()) for x in part]
            n = np.array(tokens, np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": np.array(sizes, np.int64), "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
