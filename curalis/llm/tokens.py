"""Public tokenizers inside tasks: cached per white-space chunk, results equal to encoding whole texts."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import regex

CACHE_WORDS = 400_000
CACHE_BYTES = 48 << 20


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; a path that exists is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_bpe(name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level BPE encoding and the byte length of each id."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return encoding, lengths


@functools.cache
def piece_bpe(name: str = "piece_bpe_32k.model"):
    """A sentence-piece model and, per id, whether it is a byte-fallback piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


class WordEndBpe:
    """Ids of a lower-casing BPE with word ends, as little-endian uint32 bytes.

    Its pre-tokens never cross white space, so a text is the sequence of its white-space chunks;
    each chunk is encoded once and kept. Texts with characters outside Latin, control characters
    that libraries class differently, or special-token strings are encoded whole instead.
    """

    _odd = regex.compile(r"[^\x00-\x1b\x20-ɏ]|<\|")
    _pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, name: str = "word_bpe_49k.json"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        words = [len(self._pre.findall(x)) for x in chunks]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != sum(words):
            found = [self.whole(x) for x in chunks]
        else:
            at = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(words)])] * 4
            raw = ids.tobytes()
            found = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.cache.update(zip(chunks, found, strict=True))
        self.held += sum(map(len, found)) + sum(map(len, chunks))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        split = [None if x and self._odd.search(x) else (x or "").lower().split() for x in texts]
        missing: set[str] = set()
        for chunks in split:
            if chunks:
                missing.update(chunks)
        missing.difference_update(self.cache)
        if missing:
            # a word and the mark after it are separate pre-tokens: only the word needs encoding
            marked = [x for x in missing if x[-1] in ",." and x[:-1].isalpha()]
            missing.difference_update(marked)
            missing.update(x[:-1] for x in marked if x[:-1] not in self.cache)
            missing.update(x for x in ",." if x not in self.cache)
            self._learn(sorted(missing))
            self.cache.update((x, self.cache[x[:-1]] + self.cache[x[-1]]) for x in marked)
        get = self.cache.__getitem__
        return [self.whole(x) if chunks is None else b"".join(map(get, chunks))
                for x, chunks in zip(texts, split, strict=True)]


@functools.cache
def word_end_bpe(name: str = "word_bpe_49k.json") -> WordEndBpe:
    """One cached encoder for each Python worker."""
    return WordEndBpe(name)
