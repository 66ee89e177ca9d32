"""Texts of megabytes beside short ones, through the operators that have no such test of their own."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from curalis.llm import attribution, chosen_path, mixing, packing, quality, suffix_dedup, tokens


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(12)
    words = [a + b for a in ("st", "wal", "mor", "qui", "ri", "cl", "é") for b in ("one", "ks", "ning", "ck", "ver", "oud", "a", "es")]
    text = lambda n: "".join(rng.choice(words) + str(rng.randrange(900)) + rng.choice([" "] * 12 + ["\n"]) for _ in range(n))
    passage = text(80)
    big = text(130_000) + passage + text(90_000)
    near = big[:-2000] + text(300)
    rows = [(1, big, "en", "s0", 1), (2, near, "en", "s1", 1), (3, passage, "en", "s0", 1), (4, text(20), "en", "s1", 1), (5, None, None, None, None)]
    return {r[0]: r[1] or "" for r in rows}, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_quality_and_links(long_docs):
    texts, df = long_docs
    assert len(texts[1]) > 1_800_000
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for k, t in texts.items():
        words = t.encode().split()
        assert got[k].n_words == len(words) and got[k].word_chars == sum(len(w.decode()) for w in words)
    links = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.jaccard_join(df).collect()}
    assert links == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_packing_and_sections(long_docs):
    texts, df = long_docs
    encoder = tokens.word_end_bpe()
    pieces = {}
    for r in packing.pack(df).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for k, t in texts.items():
        ids = np.append(np.frombuffer(encoder.whole(t), "<u4"), np.uint32(2)).astype("<u4")
        at = 0
        for start, length, crc, whole in sorted(pieces[k]):
            assert start == at and whole == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)
    encoding, _ = tokens.byte_bpe()
    sums = {}
    for r in attribution.section_tokens(df).collect():
        n, end = sums.get(r.doc_id, (0, 0))
        sums[r.doc_id] = n + r.n_tokens, max(end, r.end_char)
    assert sums == {k: (len(encoding.encode_ordinary(t)), len(t)) for k, t in texts.items()}


def test_copies_and_repeated_strings(long_docs):
    texts, df = long_docs
    drawn = {}
    for r in mixing.poisson_mix(df, epochs=3.0).collect():
        assert (r.text or "") == texts[r.doc_id]
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + 1
        assert r.n_copies >= drawn[r.doc_id]
    data = {k: t.encode() for k, t in texts.items()}
    shared = len(data[1][:-2000].decode(errors="ignore").encode())
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    seen, length = {}, 400
    for k, b in data.items():
        for p in range(len(b) - length + 1):
            seen.setdefault(hash(b[p:p + length]), []).append((k, p))
    for k, b in data.items():
        spans = sorted((p, p + length) for places in seen.values() if len(places) > 1 for j, p in places if j == k)
        removed, runs, kept = suffix_dedup.cut_spans(b, spans)
        assert (got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (removed, runs, hashlib.sha256(kept).hexdigest())
    assert got[1].n_removed > 0.99 * shared and got[3].n_removed == len(data[3]) and got[4].n_removed == 0
