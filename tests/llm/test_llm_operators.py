"""The training-data operators against brute force on small inputs, with nulls, empty tables, ties and repeats."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curalis.llm import attribution, chosen_path, common, language, mixing, packing, quality, quantised, suffix_dedup, suffix_sort, tokens, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, h string"
WORDS = "the of and river stone walks under morning light quick brown fox jumps over lazy dogs while seven clouds drift past old towers".split()


def make(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    passage = make(rng, 120)
    for i in range(40):
        text = make(rng, rng.choice([3, 12, 60, 200]))
        if i % 7 == 0:
            text = text + "\n" + passage + "\n" + make(rng, 20)
        out.append([i, text, "en", f"s{i % 3}", len(text), 0, "x"])
    words = out[5][1].split()
    base = make(rng, 150).split()
    for k in range(6):  # near copies
        own = list(base)
        own[20 * k + 3] = "changed"
        out.append([50 + k, " ".join(own), "en", "s0", 1, 0, "x"])
    out += [[60, out[3][1], None, None, 2, 1, None], [61, None, None, "s1", None, None, None], [62, "", "en", "", 0, 0, ""],
            [63, " \n\t ", "de", "s1", 4, 0, "x"], [None, make(rng, 30), None, None, 5, 0, "x"], [64, " ".join(words), "en", "s1", 1, 0, "x"],
            [65, "ab " * 3000, "en", "s2", 9000, 0, "x"], [65, "ab " * 3000, "en", "s2", 9000, 0, "x"]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def brute_quality(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 1000 else set(windows)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_base_counts(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c", "#x $y\n\n#x $y\n z\u00a0q \u2003w", "é ü\vß\f|", "one two three four five six " * 4, "l1\nl1\n \nl1"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("band", F.lit(1))
    got = {r.doc_id: tuple(r)[1:6] for r in quality.quality_rules(df).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_rejects_outside_the_band(spark, docs, empty):
    rng = random.Random(3)
    clean = [(i, make(rng, 80), "en") for i in range(120)]
    odd = [(1000, " ".join("☃" + "ൠ" * 3 + str(i) for i in range(80)), "en"), (1001, make(rng, 80).upper().replace(" ", "!! "), "en")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, _, _ in clean) and not got[1000].kept and not got[1000].base_failed and not got[1001].kept
    assert got[1000].fallback_share > 0
    assert quality.quality_rules(docs).count() == docs.count()
    assert quality.quality_rules(empty).count() == 0


def test_junk_does_not_widen_its_own_band(spark):
    rng = random.Random(13)
    clean = [(1000 * k + i, make(rng, n), "en") for k, n in enumerate((40, 80, 160, 320, 640)) for i in range(120)]
    junk = [(9000 + i, " ".join(w + "###" * (j % 2 == 0) for j, w in enumerate(make(rng, 130).split())), "en") for i in range(50)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[i] for i, _, _ in clean]) > 0.99 and not any(got[i] for i, _, _ in junk)


# 2


def brute_jaccard(rows):
    def of(t):
        w = (t or "").encode().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = [of(r[1]) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), 1 << 60), r[0])
    return sorted((str(r[0]), str(low.get(root(i))), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("settings", [{}, {"bucket": 2, "max_depth": 4}])
def test_jaccard_join(docs, rows, settings):
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in chosen_path.jaccard_join(docs, **settings).collect())
    assert got == brute_jaccard(rows)


def test_jaccard_join_of_nothing(empty):
    assert chosen_path.jaccard_join(empty).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = make(rng, 150).split()
    rows = []
    for i in range(40):
        own = list(base)
        own[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 8)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), bucket=4).collect())
    assert got == brute_jaccard(rows)


def test_pairs_of_exactly_the_similarity():
    for k in range(1, 400):  # 4k shared of 5k in all, and one shared less
        for shared, links in ((4 * k, 2), (4 * k - 1, 0)):
            a, b = np.arange(shared, dtype=np.uint64), np.arange(9 * k - 4 * k, dtype=np.uint64)
            a = np.concatenate([a, np.arange(10 * k, 10 * k + 4 * k - shared, dtype=np.uint64)])
            batch = pa.RecordBatch.from_pydict({"comp": [0, 0], "b1": [0, 0], "b2": [0, 0], "block": [0, 0], "vid": [1, 2], "copies": [1, 1], "tokens": [a.tobytes(), b.tobytes()]})
            assert sum(x or 0 for out in chosen_path._exact(0.8)([batch]) for x in out.column("links").to_pylist()) == links, k


def test_jaccard_join_at_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for k in (3, 6, 7, 8, 9, 11):
        text = make(rng, 4 * k + 4)
        rows += [(2 * k, text), (2 * k + 1, text + " " + make(rng, k))]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_jaccard(rows)


def test_word_hashes_tell_words_apart():
    rng = random.Random(11)
    text = "".join(rng.choice(["ab", "b", "é", "stone", " ", "\n", "\t ", "\x0b", "\u00a0"]) for _ in range(5000)).encode()
    for data in (text, b"", b"  ", b"x", b" x ", b"y" * 300):
        words = data.split()
        for segment in (7, 64, 1 << 20):
            h = chosen_path.word_hashes(data, segment).tolist()
            assert len(h) == len(words) and len(set(zip(h, words))) == len(set(words)) == len(set(h))


def test_small_and_large_buckets_are_held_together():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, (6, 64)).astype("<u2")
    rows = []
    for node in range(60):
        for k in range(rng.integers(1, 25)):
            s = base[rng.integers(6)].copy()
            s[rng.integers(0, 64, rng.integers(0, 40))] = 1
            rows.append((node, 0, 0, int(rng.integers(1 << 40)), s.tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["node", "b1", "b2", "vid", "sketch"])
    edges = {e for out in chosen_path._loose(0.6)(iter([batch.slice(0, 100), batch.slice(100)])) for e in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    label = {r[3]: r[3] for r in rows}
    want = dict(label)
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        for x, y in itertools.combinations(rows, 2):
            if x[0] == y[0] and (np.frombuffer(x[4], "<u2") == np.frombuffer(y[4], "<u2")).mean() >= 0.6:
                want[x[3]] = want[y[3]] = min(want[x[3]], want[y[3]])
        if _ > 3:
            break
    assert label == want


def test_runs_reach_the_recall():
    assert 1 - (1 - chosen_path.survival(6, 0.8)) ** chosen_path.runs_for(0.999) >= 0.999


# 3


def brute_vectors(rows, cosine=0.9):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n = len(rows)
    linked = [[i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
    return {rows[i][0]: (sum(linked[i]), rows[label[i]][0]) for i in range(n)}


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        v = rng.normal(size=16) if i % 3 else rows[i - 1][1] + rng.normal(0, 0.12, 16) if i else rng.normal(size=16)
        rows.append((i, np.array(v)))
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (204, []), (205, [2 * x for x in rows[7][1]]), (206, [1.0, 2.0]), (207, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    for settings in ({}, {"margin": 1.0, "lists": 8, "list_rows": 20}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in quantised.near_duplicates(df, **settings).collect()}
        assert got == brute_vectors(rows)
    assert quantised.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_recall_of_default_probes(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r[0] for r in df.orderBy("vec_id").select("embedding").collect()], float)
    x = np.concatenate([x, x[:300] + np.random.default_rng(2).normal(0, 0.04, (300, x.shape[1]))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum() - len(x))
    got = quantised.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.97 * want > 0


def test_near_vectors_recall_on_hard_pairs(spark):
    """Pairs of a cosine of 0.90 to 0.92 beside a cluster that holds a third of the rows, its own pairs about 0.9: recall against all pairs."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n = 6000
    x = unit(rng.normal(size=(n, 64)))
    x[:n // 3] = unit(x[0] + 0.041 * rng.normal(size=(n // 3, 64)))
    base, noise = x[-1000:], rng.normal(size=(1000, 64))
    noise = unit(noise - (noise * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.9, 0.92, (1000, 1))
    x = np.concatenate([x, cosine * base + np.sqrt(1 - cosine**2) * noise])
    want = (unit(x) @ unit(x).T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for settings in ({}, {"lists": 256}):
        got = np.zeros(len(x), int)
        for r in quantised.near_duplicates(df, **settings).collect():
            got[r.vec_id] = r.n_links
        assert (got <= want).all()
        for part in (slice(0, n // 3), slice(n // 3, None)):
            assert want[part].sum() and got[part].sum() >= 0.95 * want[part].sum()


def test_near_vectors_of_one_vector_and_its_copies(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in quantised.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_lists_grow_with_the_root_of_the_table():
    assert [quantised.lists_for(n) for n in (0, 1, 4096, 60_000, 10**6, 10**12)] == [64, 64, 64, 256, 1024, 4096]
    assert [quantised.margin_for(n) for n in (2, 4, 16, 64, 1024)] == [1.0, 1.0, 0.5, 0.25, 0.0625]


def test_near_vectors_of_ties_and_null_keys(spark):
    a, b = [1.0, 0.0, 0.0], [0.9, math.sqrt(1 - 0.81), 0.0]
    rows = [(None, a), (3, a), (3, a), (5, b), (6, [0.0, 0.0, 1.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in quantised.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.8999999).collect())
    assert got == [("3", 3, "3"), ("3", 3, "3"), ("5", 3, "3"), ("6", 0, "6"), ("None", 3, "3")]


# 4


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language.ByteGru(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.ones((5, 4), bool), np.array([0, 1, 2, 1])
    mask[3:, 1] = False
    _, grad = net.gradients(x, mask, y)
    for k, g in grad.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.p[k][i]
        net.p[k][i] = kept + 1e-3
        up = net.gradients(x, mask, y)[0]
        net.p[k][i] = kept - 1e-3
        down = net.gradients(x, mask, y)[0]
        net.p[k][i] = kept
        assert abs(g[i] - (up - down) / 2e-3) < 1e-3 * max(1, abs(g[i]))


def plain_states(net, data):
    """Class probabilities of one text by the training network, byte by byte from end to end."""
    x, mask = language.columns([data])
    both = np.concatenate([net._forward(x, mask, d)[0] for d in "fb"], axis=2)[:, 0]
    e = np.exp(both @ net.p["v"] + net.p["o"])
    return e / e.sum(axis=1, keepdims=True)


def test_labels_equal_the_trained_network():
    rng = np.random.default_rng(3)
    net = language.ByteGru(3, 5)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 7, 40, 64, 65, 300)]
    whole = language.pooled(net, texts, 512)
    assert np.allclose(whole, [plain_states(net, t).mean(axis=0) for t in texts], atol=1e-5)
    # states forget: windows with bytes beside them come close to reading from end to end
    assert np.abs(language.pooled(net, texts, 64, 32, most=2) - whole).max() < 1e-3
    assert np.allclose(language.pooled(net, texts, 64, 300), whole, atol=1e-5)


def test_language_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, make(rng, 30) if i % 2 else " ".join(w[::-1].upper() for w in make(rng, 30).split()), "ab"[i % 2]) for i in range(300)]
    rows += [(None, make(rng, 20), "b"), (7, rows[7][1], "b"), (7, rows[7][1], "b"), (900, make(rng, 200_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("held_out", F.lit("clash"))
    got = language.identify(df).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (None, 7, 900)} == {"b"}
    assert np.mean([r.lang_pred == "ab"[r.doc_id % 2] for r in got if r.doc_id is not None and r.doc_id < 300]) > 0.98


def test_language_on_held_out(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and len(got) > 150
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)
    odd = df.limit(300).unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "123 !?", "en", "s", 0), (-4, "x" * 5000, None, "s", 0)], df.schema))
    und = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd).where("doc_id < 0").collect()}
    assert und[-1] == und[-2] == und[-3] == ("und", 0.0) and und[-4][0] != "und"
    assert language.identify(empty).count() == 0


# 5 and tokenizers


def test_cached_ids_equal_whole_texts(rows):
    coder = tokens.WordEndBpe()
    odd = ["", "<|endoftext|> hi", "it's 12ab\x1cc don't\x85x\xa0y İ Σ ΑΣ", "ﬁ é", "日本語 テスト", "'ll've '' ''s", "a, b.. c!,", "x" * 300, "é. ü, 1.", None]
    texts = [r[1] for r in rows] + odd
    assert coder.encode(texts) == [coder.whole(t or "") for t in texts]


@pytest.mark.parametrize("settings", [{}, {"window": 64, "open_windows": 2}])
def test_packing_round_trip(docs, rows, empty, settings, monkeypatch):
    if settings:
        monkeypatch.setattr(packing, "FAN_IN", 2)
    window = settings.get("window", 4096)
    coder = tokens.WordEndBpe()
    pieces = packing.pack(docs, **settings).collect()
    want = sorted((str(r[0]), coder.whole(r[1] or "") + (2).to_bytes(4, "little")) for r in rows)
    left = [(k, ids, 0) for k, ids in want]
    for p in sorted(pieces, key=lambda p: p.start):
        at = next(i for i, (k, ids, done) in enumerate(left) if k == str(p.doc_id) and done == p.start and len(ids) == 4 * p.doc_tokens
                  and zlib.crc32(ids[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32)
        left[at] = (*left[at][:2], p.start + p.length)
    assert all(4 * done == len(ids) for _, ids, done in left)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert len(by) <= 1.3 * sum(len(i) // 4 for _, i in want) / window + 1
    assert packing.pack(empty).count() == 0


# 6


def test_section_tokens(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [r[1] for r in rows if r[1] is not None] + ["a\n\nb\n \n  c\r\nd", "é\nü 日\n本 語", "\n", "x\n\n\n\n\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("section", F.lit("clash"))
    for rule in attribution.RULES:
        got = {(r.doc_id, r.section): r.n_tokens for r in attribution.section_tokens(df, rule=rule).collect()}
        want = {}
        for i, text in enumerate(texts):
            cuts = [0, *(k + 1 for k, c in enumerate(text) if c == "\n"), len(text)]
            cuts = sorted(set(cuts))
            spans = [(cuts[k], cuts[k + 1]) for k in range(len(cuts) - 1)] or [(0, 0)]
            want.update({(i, k): 0 for k in range(len(spans))})
            for a, b in whole.encode(text, add_special_tokens=False).offsets:
                held = [max(0, min(b, y) - max(a, x)) for x, y in spans]
                some = [k for k, n in enumerate(held) if n]
                want[i, {"first": some[0], "last": some[-1], "most": held.index(max(held))}[rule]] += 1
        assert got == want
    assert attribution.section_tokens(docs).count() >= docs.count() and attribution.section_tokens(empty).count() == 0


# 7


def test_decoding_and_scores(spark, empty):
    rng = random.Random(6)
    bad = ["stupid", "moron", "worthless", "idiot"]
    texts, labels = [], []
    for i in range(400):
        t, y = make(rng, 40).split(), int(i % 4 == 0)
        if y:
            t[rng.randrange(40)] = rng.choice(bad)
        texts.append((i, " ".join(t)))
        labels.append((i, y))
    hidden = [(1000, make(rng, 30) + " you m0r0n " + make(rng, 5)), (1001, make(rng, 30) + " s t u p i d " + make(rng, 9)), (1002, make(rng, 20) + " idiiiiot"),
              (1003, make(rng, 30)), (1004, None), (1005, ""), (1006, make(rng, 3000)), (None, make(rng, 9)), (1007, "under " * 200_000), (1003, "you idiot"), (1003, "you idiot")]
    df = spark.createDataFrame(texts + hidden, "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = toxicity.toxicity(df, spark.createDataFrame(labels + [(2, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert sorted(r.predicted for r in rows if r.doc_id == 1003) == [0, 1, 1]  # repeated rows are judged each
    got = {r.doc_id: r for r in rows if r.doc_id != 1003}
    assert all(got[i].predicted == 1 for i in (1000, 1001, 1002)) and all(got[i].predicted == 0 for i in (1004, 1005, 1006, 1007, None))
    assert np.mean([got[i].predicted == y for i, y in labels]) > 0.98
    assert got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


@pytest.fixture(scope="module")
def restorer():
    rng = random.Random(7)
    common = "the of and river stone walks under morning light quick brown over lazy dogs seven clouds old towers a class grass pass boss stupid moron idiot scum worthless ass".split()
    counts = np.zeros(toxicity._SIZE**3, np.int64)
    c = np.concatenate([[0, 0], toxicity.letter_codes(" ".join(rng.choice(common) for _ in range(4000))), [0]])
    np.add.at(counts, (c[:-2] * toxicity._SIZE + c[1:-1]) * toxicity._SIZE + c[2:], 1)
    return toxicity.Restorer(toxicity.CharModel(counts))


@pytest.mark.parametrize(("disguised", "words"), [
    ("1d107", "idiot"), ("idi07", "idiot"), ("a55", "ass"), ("a$$", "ass"), ("a$$!", "ass"), ("idiot!", "idiot"), ("#id10t", "idiot"), ("$tup1d!!", "stupid"),
    ("iiddiioott", "idiot"), ("ssttuuppiidd", "stupid"), ("a s c u m", "a scum"), ("i d i o t s c u m", "idiot scum"), ("s t u p i d  m o r o n", "stupid moron"),
    ("s   t   u   p   i   d", "stupid"), ("s.t.u.p.i.d", "stupid"), ("m0r0n", "moron"), ("idiiiot", "idiot")])
def test_disguises(restorer, disguised, words):
    assert set(words.split()) <= restorer.words(f"the river {disguised} walks under") and set(words.split()) <= restorer.words(disguised)


@pytest.mark.parametrize("disguised", ["id" + "i" * 60 + "ot", " ".join("the old stupid towers of the worthless moron and idiot".replace(" ", "")), "s t u p i d  " * 500, "1d10t-" * 500 + "x"])
def test_disguises_of_any_length(restorer, disguised):
    assert restorer.words(disguised) & {"idiot", "stupid", "worthless", "moron"}


def all_readings(span, model, **how):
    """Best score over every path of the lattice, and the texts that reach it."""
    low = span.lower()
    runs = [(c, len(list(g))) for c, g in itertools.groupby(low)]
    doubled = len(runs) > 2 and all(n > 1 for _, n in runs)
    settings = {"breaks": False, "doubles": True} | how
    best = {}
    for path in itertools.product(*toxicity.lattice(runs, settings["breaks"], settings["doubles"], doubled)):
        (i, j), total = (0, 0), 0.0
        for x, cost in path:
            total += cost
            codes = [0 if y == " " else toxicity._CODE.get(y, toxicity._OTHER) for y in x]
            if codes == [0] and not j:
                codes = []
            for k in codes:
                total += model.log[i, j, k]
                i, j = j, k
        text = "".join(x for x, _ in path)
        best[text] = max(best.get(text, -1e9), total + (model.log[i, j, 0] if j else 0.0))
    top = max(best.values())
    return {t for t, v in best.items() if v > top - 1e-9}


def test_viterbi_finds_the_best_of_all_readings(restorer):
    rng = random.Random(12)
    for _ in range(300):
        span = "".join(rng.choice("stupidmoran" + "013457@$!*# .-") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(1, 7)))
        for how in ({}, {"breaks": True}, {"doubles": False}):
            assert toxicity.decode(span, restorer.model, **how) in all_readings(span, restorer.model, **how), (span, how)


def test_known_features_are_those_of_all_words(restorer):
    rng = random.Random(13)
    words = "stupid 1d107 grass m0r0n the_river ssttuuppiidd a$$! s c u m old,towers worthless".split()
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)] + [None, "", "i d i o t"]
    known = {f: 1.0 for f in toxicity.features(restorer.words(" ".join(words))) if rng.random() < 0.6} | {"idiot": 2.0}
    reader = toxicity.KnownFeatures(restorer.model, known)
    for text in texts + texts:
        assert reader.of(text) == {f for f in toxicity.features(restorer.words(text)) if f in known}


def test_doubles_apart_are_decoded_alike(restorer):
    for word in ("sstupid", "idiott", "moroon", "grass", "tootter", "class", "bboss", "aabcc", "scuum"):
        assert toxicity.single(word, restorer.model) == toxicity.decode(word, restorer.model)


# 8


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x?q#z", "HTTP://Example.NET/en", "https://net", "https://x.net/", "http://b.example.com/de/1", "http://example.com/fr/", "http://q.org/fr/",
            "http://org/fr", "nothing", None, "://", "http://evilnet/", "http://a.net?x/", "x://É.net/Q", "http://net:80/", "a://b.net/c://d.org/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: r for r in url_filters.url_filter(df).collect()}
    rules = {0: "example.net/en/", 1: "net/", 2: "", 3: "net/", 4: "example.com/de/", 6: "org/fr/", 13: "net/", 15: "net/"}
    for i in range(len(urls)):
        assert (got[i].rule or "") == rules.get(i, ""), urls[i]
        assert got[i].verdict == ("block" if got[i].rule in ("net/", "example.com/de/") else "allow")
    assert (got[0].host, got[0].path, got[13].host) == ("a.example.net", "/en/x", "É.net") and (got[9].host, got[8].path) == ("", "")
    longer = url_filters.Trie([("block", "a.b", "/x"), ("allow", "a.b", "/x/y/"), ("block", "b", "/")])
    assert [longer.find("z.a.b", p) for p in ("/xyz", "/x/y/z", "/q", "")] == [("a.b/x", "block"), ("a.b/x/y/", "allow"), ("b/", "block"), None]


def test_url_rules_with_many_open_segments(spark):
    rules = [("block", "a.b", f"/a{i}") for i in range(3000)] + [("allow", "a.b", "/a12x")]
    trie = url_filters.Trie(rules)
    for i in (0, 12, 123, 2999):
        assert trie.find("z.a.b", f"/a{i}-q") == (f"a.b/a{i}", "block")
    assert trie.find("a.b", "/a12xy") == ("a.b/a12x", "allow") and trie.find("a.b", "/b") is None
    df = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/"), (2, "http://x.net/" + "a/" * 500_000), (None, "http://y.org/")], "page_id long, url string")
    got = url_filters.url_filter(df).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "block"), ("1", "block"), ("2", "block"), ("None", "allow")]
    assert url_filters.url_filter(df.where("page_id = 9")).count() == 0


# 9


def test_poisson_mix_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 7), (1, "a", 5, 7), (None, None, 1, 1)], "doc_id long, source string, replica int, _cdf int")
    out = mixing.poisson_mix(df)
    assert out.columns == ["doc_id", "source", "replica", "n_copies", "shuffle_key"]
    assert all(1 <= r.replica <= r.n_copies for r in out.collect())


def test_poisson_mix(spark, docs, rows, empty):
    out = mixing.poisson_mix(docs).collect()
    want = {}
    sizes = {}
    for r in rows:
        sizes[r[3] or ""] = sizes.get(r[3] or "", 0) + 1
    w = {s: n**0.7 for s, n in sizes.items()}
    for r in rows:
        rate = len(rows) * w[r[3] or ""] / sum(w.values()) / sizes[r[3] or ""]
        u = (int(hashlib.md5(f"mix-1|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)
        k, p = 0, math.exp(-rate)
        c = p
        while c < u:
            k += 1
            p *= rate / k
            c += p
        want[str(r[0]), r[1]] = want.get((str(r[0]), r[1]), 0) + k
    got = {}
    for r in out:
        got[str(r.doc_id), r.text] = got.get((str(r.doc_id), r.text), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.poisson_mix(empty).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    given = mixing.poisson_mix(many, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")).groupBy("source").count().collect()
    assert {r[0]: round(r[1] / 20000, 1) for r in given} == {"a": 0.8, "b": 0.2} or abs({r[0]: r[1] for r in given}["a"] / 20000 - 0.75) < 0.03


# 10


def brute_repeats(rows, length):
    seen = {}
    data = [(r[1] or "").encode() for r in rows]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] = seen.get(b[p:p + length], 0) + 1
    out = []
    for r, b in zip(rows, data, strict=True):
        spans = [(p, p + length) for p in range(len(b) - length + 1) if seen[b[p:p + length]] > 1]
        removed, runs, kept = suffix_dedup.cut_spans(b, spans)
        out.append((str(r[0]), len(b), removed, runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"length": 60, "gram": 16}, {"length": 60, "gram": 16, "max_group": 2}])
def test_repeated_strings(docs, rows, settings):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, **settings).collect())
    assert got == brute_repeats(rows, settings.get("length", 400))


def brute_passages(rows, n):
    holders = {}
    lists = [(r[1] or "").encode().split() for r in rows]
    windows = [{tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in lists]
    for k, own in enumerate(windows):
        for x in own:
            holders.setdefault(x, set()).add(k)
    return sorted((str(r[0]), any(len(holders[x]) > 1 for x in own)) for r, own in zip(rows, windows, strict=True))


@pytest.mark.parametrize("passage", [5, 50])
def test_passages_of_other_documents(spark, docs, rows, passage):
    got = sorted((str(r.doc_id), r.shares_passage) for r in suffix_dedup.suffix_dedup(docs, passage=passage).collect())
    assert got == brute_passages(rows, passage)
    assert {True, False} == {x for _, x in got}


def test_passages_of_nothing(empty):
    assert suffix_dedup.suffix_dedup(empty, passage=50).count() == 0


def test_passages_under_the_byte_length(spark, tmp_path):
    rng = random.Random(21)
    short = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n)]
    rows = []
    for k in range(60):  # 49 to 52 words, under 260 bytes, between others; white space differs; a passage twice in one text does not count
        shared, n = short(52), 49 + k % 4
        gap = rng.choice(["\n", "  ", "\t"])
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(short(rng.randrange(80))) + gap + (gap if side else " ").join(shared[:n]) + gap + " ".join(short(rng.randrange(80)))))
        rows.append((1000 + k, " ".join([*shared[:20], *short(30), *(own := short(60)), *short(9), *own])))
    want = brute_passages(rows, 50)
    assert 80 < sum(x for _, x in want) <= 90
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = suffix_dedup.op10_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.shares_passage) for r in made) == want
    # strings of 400 bytes, as told by n_removed, are another thing
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made) == brute_repeats(rows, 400)


def test_word_anchors():
    rng = random.Random(3)
    data = b" \n".join(bytes(rng.choices(b"abcd", k=rng.choice([1, 2, 3, 700]))) for _ in range(400)) + b"\t" + b"ab " * 200
    starts, ends = suffix_sort.words(data)
    assert [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == data.split()
    whole, parts = suffix_sort._word_hashes(data, starts, ends), suffix_sort._word_hashes(data, starts, ends, segment=64)
    assert (whole == parts).all() and len(set(whole.tolist())) == len(set(data.split()))
    at, _, v = suffix_sort.word_anchors(data, starts, ends, 50, 8)
    assert all(any(s <= p <= s + 42 for p in at.tolist()) for s in range(len(starts) - 49))
    of = {}
    for p, x in zip(at.tolist(), v.tolist(), strict=True):
        s = min(max(p - 21, 0), len(starts) - 50)
        of.setdefault(tuple(data.split()[s:s + 50]), set()).add(x)
    assert all(len(x) == 1 for x in of.values()) and len({x for y in of.values() for x in y}) == len(of)


def test_repeated_strings_of_nothing(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_sort_and_extents():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 40)
        s = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(n)]
        g = np.sort([rng.randrange(3) for _ in range(n)])
        assert suffix_sort.Texts.of(s).sort(g).tolist() == sorted(range(n), key=lambda i: (g[i], s[i], i))
        top = rng.randrange(3, 12)
        a = [bytes(rng.choices(b"ab", k=rng.randrange(top + 1))) for _ in range(n)]
        b = [bytes(rng.choices(b"ab", k=rng.randrange(top + 1))) for _ in range(n)]
        left, right = suffix_sort.extents(suffix_sort.Texts.of(a, back=True), suffix_sort.Texts.of(b), g, top)
        for k in set(g.tolist()):
            at = np.flatnonzero(g == k)
            x, y = suffix_sort.by_windows([a[i] for i in at], [b[i] for i in at], top)
            assert left[at].tolist() == x.tolist() and right[at].tolist() == y.tolist()


def test_colliding_hashes_are_settled_by_bytes(monkeypatch):
    rng = random.Random(4)
    a, b = ([bytes(rng.choices(b"abcd", k=12)) for _ in range(12)] for _ in range(2))
    a, b = a + a[:3], b + b[:3]
    monkeypatch.setattr(suffix_sort, "VALUES", np.ones(257, np.uint64))  # all strings of one length collide
    left, right = suffix_sort.extents(suffix_sort.Texts.of(a, back=True), suffix_sort.Texts.of(b), np.zeros(15, int), 10)
    x, y = suffix_sort.by_windows(a, b, 10)
    assert left.tolist() == x.tolist() and right.tolist() == y.tolist()


def test_every_window_has_an_anchor():
    rng = random.Random(8)
    data = bytes(rng.choices(b"abcd", k=3000)) + b"a" * 900
    whole = suffix_sort.anchors(data, 100, 16)
    parts = suffix_sort.anchors(data, 100, 16, segment=128)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    at = set(whole[0].tolist())
    assert all(any(p in at for p in range(s, s + 85)) for s in range(len(data) - 99))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 480)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
