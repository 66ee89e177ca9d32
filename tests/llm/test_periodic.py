"""Periodic runs against a scan of all periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalis.llm import periodic


def plain_runs(w, least=6, repeats=4):
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, repeats * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def drawn(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(90))]
    if rng.random() < 0.7:
        p = [rng.randrange(9) for _ in range(rng.randrange(1, 15))]
        w += p * rng.randrange(1, 9) + p[:rng.randrange(len(p) + 1)]
    return [str(x) for x in (w + w[-rng.randrange(1, 30):] * rng.randrange(5) if rng.random() < 0.5 else w)]


@pytest.mark.parametrize("least,repeats", [(6, 4), (2, 2), (9, 3)])
def test_runs_of_many_texts(least, repeats):
    rng = random.Random(least)
    for _ in range(120):
        texts = [drawn(rng) for _ in range(rng.randrange(1, 6))]
        runs, sizes, rest = periodic._some([" ".join(w).encode() for w in texts], least, repeats)
        for w, r, n, c in zip(texts, runs.to_pylist(), sizes, rest, strict=True):
            want = plain_runs(w, least, repeats)
            assert [tuple(x.values()) for x in r] == want and n == len(w) and c == collapsed(w, want)


def test_extensions_of_the_grammar():
    rng = random.Random(3)
    for kinds in (1, 2, 5):
        s = [rng.randrange(kinds) for _ in range(150)] * 2 + [rng.randrange(kinds) for _ in range(40)]
        symbols = np.array([-1, *s, -2, *s[:60], -3])
        grammar = periodic.Grammar(symbols)
        pairs = [(rng.randrange(len(symbols)), rng.randrange(len(symbols))) for _ in range(600)]
        i, j = np.array([p for p in pairs if p[0] != p[1]]).T
        for step in (1, -1):
            got = grammar.extensions(i, j, step).tolist()
            for a, b, g in zip(i, j, got, strict=True):
                k = 0
                while symbols[a + step * k] == symbols[b + step * k]:
                    k += 1
                assert g == k


def test_documents(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(drawn(rng))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b c   é " * 30), (None, "x y " * 9), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    changed = df.withColumn("text", periodic.with_repeats(F.col("text"), F.col("doc_id")))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(changed).collect())
    want = []
    for k, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        h = zlib.crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        runs = plain_runs(w)
        want.append((str(k), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want) and sum(len(x[2]) for x in want) > 50


def test_nothing_and_very_long_texts(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(5)
    period = [f"w{rng.randrange(10**6)}" for _ in range(3_000)]
    texts = ["same " * 400_000, " ".join(period * 60), " ".join(f"w{rng.randrange(10**6)}" for _ in range(250_000))]
    began = time.time()
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 400_000, 1)] and got[0].collapsed == "same"
    assert [tuple(x) for x in got[1].runs] == [(0, 180_000, 3_000)] and got[1].collapsed == " ".join(period)
    assert got[2].runs == [] and got[2].collapsed == texts[2] and time.time() - began < 150


def test_digests_of_the_query(spark, tmp_path):
    spark.createDataFrame([(5, "a b " * 5 + "c"), (7, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = periodic.op11_periodic_runs(spark, str(tmp_path)).orderBy("doc_id").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert tuple(a) == (5, 1, 0, 10, 2, 5000, digest("0,10,2\n"), digest("a b c"))
    assert tuple(b) == (7, 0, None, None, None, None, digest(""), digest(""))
