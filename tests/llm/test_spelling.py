"""Spelling variants against all pairs of words."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curalis.llm import spelling


def plain_near(a, b):
    """Whether one inserted, deleted or replaced letter makes a into b."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words, ratio=5):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and plain_near(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(x, key=lambda o: (-words[o], o), default=None) for w, x in near.items()}
    form = {w: b if b is not None and words[b] >= ratio * words[w] and words[b] > words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def made(rng, count, letters="aàbcdeéÿ"):
    out = {"".join(rng.choices(letters, k=rng.randrange(3, 8))): rng.choice([5, 5, 6, 25, 30, 150, 900]) for _ in range(count)}
    return out | {"x" * 80: 5, "x" * 79 + "y": 40, "x" * 81: 300, "y" + "x" * 79: 5, "\U0001d4b3abc": 7, "\U0001d4b4abc": 70, "": 3, "a": 2}


@pytest.mark.parametrize("settings", [{}, {"shard": 20}, {"shard": 3, "groups": 3}, {"groups": 1, "shard": 50}])
def test_all_pairs(spark, settings):
    words = made(random.Random(4), 350)
    rows = [(w, n, "x") for w, n in words.items()] + [(None, 9, "x"), ("null", None, "x")]
    words["null"] = 0
    df = spark.createDataFrame(rows, "word string, n long, root string").repartition(3)
    got = {tuple(r) for r in spelling.spelling_variants(df, **settings).collect()}
    assert got == plain(words)


def test_a_leaf_of_many_words(spark):
    words = {"".join(p): 5 + k for k, p in enumerate(itertools.permutations("abcdef"))} | {"".join(p): 9 for p in itertools.permutations("abcdeg")}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in spelling.spelling_variants(df, shard=100, ratio=1).select("word", "n", "n_near").collect()}
    assert got == {(w, n, 1) for w, n in words.items()}


def test_each_pair_from_one_side():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 6))) for _ in range(250)})
    group_of = spelling.letter_groups(list("abcd"), 3)
    a, b = spelling.near_pairs(words, words, group_of, 3)
    found = sorted(tuple(sorted((words[i], words[j]))) for i, j in zip(a, b, strict=True))
    assert found == sorted(p for p in itertools.combinations(words, 2) if plain_near(*p))


def test_corpus_words(spark):
    rng = random.Random(5)
    stock = ["straße", "Élan", "ÉLAN", "naïve", "façade", "words", "œuvre", "don't", "x×y÷z", "Letters", "ÀÉÎÕÜ", "LETTERS"]
    rows = [(i, " ".join(rng.choices(stock, k=60)), "w") for i in range(40)] + [(None, "Letters", "w"), (3, None, "w"), (4, "", "w"), (4, "Letters", "w"), (4, "Letters", "w")]
    rows += [(900, "megabyte " * 150_000 + "z" * 500_000, "w")]
    want = Counter()
    for k, t, _ in rows:
        letters = "".join(c if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ" else " " for c in t or "")
        for w in letters.split():
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'null' if k is None else k}:{w}".encode())
            if h % 7 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += len(w) >= 6
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumn("n", F.lit(1)).repartition(4)
    got = {r.word: r.n for r in spelling.corpus_words(df, damage=7).collect()}
    assert got == {w: n for w, n in want.items() if n}


def test_of_nothing(spark):
    none = spelling.corpus_words(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and spelling.spelling_variants(none).count() == 0
