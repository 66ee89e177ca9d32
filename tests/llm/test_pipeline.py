"""Each stage of the pipeline against what its operator decides, and the registered SQL."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from curalis.llm import chosen_path, common, quality, registry, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    kept = common.stage(P.quality(spark, docs, DATA), "a")
    assert ids(kept) == ids(quality.quality_rules(docs).where("kept")) and kept.columns == docs.columns
    single = common.stage(P.near_duplicates(spark, kept, DATA), "b")
    assert ids(single) == ids(chosen_path.jaccard_join(kept).where("kept"))
    cut = common.stage(P.repeated_strings(spark, single, DATA), "c")
    lost = {r.doc_id: r for r in suffix_dedup.suffix_dedup(single, length=P.PASSAGE_BYTES).collect()}
    whole = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert (r.text == whole[r.doc_id]) == (lost[r.doc_id].n_removed == 0)
    mixed = common.stage(P.mixing(spark, cut, DATA), "d")
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(cut))
    packed = P.packing(spark, mixed, DATA)
    assert packed.where("start = 0").count() == mixed.count()


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some words that stand alone here and go on for a while more", "en", "s", 1), (2, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("digest", F.lit("clash"))
    for name, step in P.STAGES:
        df = common.stage(step(spark, df, DATA), name)
    assert df.count() <= 1


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    words = [a + b for a in ("st", "wal", "mor", "qui") for b in ("one", "ks", "ning", "ck", "ver")]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    a, b, c = text(90), text(90), text(90)
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, near), (2, b), (2, near), (3, b), (None, b), (None, c), (None, c + " more"), (4, None), (5, None), (4, None), (6, ""), (7, c.upper()), (8, a)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, df.repartition(3), DATA).collect()]
    assert sum(r in got for r in ((1, a), (1, near))) == 1 and (2, near) not in got and (8, a) not in got
    assert (2, b) in got and (3, b) not in got and (None, b) not in got and sum(k is None for k, _ in got) == 1
    assert sorted(k for k, t in got if not t) == [4, 5, 6] and (7, c.upper()) in got and len(got) == 7


def test_planted_passages_go(spark):
    rng = random.Random(3)
    words = [a + b for a in ("st", "wal", "mor", "qui", "ri", "cl") for b in ("one", "ks", "ning", "ck", "ver", "oud", "a", "es")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    planted = [text(51 + k) for k in range(20)]
    rows = []
    for k in range(80):
        body = f"{text(120)}\n{planted[k // 3]}\n{text(90)}" if k < 60 else text(200)
        rows.append((k, body, "en", "s", len(body)))
    got = {r.doc_id: r.text for r in P.repeated_strings(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()}
    assert all(planted[k // 3] not in got[k] and len(got[k]) > 500 for k in range(60))
    assert all(got[k] == rows[k][1] for k in range(60, 80))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = registry.queries()[name](spark, DATA).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    cell = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    key = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(got) == key(want)
