"""Probes, scoring in batches, payload files and early stops against plain Python."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalis.functions import arrays as V
from curalis.operators import matching as J
from curalis.operators import probes as P
from curalis.sources import tables as S
from curalis.streaming import ingest as R


def auroc(y, s):
    wins = [(a > b) + (a == b) / 2 for a, i in zip(s, y, strict=True) if i for b, j in zip(s, y, strict=True) if not j]
    return sum(wins) / len(wins)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, i % 2, [round(rng.gauss(i % 2 * 0.8, 1), 2), round(rng.gauss(0, 1), 2), float(i % 2)]) for i in range(90)]
    return data, spark.createDataFrame(data, "id long, y int, x array<double>")


def test_importance_equals_numpy(spark, rows):
    data, df = rows
    names, weights = ["a", "b", "c"], [1.0, 0.5, 0.25]
    moved = P.permutations(df, "id", "x", names, 3, block=25).collect()
    by = {}
    for r in moved:
        by.setdefault((r.feature, r.repeat), {})[r.id] = r.x
    assert len(by) == 10 and by[None, 0] == {i: x for i, _, x in data}
    for (f, _), own in by.items():
        for k, name in enumerate(names):
            column, before = [own[i][k] for i, _, _ in data], [x[k] for _, _, x in data]
            assert sorted(column) == sorted(before) and (column == before) == (f != name)
    score = lambda d: d.withColumn("score", F.round(sum(F.get("x", k) * w for k, w in enumerate(weights)), 6))
    got = {r.feature: (r.mean_drop, r.std_drop) for r in P.permutation_importance(score, df, "id", "x", names, "y", 3).collect()}
    again = {}
    for r in P.permutations(df.select("id", "x", "y"), "id", "x", names, 3).collect():
        again.setdefault((r.feature, r.repeat), {})[r.id] = round(sum(v * w for v, w in zip(r.x, weights, strict=True)), 6)
    y = [l for _, l, _ in data]
    value = {k: auroc(y, [v[i] for i, _, _ in data]) for k, v in again.items()}
    for f in names:
        drops = [value[None, 0] - value[f, k] for k in range(3)]
        assert got[f] == pytest.approx((statistics.fmean(drops), statistics.pstdev(drops)), abs=1e-9)
    assert list(got) == sorted(got, key=lambda f: -got[f][0])


def test_probe_finds_a_shortcut(spark, rows):
    data, df = rows
    score = P.boosted(df, "x", "y", iterations=3, least=5)
    marked = score(df).withColumn("split", F.lit("val")).withColumn("g", F.when(F.col("id") < 40, "one").otherwise("two")).withColumn("s", F.col("y").cast("string"))
    report = {(r.scope, r.name): r for r in P.probe_report(marked, "y", "split", "g", "s").collect()}
    assert set(report) == {("split", "all"), ("generator", "one"), ("generator", "two"), ("source", "0"), ("source", "1")}
    assert report["split", "all"].auroc == 1 and report["split", "all"].n == 90 and report["generator", "one"].n == 45 + 20
    assert report["source", "1"].auroc is None and report["source", "1"].balanced_accuracy == 1


def test_surface_features(spark):
    rng = random.Random(4)
    grid = [rng.random() for _ in range(64)]
    kernels = {"edge": ([[0, 1, 0], [1, -4, 1], [0, 1, 0]], 4)}
    made = P.grid_features(F.col("g"), 8, kernels, V.radial_bands(8, (0.125, 0.25, 0.5))) | P.text_features(F.col("t"))
    r = spark.createDataFrame([(grid, "AB1, x\nAB1, x")], "g array<double>, t string").select(*[c.alias(n) for n, c in made.items()]).first()
    assert r["mean"] == pytest.approx(np.mean(grid)) and r["q50"] == pytest.approx(np.median(grid)) and sum(r[f"bin{k}"] for k in range(8)) == 64
    assert sum(r[f"band{k}"] for k in range(4)) == pytest.approx(1, abs=1e-6) and r["size"] == 13 and r["digits"] == 2 / 13 and r["repeated_lines"] == 0.5


def test_scores_in_whole_batches(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 3 else [float(i), 1.0]) for i in range(57)], "id long, v array<double>").coalesce(1)

    def scorer():
        seen = []

        def score(x):
            seen.append(len(x["v"]))
            return {"s": x["v"].sum(1), "call": [len(seen)] * len(x["v"])}

        return score

    got = {r.id: (r.s, r.call) for r in P.score_batches(df, scorer, ["v"], "s double, call int", ["id"], batch=20).collect()}
    assert got == {i: (None, None) if i % 10 == 3 else (i + 1.0, i // 20 + 1) for i in range(57)}
    assert P.score_batches(df, scorer, ["v"], "s double, call int", ["id"], nulls="skip").count() == 51
    assert P.score_batches(df.limit(0), scorer, ["v"], "s double, call int", ["id"]).count() == 0
    with pytest.raises(Exception, match="lack an input"):
        P.score_batches(df, scorer, ["v"], "s double, call int", ["id"], nulls="fail").collect()
    with pytest.raises(Exception, match="gave no s"):
        P.score_batches(df, lambda: lambda x: {"s": [1.0]}, ["v"], "s double", ["id"]).collect()


def test_payload_files(spark, tmp_path):
    rows = [(1, b"one", "txt"), (2, b"two", None), (3, b"one", "bin"), (4, None, "txt"), (5, b"", "txt")]
    df = spark.createDataFrame(rows, "id long, data binary, kind string").repartition(3)
    root = f"file://{tmp_path}/store"
    name = lambda data, kind: f"objects/{hashlib.sha256(data).hexdigest()[:2]}/{hashlib.sha256(data).hexdigest()}.{kind}"
    want = {name(b"one", "bin"): 3, name(b"two", "bin"): 3, name(b"", "txt"): 0}
    for fresh in (True, False):
        got = S.write_objects(df, root, F.col("data"), F.col("kind")).collect()
        assert {r.path: r.bytes for r in got} == want and {r.written for r in got} == {fresh}
    files = [p for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert sorted(str(p.relative_to(tmp_path / "store")) for p in files) == sorted(want) and all(hashlib.sha256(p.read_bytes()).hexdigest() == p.stem for p in files)
    (tmp_path / "store" / name(b"two", "bin")).write_bytes(b"t")  # a torn file is written again
    assert {r.path for r in S.write_objects(df, root, F.col("data"), F.col("kind")).collect() if r.written} == {name(b"two", "bin")}
    with pytest.raises(Exception, match="differs from its digest"):
        S.write_objects(df, root, F.col("data"), F.col("kind"), F.lit("00")).collect()


def test_stored_objects_are_whole_files(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(b"one",), (b"",), (None,)], "data binary")
    want = {(r.path, r.bytes) for r in S.write_objects(df, root, F.col("data"), F.lit("txt")).collect()}
    place = tmp_path / "store" / min(want)[0]
    place.with_name(f"{place.name}.{'0' * 32}.part").write_bytes(b"o")  # left by a task that was killed
    (tmp_path / "store" / "objects" / "readme").write_bytes(b"x")
    got = S.stored_objects(spark, root).collect()
    assert len(got) == len(want) == 2 and {tuple(r) for r in got} == want


def test_payloads_are_written_where_they_lie(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(f"{k % 40}".encode(), ("txt", "bin")[k % 3 // 2]) for k in range(400)] + [(b"", "txt"), (None, "txt")]
    df = spark.createDataFrame(rows, "data binary, kind string").repartition(8)
    kept = {d: min(k for e, k in rows if e == d) for d, _ in rows if d is not None}
    name = lambda data: hashlib.sha256(data).hexdigest()
    (at := tmp_path / "store" / "objects" / name(b"7")[:2]).mkdir(parents=True)
    (at / f"{name(b'7')}~").write_bytes(b"7")  # staged by a job that was killed
    (at / f"{name(b'7')}~{'0' * 32}").write_bytes(b"")
    out = S.write_objects(df, root, F.col("data"), F.col("kind"))
    assert not any("data" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line)  # else payloads are shuffled
    for fresh in (True, False):
        got = out.collect()
        assert sorted((r.path, r.bytes, r.written) for r in got) == sorted((f"objects/{name(d)[:2]}/{name(d)}.{k}", len(d), fresh) for d, k in kept.items())
        assert sorted(tuple(r) for r in S.stored_objects(spark, root).collect()) == sorted((r.path, r.bytes) for r in got)
    left = [p for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert len(left) == len(kept) + 1 and all(name(p.read_bytes()) == p.stem for p in left if "~" not in p.name)


@pytest.mark.parametrize("texts", [["a", "", None, "a", None, "b"], ["", ""], [None]])
def test_object_files_of_odd_texts(spark, tmp_path, texts):
    import duckdb

    from curalis.plans import registry

    spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(registry.oracle_sql()["s10_object_files"]).fetchall()
    got = [tuple(r) for r in registry.queries()["s10_object_files"](spark, str(tmp_path)).select("path", "length").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sidecar_of_equal_and_repeated_rows(spark):
    a = spark.createDataFrame([(0, 0, "k", 1, "v"), (0, 1, None, None, "v"), (1, 0, "z", 2, "v"), (1, 1, "z", 2, "v")], "part int, place int, id string, label int, version string")
    assert J.sidecar_faults(a, a.orderBy("place"), "part", "place", "id", ["label"], "version").count() == 0
    b = a.withColumn("label", F.when(F.col("id") == "k", 9).otherwise(F.col("label"))).withColumn("version", F.when(F.col("part") == 1, None).otherwise(F.col("version")))
    assert {r.part: r.faults for r in J.sidecar_faults(a, b, "part", "place", "id", ["label"], "version").collect()} == {0: ["label"], 1: ["version"]}


def test_early_stop_loses_no_batch(spark, tmp_path):
    schema = "id long, g long, r string"
    rows = spark.range(140).select("id", (F.col("id") % 2).alias("g"), F.lpad(F.col("id").cast("string"), 4, "0").alias("r"))
    for k in range(14):
        rows.where(F.floor(F.col("id") / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda enough: R.keep_lowest(R.files(spark, str(tmp_path / "in"), schema), str(tmp_path / "t"), str(tmp_path / "c"), ["g"], "r", 1000, enough)
    there = lambda: R.last_version(spark, str(tmp_path / "t"), schema).count()
    run(lambda d: d.count() >= 40)
    first = there()
    assert 40 <= first < 140
    run(lambda d: d.count() >= 90)
    assert max(90, first) <= there() < 140
    run(None)
    assert there() == 140


def test_trained_head_against_newton(spark):
    from curalis.plans import registry

    data = "/root/testdata/sf0.001"
    got = {r.vec_id: r.prediction for r in registry.queries()["v11_trained_head"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x, y, ids = np.array([r.embedding for r in rows], float), np.array([r.label < 5 for r in rows], float), np.array([r.vec_id for r in rows])
    train = ids % 5 != 0
    std = x[train].std(0, ddof=1)
    z = np.c_[x / std, np.ones(len(x))]
    penalty, w = np.r_[np.full(64, 0.01), 0.0], np.zeros(65)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[train] @ w))
        gradient = z[train].T @ (p - y[train]) / train.sum() + penalty * w
        w -= np.linalg.solve((z[train] * (p * (1 - p))[:, None]).T @ z[train] / train.sum() + np.diag(penalty), gradient)
    want = {int(i): float(v > 0) for i, v in zip(ids[~train], z[~train] @ w, strict=True)}
    assert got.keys() == want.keys() and np.mean([got[i] == want[i] for i in want]) > 0.97
