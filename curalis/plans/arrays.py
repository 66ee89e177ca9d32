"""Queries over vectors, grids and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.functions import arrays as V
from curalis.functions import identity as H
from curalis.functions.lineage import checkpointed
from curalis.operators import probes as P
from curalis.plans.base import query
from curalis.plans.scalars import sandwich_sql


def vector():
    return F.col("embedding")


def grid():
    return F.transform(vector(), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + 0.5)))


_GRID = "list_transform(embedding, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE + 0.5)))"


def digest(v, places: int = 6):
    """A grid in few numbers: sums under fixed weights, so that rows stay small."""
    at = F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, i: x * i)
    return [F.round(V.total(v), places).alias("total"), F.round(V.total(at), places - 1).alias("weighted")]


def digest_sql(v: str, places: int = 6) -> str:
    return f"round(list_sum({v}), {places}) AS total, round(list_sum(list_transform(range(1, 65), lambda i: {v}[i] * i)), {places - 1}) AS weighted"


@query("v1_channel_statistics", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, unnest(v) AS e FROM x)
SELECT vec_id, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(quantile_cont(e, 0.1), 6) AS q10, round(quantile_cont(e, 0.9), 6) AS q90, count(*) FILTER (e < 0) AS low FROM u GROUP BY 1""")
def _(t):
    h = V.histogram(vector(), -1.0, 1.0, 8)
    low = F.aggregate(F.slice(h, 1, 4), F.lit(0), lambda s, x: s + x)
    return t("embeddings").select("vec_id", F.round(V.mean(vector()), 6).alias("mean"), F.round(V.std(vector()), 6).alias("std"), F.round(V.quantile(vector(), 0.1), 6).alias("q10"), F.round(V.quantile(vector(), 0.9), 6).alias("q90"), low.cast("long").alias("low"))


@query("v2_entropy", """
WITH b AS (SELECT vec_id, greatest(0, least(63, floor((unnest(embedding)::DOUBLE + 0.5) / (1.0 / 64)))) AS b FROM embeddings), c AS (SELECT vec_id, b, count(*) AS n FROM b GROUP BY 1, 2)
SELECT vec_id, round(-sum(n / 64 * log2(n / 64)), 6) AS entropy FROM c GROUP BY 1""")
def _(t):
    return t("embeddings").select("vec_id", F.round(V.entropy(V.histogram(vector(), -0.5, 0.5, 64)), 6).alias("entropy"))


def window_sql(g: str, height: int, width: int, cell, down: int = 1, right: int = 1, top: int = 0, left: int = 0) -> str:
    at = lambda r, c: f"{g}[(i // {width} * {down} + {top + r}) * 8 + i % {width} * {right} + {left + c} + 1]"
    return f"list_transform(range(0, {height * width}), lambda i: {cell(at)})"


_STD = "list_aggregate({}, 'stddev_pop')"
_EDGES = f"""WITH x AS (SELECT vec_id, {_GRID} AS g FROM embeddings), y AS (SELECT vec_id,
{window_sql("g", 7, 7, lambda at: f"sqrt(({at(0, 1)} - {at(0, 0)}) * ({at(0, 1)} - {at(0, 0)}) + ({at(1, 0)} - {at(0, 0)}) * ({at(1, 0)} - {at(0, 0)}))")} AS d,
{window_sql("g", 6, 6, lambda at: f"{at(0, 1)} + {at(2, 1)} + {at(1, 0)} + {at(1, 2)} - 4 * {at(1, 1)}")} AS l,
{window_sql("g", 8, 7, lambda at: f"abs({at(0, 1)} - {at(0, 0)})")} AS h, {window_sql("g", 7, 8, lambda at: f"abs({at(1, 0)} - {at(0, 0)})")} AS v,
{window_sql("g", 8, 1, lambda at: f"abs({at(0, 0)} - {at(0, -1)})", 1, 4, 0, 4)} AS bh, {window_sql("g", 1, 8, lambda at: f"abs({at(0, 0)} - {at(-1, 0)})", 4, 1, 4, 0)} AS bv FROM x)"""


@query("v3_edges", f"""{_EDGES}
SELECT vec_id, round(list_avg(d), 6) AS gradient_mean, round({_STD.format("d")}, 6) AS gradient_std, len(list_filter(d, lambda e: e > list_avg(d) + {_STD.format("d")} + 1e-12)) / 49 AS edge_density,
  round(list_aggregate(l, 'var_pop'), 6) AS laplacian_variance, round((list_avg(bh) + list_avg(bv)) / greatest(1e-8, list_avg(h) + list_avg(v)), 6) AS block_ratio FROM y""")
def _(t):
    g = t("embeddings").select("vec_id", grid().alias("grid")).select("vec_id", "grid", V.gradient(F.col("grid"), 8).alias("d"), V.laplacian(F.col("grid"), 8).alias("l"))
    edge = H.let(V.mean(F.col("d")) + V.std(F.col("d")) + 1e-12, lambda m: F.size(F.filter("d", lambda x: x > m)))
    return g.select("vec_id", F.round(V.mean(F.col("d")), 6).alias("gradient_mean"), F.round(V.std(F.col("d")), 6).alias("gradient_std"), (edge / 49).alias("edge_density"),
                    F.round(F.pow(V.std(F.col("l")), F.lit(2.0)), 6).alias("laplacian_variance"), F.round(V.block_ratio(F.col("grid"), 8, 4), 6).alias("block_ratio"))


# The cuts of the radial bands.
BAND_CUTS = (0.125, 0.25, 0.5)
_BANDS = V.radial_bands(8, BAND_CUTS)
_COS, _SIN = V.fourier_matrices(8)


@query("v4_spectrum_bands", f"""
WITH x AS (SELECT vec_id, {_GRID} AS g FROM embeddings), z AS (SELECT vec_id, list_transform(g, lambda e: e - list_avg(g)) AS g FROM x),
y AS (SELECT vec_id, {sandwich_sql(_COS, "g", _COS, 8)} AS cc, {sandwich_sql(_SIN, "g", _SIN, 8)} AS ss, {sandwich_sql(_COS, "g", _SIN, 8)} AS cs, {sandwich_sql(_SIN, "g", _COS, 8)} AS sc FROM z),
p AS (SELECT vec_id, {_BANDS} AS b, list_transform(range(1, 65), lambda i: (cc[i] - ss[i]) * (cc[i] - ss[i]) + (cs[i] + sc[i]) * (cs[i] + sc[i])) AS p FROM y),
s AS (SELECT vec_id, {", ".join(f"list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] = {k} THEN p[i] ELSE 0 END)) / (list_sum(p) + 1e-12) AS band{k}" for k in range(4))} FROM p)
SELECT vec_id, {", ".join(f"round(band{k}, 6) AS band{k}" for k in range(4))}, round((band2 + band3) / greatest(1e-12, band0 + band1), 5) AS high_low FROM s""")
def _(t):
    shares = t("embeddings").select("vec_id", V.band_shares(V.spectrum(grid(), 8), _BANDS).alias("s"))
    s = [F.element_at("s", k) for k in range(1, 5)]
    return shares.select("vec_id", *[F.round(x, 6).alias(f"band{k}") for k, x in enumerate(s)], F.round((s[2] + s[3]) / F.greatest(F.lit(1e-12), s[0] + s[1]), 5).alias("high_low"))


# Residual kernels (Laplacian, two directional ones, chequered), each with its divisor.
RESIDUAL_KERNELS = {
    "laplacian": ([[0, 1, 0], [1, -4, 1], [0, 1, 0]], 4),
    "across": ([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], 8),
    "down": ([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], 8),
    "chequer": ([[1, -1, 1], [-1, 1, -1], [1, -1, 1]], 9),
}
_MOMENTS = ("mean_abs", "std", "rms", "fourth")


def _residual_sql(kernel, divisor: int) -> str:
    mirror = lambda i: f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END)"
    terms = [f"{kernel[r + 1][c + 1] / divisor!r}::DOUBLE * g[{mirror(f'(i // 8 + {r})')} * 8 + {mirror(f'(i % 8 + {c})')} + 1]" for r in (-1, 0, 1) for c in (-1, 0, 1) if kernel[r + 1][c + 1]]
    return f"list_transform(range(0, 64), lambda i: {' + '.join(terms)})"


def _moments_sql(n: str) -> str:
    return (f"round(list_avg(list_transform({n}, lambda e: abs(e))), 6) AS {n}_mean_abs, round({_STD.format(n)}, 6) AS {n}_std, round(sqrt(list_avg(list_transform({n}, lambda e: e * e))), 6) AS {n}_rms, "
            f"round(pow(greatest(list_avg(list_transform({n}, lambda e: pow(e, 4))), 1e-12), 0.25), 6) AS {n}_fourth")


@query("v5_residual_statistics", f"""
WITH x AS (SELECT vec_id, {_GRID} AS g FROM embeddings), y AS (SELECT vec_id, {", ".join(f"{_residual_sql(k, d)} AS {n}" for n, (k, d) in RESIDUAL_KERNELS.items())},
  {window_sql("g", 8, 7, lambda at: f"abs({at(0, 1)} - {at(0, 0)})")} AS h, {window_sql("g", 7, 8, lambda at: f"abs({at(1, 0)} - {at(0, 0)})")} AS v FROM x)
SELECT vec_id, {", ".join(_moments_sql(n) for n in RESIDUAL_KERNELS)}, round(list_avg(h), 6) AS horizontal, round(list_avg(v), 6) AS vertical FROM y""")
def _(t):
    g = t("embeddings").select("vec_id", grid().alias("g"))
    made = {n: V.residual_moments(V.neighbours(F.col("g"), 8, [[x / d for x in row] for row in k])) for n, (k, d) in RESIDUAL_KERNELS.items()}
    m = g.select("vec_id", *[c.alias(n) for n, c in made.items()], F.round(V.mean(V.steps(F.col("g"), 8)), 6).alias("horizontal"), F.round(V.mean(V.steps(F.col("g"), 8, True)), 6).alias("vertical"))
    return m.select("vec_id", *[F.round(f"{n}.{k}", 6).alias(f"{n}_{k}") for n in RESIDUAL_KERNELS for k in _MOMENTS], "horizontal", "vertical")


@query("v6_text_surface", """
SELECT doc_id, length(text) AS size, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper,
  len(string_split(text, chr(10))) - len(list_distinct(string_split(text, chr(10)))) AS repeated_lines FROM documents""")
def _(t):
    lines = F.split("text", "\n")
    n = lambda c: F.length(F.regexp_replace("text", c, "")).cast("long")
    return t("documents").select("doc_id", F.length("text").cast("long").alias("size"), n("[^0-9]").alias("digits"), n("[^A-Z]").alias("upper"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("repeated_lines"))


@query("v7_normalised", f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 3 + 0.1) AS v FROM embeddings), y AS (SELECT vec_id, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS v FROM x)
SELECT vec_id, {digest_sql("v")} FROM y""")
def _(t):
    return t("embeddings").select("vec_id", V.normalised(F.transform(vector(), lambda x: x.cast("double") * 3 + 0.1)).alias("v")).select("vec_id", *digest(F.col("v")))


_GATE, _BIAS = [((k * 7) % 5 - 2) / 4 for k in range(16)], [0.0, 0.1, -0.1, 0.2]


@query("v8_gated_fusion", f"""
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT vec_id, [v[1:16], v[17:32], v[33:48], v[49:64]] AS l FROM x),
e AS (SELECT *, list_transform(range(1, 5), lambda k: list_inner_product(l[k], {_GATE}::DOUBLE[]) + ({_BIAS}::DOUBLE[])[k]) AS e FROM l), w AS (SELECT *, list_transform(e, lambda a: exp(a - list_max(e))) AS w FROM e),
s AS (SELECT vec_id, list_transform(range(1, 17), lambda i: list_sum(list_transform(range(1, 5), lambda k: w[k] / list_sum(w) * l[k][i]))) AS s FROM w),
n AS (SELECT vec_id, list_transform(s, lambda a: a / sqrt(list_inner_product(s, s))) AS v FROM s) SELECT vec_id, {digest_sql("v")} FROM n""")
def _(t):
    layers = F.array(*[F.transform(F.slice(vector(), k * 16 + 1, 16), lambda x: x.cast("double")) for k in range(4)])
    fused = V.gated_fusion(layers, _GATE, _BIAS)
    return t("embeddings").select("vec_id", fused.alias("v")).select("vec_id", *digest(F.col("v")))


@query("v9_view_pooling", """
WITH p AS (SELECT vec_id // 4 AS id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT id, dim::INTEGER - 1 AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM p GROUP BY 1, 2""")
def _(t):
    p = t("embeddings").select(F.floor(F.col("vec_id") / 4).alias("id"), F.posexplode("embedding").alias("dim", "x"))
    return p.groupBy("id", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("std"))


@query("v10_linear_head", """
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * 7) % 11 - 5) / 10.0)) + 0.25, 6) AS logit FROM embeddings""")
def _(t):
    w = F.array(*[F.lit(((i * 7) % 11 - 5) / 10.0) for i in range(1, 65)])
    return t("embeddings").select("vec_id", F.round(V.dot(vector(), w) + 0.25, 6).alias("logit"))


def head_weights() -> tuple[list[list[float]], list[float], list[float], float]:
    """Weights of a small head by a rule."""
    return [[((i * 5 + k * 3) % 13 - 6) / 12 for i in range(64)] for k in range(4)], [0.1, -0.2, 0.3, 0.0], [0.5, -0.25, 0.75, -1.0], 0.125


@query("v10_head")
def _(t):
    return t("embeddings").select("vec_id", F.round(V.head(vector(), *head_weights()), 6).alias("logit"))


@query("v11_trained_head")
def _(t):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = t("embeddings").select("vec_id", (F.col("label") < 5).cast("double").alias("y"), array_to_vector(F.transform(vector(), lambda v: v.cast("double"))).alias("features"))
    model = LogisticRegression(labelCol="y", regParam=0.01, maxIter=30).fit(x.where("vec_id % 5 <> 0"))
    return model.transform(x.where("vec_id % 5 = 0")).select("vec_id", "y", "prediction")


def probe_rows(t):
    """Vectors as grids with the text of the same number: all surface features of both in one array, a label, its group and a source."""
    d = t("embeddings").join(t("documents").select(F.col("doc_id").alias("vec_id"), "text", "source"), "vec_id").select("vec_id", "label", "text", "source", grid().alias("g"))
    features = P.grid_features(F.col("g"), 8, RESIDUAL_KERNELS, _BANDS) | P.text_features(F.col("text"))
    rows = d.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.concat(F.lit("g"), F.col("label")).alias("generator"), "source",
                    F.when(F.col("vec_id") % 5 == 0, "val").when(F.col("vec_id") % 5 == 1, "test").otherwise("train").alias("split"),
                    F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in features.values()]).alias("features"))
    return checkpointed(rows), list(features)


@query("v12_nuisance_probe")
def _(t):
    rows, _ = probe_rows(t)
    score = P.boosted(rows.where("split = 'train'"), "features", "y", iterations=20)
    return P.probe_report(score(rows.where("split <> 'train'")), "y", "split", "generator", "source")


@query("v12_probe_report", """
WITH r AS (SELECT vec_id % 3 AS split, (label < 5)::INTEGER AS y, 'g' || label AS g, 's' || vec_id % 7 AS s, round(embedding[1]::DOUBLE + 0.5, 3) AS score FROM embeddings),
p AS (SELECT 'split' AS scope, 'all' AS name, * FROM r UNION ALL SELECT 'source', s, * FROM r UNION ALL SELECT 'generator', n.g, r.* FROM r, (SELECT DISTINCT g FROM r WHERE y = 1) n WHERE r.y = 0 OR r.g = n.g),
c AS (SELECT scope, name, split, count(*) AS n, sum(y) AS ones, sum(1 - y) AS zeros, sum(y * (score >= 0.5)::INTEGER) AS tp, sum((1 - y) * (score < 0.5)::INTEGER) AS tn, round(avg(score), 9) AS mean_score FROM p GROUP BY ALL),
w AS (SELECT a.scope, a.name, a.split, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS wins FROM p a JOIN p b USING (scope, name, split) WHERE a.y = 1 AND b.y = 0 GROUP BY ALL)
SELECT scope, name, split, n, round(wins / (ones * zeros), 9) AS auroc, round(CASE WHEN ones > 0 AND zeros > 0 THEN (tp / ones + tn / zeros) / 2 WHEN ones > 0 THEN tp / ones ELSE tn / zeros END, 9) AS balanced_accuracy, mean_score
FROM c LEFT JOIN w USING (scope, name, split)""")
def _(t):
    s = F.round(F.get("embedding", 0).cast("double") + 0.5, 3)
    r = t("embeddings").select((F.col("vec_id") % 3).alias("split"), (F.col("label") < 5).cast("int").alias("y"), F.concat(F.lit("g"), F.col("label")).alias("generator"), F.concat(F.lit("s"), F.col("vec_id") % 7).alias("source"), s.alias("score"))
    m = P.probe_report(r, "y", "split", "generator", "source")
    return m.select("scope", "name", "split", "n", *[F.round(c, 9).alias(c) for c in ("auroc", "balanced_accuracy", "mean_score")])


@query("v23_scored_batches", f"""
SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * 5 % 13 - 6) / 12.0::DOUBLE))) + 0.125))), 9) AS chance, (list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * 5 % 13 - 6) / 12.0::DOUBLE))) + 0.125 > 0)::INTEGER AS predicted FROM embeddings""")
def _(t):
    def scorer():
        import numpy as np

        weights = np.array([(i * 5 % 13 - 6) / 12 for i in range(1, 65)])

        def score(x):
            logit = x["embedding"].astype(float) @ weights + 0.125
            return {"chance": 1 / (1 + np.exp(-logit)), "predicted": (logit > 0).astype(int)}

        return score

    return P.score_batches(t("embeddings"), scorer, ["embedding"], "chance double, predicted int", ["vec_id"]).withColumn("chance", F.round("chance", 9))


@query("v14_augmentation_plan", """
WITH r AS (SELECT doc_id, k, -ln((('0x' || substr(sha256(doc_id || '|' || k), 1, 13))::BIGINT + 1) / (pow(2.0, 52) + 1)) / w AS t FROM documents, (VALUES ('blur', 1.0), ('resize', 2.0), ('noise', 1.5)) v(k, w))
SELECT doc_id, string_agg(k, '>' ORDER BY t) AS picks FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS n FROM r) WHERE n <= 2 GROUP BY 1""")
def _(t):
    p = V.weighted_picks(F.col("doc_id").cast("string"), {"blur": 1.0, "resize": 2.0, "noise": 1.5}, F.lit(2))
    return t("documents").select("doc_id", F.array_join(p, ">").alias("picks"))


def _u(name: str) -> str:
    return f"((('0x' || substr(sha256(id || '|{name}'), 1, 13))::BIGINT + 1) / (pow(2.0, 52) + 1))"


def _picks_sql(name: str, weights: dict) -> str:
    race = ", ".join(f"{{'t': -ln({_u(f'{name}|{k}')}) / {float(w)}, 'k': '{k}'}}" for k, w in weights.items())
    return f"list_transform(list_sort([{race}]), lambda x: x.k)"


def _level_sql(k: int, n: str, names) -> str:
    draw = lambda name, low, high: f"({low} + floor({_u(f'level-{k}{n}')} * {high - low + 1}))::DOUBLE" if name in V.WHOLE_LEVELS else f"{float(low)} + {_u(f'level-{k}{n}')} * {float(high - low)!r}"
    return f"CASE operation_{k} " + " ".join(f"WHEN '{x}' THEN {draw(x, *V.PLAN['levels'][x])}" for x in names) + " END"


def _plan_sql() -> str:
    p = V.PLAN
    side = lambda v: f"greatest(1, round_even(least(w, h) * ({float(p[v][0])} + {_u(v)} * {float(p[v][1] - p[v][0])!r}), 0)::BIGINT)"
    spots = ", ".join(f"floor({_u(f'{v}-{n}')} * (greatest(0, {edge} - {v}_side) + 1))::BIGINT AS {v}_{n}" for v in ("wide", "close") for n, edge in (("left", "w"), ("top", "h")))
    levels = ", ".join(f"round({_level_sql(k, n, names)}, 9) AS level_{k}{n}" for k in (1, 2) for n, names in (("a", p["operations"]), ("b", V.SECOND_LEVELS)))
    return f"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS id, 64 + n_chars % 900 AS w, 64 + doc_id % 700 AS h FROM documents),
a AS (SELECT *, {_u("standardise")} < {p["standardise"]} AS standardised, {_picks_sql("mode", p["modes"])}[1] AS m, {side("wide")} AS wide_side, {side("close")} AS close_side,
  CASE WHEN {_u("count")} < {p["none"]} THEN 0 WHEN {_u("count")} < {p["none"] + p["one"]} THEN 1 ELSE 2 END AS operations, {_picks_sql("operation", p["operations"])} AS picks FROM d),
b AS (SELECT *, CASE WHEN standardised THEN m END AS mode, CASE WHEN operations >= 1 THEN picks[1] END AS operation_1, CASE WHEN operations >= 2 THEN picks[2] END AS operation_2 FROM a)
SELECT doc_id, standardised, mode, CASE WHEN contains(mode, 'resize') THEN round({float(p["scale"][0])} + {_u("scale")} * {float(p["scale"][1] - p["scale"][0])!r}, 9) END AS scale,
  CASE WHEN contains(mode, 'codec') THEN {_picks_sql("codec", p["codecs"])}[1] END AS codec, CASE WHEN contains(mode, 'codec') THEN ({p["quality"][0]} + floor({_u("quality")} * {p["quality"][1] - p["quality"][0] + 1}))::VARCHAR END AS quality,
  wide_side, close_side, {spots}, {_picks_sql("filter", dict.fromkeys(p["filters"], 1.0))}[1] AS filter, operations::INTEGER AS operations, operation_1, operation_2, {levels} FROM b"""


@query("v14_full_plan", _plan_sql().replace("::VARCHAR END AS quality", "::BIGINT::VARCHAR END AS quality"))
def _(t):
    plan = V.augmentation_plan(F.col("doc_id").cast("string"), F.lit(64) + F.col("n_chars") % 900, F.lit(64) + F.col("doc_id") % 700)
    plan |= {k: F.round(c, 9) for k, c in plan.items() if k.startswith("level") or k == "scale"} | {"quality": plan["quality"].cast("string")}
    return t("documents").select("doc_id", *[c.alias(k) for k, c in plan.items()])


_UNIFORM = "((('0x' || substr(sha256(vec_id || '|' || {}), 1, 13))::BIGINT + 1) / (pow(2.0, 52) + 1))"


def noise_sql(g: str, sigma: float) -> str:
    place = lambda s: _UNIFORM.format(f"(i - 1) || '|{s}'")
    return f"list_transform(range(1, 65), lambda i: round_even(greatest(0.0, least(1.0, {g}[i] + {sigma} * sqrt(-2 * ln({place('a')})) * cos(2 * pi() * {place('b')}))) * 255, 0) / 255)"


@query("v15_noise", f"WITH x AS (SELECT vec_id, {_GRID} AS g FROM embeddings), y AS (SELECT vec_id, {noise_sql('g', 0.05)} AS v FROM x) SELECT vec_id, {digest_sql('v', 5)} FROM y")
def _(t):
    return t("embeddings").select("vec_id", V.noisy(grid(), F.col("vec_id").cast("string"), 0.05).alias("v")).select("vec_id", *digest(F.col("v"), 5))


def _matrix(name: str, matrix):
    @query(name, f"WITH x AS (SELECT vec_id, {_GRID} AS g FROM embeddings), y AS (SELECT vec_id, {sandwich_sql(matrix, 'g', matrix, 8)} AS v FROM x) SELECT vec_id, {digest_sql('v')} FROM y")
    def _(t):
        return t("embeddings").select("vec_id", grid().alias("g")).select("vec_id", V.apply_matrix(F.col("g"), matrix, 8).alias("v")).select("vec_id", *digest(F.col("v")))


_matrix("v16_smoothing", V.gaussian_matrix(8, 1.0))
_matrix("v17_down_up", V.down_up_matrix(8, 0.5))
_matrix("v19_crop", V.crop_matrix(8, 0.8))


def _jitter_sql() -> str:
    u = {n: _UNIFORM.format(f"'{n}'") for n in ("brightness", "contrast", "order")}
    bright = "list_transform({0}, lambda e: greatest(0.0, least(1.0, e * b)))"
    contrast = "list_transform({0}, lambda e: greatest(0.0, least(1.0, (e - list_avg({0})) * k + list_avg({0}))))"
    return f"""WITH x AS (SELECT vec_id, {_GRID} AS g, 0.8 + 0.4 * {u['brightness']} AS b, 0.8 + 0.4 * {u['contrast']} AS k, {u['order']} < 0.5 AS o FROM embeddings),
y AS (SELECT *, CASE WHEN o THEN {bright.format('g')} ELSE {contrast.format('g')} END AS h FROM x),
z AS (SELECT vec_id, CASE WHEN o THEN {contrast.format('h')} ELSE {bright.format('h')} END AS v FROM y) SELECT vec_id, {digest_sql('v')} FROM z"""


@query("v18_jitter", _jitter_sql())
def _(t):
    return t("embeddings").select("vec_id", V.jittered(grid(), F.col("vec_id").cast("string"), 0.2).alias("v")).select("vec_id", *digest(F.col("v")))


_DCT = H.cosine_matrix(8)
_BACK = [list(r) for r in zip(*_DCT, strict=True)]


@query("v20_quantised", f"""
WITH x AS (SELECT vec_id, {_GRID} AS g FROM embeddings), y AS (SELECT vec_id, list_transform({sandwich_sql(_DCT, "g", _DCT, 8)}, lambda e: floor(e / 0.1::DOUBLE + 0.5) * 0.1::DOUBLE) AS g FROM x),
z AS (SELECT vec_id, {sandwich_sql(_BACK, "g", _BACK, 8)} AS v FROM y) SELECT vec_id, {digest_sql("v", 5)} FROM z""")
def _(t):
    return t("embeddings").select("vec_id", grid().alias("g")).select("vec_id", V.quantised(F.col("g"), 8, 0.1).alias("v")).select("vec_id", *digest(F.col("v"), 5))


_SCENARIOS = {"clean": (), "blur_1.0": ("blur",), "noise_0.05": ("noise",), "combo_blur_noise": ("blur", "noise"), "combo_resize_crop_noise": ("resize", "crop", "noise")}
_MATRICES = {"blur": V.gaussian_matrix(8, 1.0), "resize": V.down_up_matrix(8, 0.5), "crop": V.crop_matrix(8, 0.8)}


def scenario_grids(t):
    """Each grid under each scenario: its operations folded in order, noise by the record's own seed."""
    step = {n: (lambda m: lambda g: V.apply_matrix(g, m, 8))(m) for n, m in _MATRICES.items()} | {"noise": lambda g: V.noisy(g, F.col("vec_id").cast("string"), 0.05)}
    g = t("embeddings").select("vec_id", "label", grid().alias("g"))
    made = F.array(*[F.struct(F.lit(k).alias("scenario"), V.folded(F.col("g"), [step[o] for o in ops]).alias("v")) for k, ops in _SCENARIOS.items()])
    return g.select("vec_id", "label", F.explode(made).alias("x")).select("vec_id", "label", "x.*")


def _scenario_sql() -> str:
    parts = []
    for k, ops in _SCENARIOS.items():
        v = f"(SELECT vec_id, label, {_GRID} AS g FROM embeddings)"
        for o in ops:
            v = f"(SELECT vec_id, label, {noise_sql('g', 0.05) if o == 'noise' else sandwich_sql(_MATRICES[o], 'g', _MATRICES[o], 8)} AS g FROM {v})"
        parts.append(f"SELECT vec_id, label, '{k}' AS scenario, g AS v FROM {v}")
    return " UNION ALL ".join(parts)


@query("v21_scenarios", f"SELECT vec_id, scenario, {digest_sql('v', 5)} FROM ({_scenario_sql()})")
def _(t):
    return scenario_grids(t).select("vec_id", "scenario", *digest(F.col("v"), 5))


@query("v22_variants", f"""
SELECT vec_id, any_value(label) AS label, count(*) AS variants, round(avg(list_avg(v)), 6) AS mean FROM ({_scenario_sql()}) GROUP BY 1 HAVING min(label) = max(label) AND count(DISTINCT scenario) = {len(_SCENARIOS)}""")
def _(t):
    x = scenario_grids(t).groupBy("vec_id").agg(F.min("label").alias("label"), F.max("label").alias("top"), F.count("*").alias("variants"), F.count_distinct("scenario").alias("names"), F.round(F.avg(V.mean(F.col("v"))), 6).alias("mean"))
    return x.where((F.col("label") == F.col("top")) & (F.col("names") == len(_SCENARIOS))).select("vec_id", "label", "variants", "mean")


@query("v13_permutation_importance")
def _(t):
    rows, names = probe_rows(t)
    score = P.boosted(rows.where("split = 'train'"), "features", "y", iterations=20)
    return P.permutation_importance(score, rows.where("split <> 'train'"), "vec_id", "features", names, "y")
