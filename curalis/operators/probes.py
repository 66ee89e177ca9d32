"""Probes for shortcuts: surface features, a boosted model on them, its scores by group, and what each feature is worth to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions import arrays as V
from curalis.functions import identity as H
from curalis.functions.lineage import checkpointed, running_sums
from curalis.operators.metrics import ranking_metrics

MAX_GROUPS = 10_000


def grid_features(grid: Column, side: int, kernels: dict[str, tuple[list[list[float]], float]], bands: list[int]) -> dict[str, Column]:
    """Surface statistics of a grid by name: moments, quantiles, histogram, entropy, edges, spectrum bands and residuals."""
    g = grid
    out = {"mean": V.mean(g), "std": V.std(g), "q10": V.quantile(g, 0.1), "q50": V.quantile(g, 0.5), "q90": V.quantile(g, 0.9)}
    out |= {f"bin{k}": F.get(V.histogram(g, 0.0, 1.0, 8), k).cast("double") for k in range(8)}
    out["entropy"] = V.entropy(V.histogram(g, 0.0, 1.0, 64))
    edges, curve = V.gradient(g, side), V.laplacian(g, side)
    out |= {"gradient_mean": V.mean(edges), "gradient_std": V.std(edges), "laplacian_variance": F.pow(V.std(curve), F.lit(2.0)), "block_ratio": V.block_ratio(g, side, side // 2)}
    out["edge_density"] = H.let(edges, lambda d: H.let(V.mean(d) + V.std(d) + 1e-12, lambda m: F.size(F.filter(d, lambda x: x > m)) / F.size(d)))
    shares = V.band_shares(V.spectrum(g, side), bands)
    out |= {f"band{k}": F.get(shares, k) for k in range(max(bands) + 1)}
    for name, (kernel, divisor) in kernels.items():
        moments = V.residual_moments(V.neighbours(g, side, [[x / divisor for x in row] for row in kernel]))
        out |= {f"{name}_{m}": moments[m] for m in ("mean_abs", "std", "rms", "fourth")}
    return out | {"horizontal": V.mean(V.steps(g, side)), "vertical": V.mean(V.steps(g, side, True))}


def text_features(text: Column) -> dict[str, Column]:
    """Surface statistics of a text by name: its length, and shares of digits, capitals, marks and repeated lines."""
    size = F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n")
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / size
    return {"size": F.length(text).cast("double"), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "marks": share(r"[\w\s]"),
            "repeated_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)}


def boosted(train: DataFrame, features: str, label: str, iterations: int = 150, step: float = 0.08, depth: int = 4, least: int = 20, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """Boosted trees fitted on arrays of numbers; returns a function that adds the column ``score``, the chance of label 1."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = train.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"))
    model = GBTClassifier(maxIter=iterations, stepSize=step, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(rows)

    def scored(df: DataFrame) -> DataFrame:
        out = model.transform(df.withColumn("_vector", array_to_vector(features)).drop("rawPrediction", "probability", "prediction"), {model.featuresCol: "_vector"})
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_vector", "rawPrediction", "probability", "prediction")

    return scored


def probe_report(scored: DataFrame, label: str, split: str, generator: str, source: str) -> DataFrame:
    """Ranking and threshold metrics of scores by scope: ``split`` (all rows), ``generator`` (its rows of label 1 with all of label 0), ``source``.

    Columns scope, name, the split, n, auroc (null where a label is missing), balanced_accuracy at 0.5 and mean_score. Rows of label 0 count for
    each generator, as counts by score, not as copies of rows; over ``MAX_GROUPS`` generators are refused.
    """
    rows = scored.select(split, F.col(label).cast("int").alias("y"), "score", F.coalesce(F.col(generator).cast("string"), F.lit("unknown")).alias("g"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("s"))
    counts = checkpointed(rows.groupBy(split, "y", "score", "g", "s").agg(F.count("*").alias("m")))
    names = checkpointed(counts.where("y = 1").select("g").distinct())
    if names.count() > MAX_GROUPS:
        raise ValueError("too many generators")
    one = lambda scope, name, df: df.select(F.lit(scope).alias("scope"), name.alias("name"), split, "y", "score", "m")
    zeros = counts.where("y = 0").groupBy(split, "y", "score").agg(F.sum("m").alias("m")).join(F.broadcast(names))
    parts = one("split", F.lit("all"), counts).unionByName(one("source", F.col("s"), counts)).unionByName(one("generator", F.col("g"), counts.where("y = 1"))).unionByName(one("generator", F.col("g"), zeros))
    by = ["scope", "name", split]
    s = checkpointed(parts.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, F.col("m")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("m")).otherwise(0)).alias("q")))
    below = running_sums(s, by, ["score"], {"below": F.col("q")})
    ranks = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") - F.col("q") + F.col("q") / 2)).alias("wins"), F.sum("p").alias("ones"), F.sum("q").alias("zeros"),
                                   F.sum(F.when(F.col("score") >= 0.5, F.col("p"))).alias("tp"), F.sum(F.when(F.col("score") < 0.5, F.col("q"))).alias("tn"), F.sum(F.col("score") * (F.col("p") + F.col("q"))).alias("total"))
    ok = (F.col("ones") > 0) & (F.col("zeros") > 0)
    recall = lambda hit, n: F.coalesce(hit, F.lit(0)) / n
    return ranks.select(*by, (F.col("ones") + F.col("zeros")).alias("n"), F.when(ok, F.col("wins") / (F.col("ones").cast("double") * F.col("zeros"))).alias("auroc"),
                        F.when(ok, (recall(F.col("tp"), F.col("ones")) + recall(F.col("tn"), F.col("zeros"))) / 2).when(F.col("ones") > 0, recall(F.col("tp"), F.col("ones"))).otherwise(recall(F.col("tn"), F.col("zeros"))).alias("balanced_accuracy"),
                        (F.col("total") / (F.col("ones") + F.col("zeros"))).alias("mean_score"))


def permutations(df: DataFrame, key: str, features: str, names: list[str], repeats: int, block: int = 10_000) -> DataFrame:
    """Every row once for each feature and repeat, with that feature's value dealt from another row; and once as it is (``feature`` null).

    Adds ``feature`` and ``repeat``. Values move inside random blocks of bounded size, a permutation inside each; all of them are one window
    and one join. ``key`` tells rows apart.
    """
    blocks = max(1, -(-df.count() // block))
    kinds = F.explode(F.sequence(F.lit(0), F.lit(len(names) * repeats - 1)))
    rows = df.select("*", kinds.alias("_kind"))
    salted = lambda s: F.xxhash64(F.lit(s), F.col("_kind"), F.col(key))
    rows = rows.withColumn("_block", F.pmod(salted("block"), F.lit(blocks)))
    place = lambda s: F.row_number().over(Window.partitionBy("_kind", "_block").orderBy(salted(s), F.col(key)))
    rows = checkpointed(rows.withColumn("_to", place("to")).withColumn("_from", place("from")))
    at = F.floor(F.col("_kind") / repeats).cast("int")
    donors = rows.select("_kind", "_block", F.col("_from").alias("_to"), F.get(F.col(features), at).alias("_value"))
    dealt = rows.join(donors, ["_kind", "_block", "_to"])
    changed = F.transform(features, lambda x, i: F.when(i == at, F.col("_value")).otherwise(x))
    named = F.get(F.array(*[F.lit(n) for n in names]), at)
    dealt = dealt.withColumn(features, changed).withColumn("feature", named).withColumn("repeat", F.col("_kind") % repeats)
    own = df.withColumn("feature", F.lit(None).cast("string")).withColumn("repeat", F.lit(0))
    return own.unionByName(dealt.select(*df.columns, "feature", F.col("repeat").cast("int").alias("repeat")))


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, key: str, features: str, names: list[str], label: str, repeats: int = 5) -> DataFrame:
    """Per feature the drop of AUROC under permutation: mean and deviation over repeats, largest first.

    ``features`` is an array column in the order of ``names``; ``score`` adds a column ``score`` and is called once, on all permuted rows.
    """
    scored = score(permutations(df.select(key, features, label), key, features, names, repeats))
    found = checkpointed(ranking_metrics(scored.withColumn("_y", F.col(label).cast("int")), "_y", "score", ["feature", "repeat"]).select("feature", "repeat", "auroc"))
    base = found.where("feature IS NULL").select(F.col("auroc").alias("_base"))
    drops = found.where("feature IS NOT NULL").join(F.broadcast(base)).withColumn("drop", F.col("_base") - F.col("auroc"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop")).orderBy(F.desc("mean_drop"), "feature")


def score_batches(df: DataFrame, scorer: Callable[[], Callable], inputs: list[str], outputs: str, keep: list[str], batch: int = 1024, nulls: str = "null") -> DataFrame:
    """Scores of any model: ``keep`` columns and the columns of ``outputs`` (a schema).

    ``scorer()`` is called once in each task, so that it can load a model, and gives a function from {input: array} to {output: array}; it
    gets ``batch`` rows at a time (the last of a task may have fewer), whatever sizes Arrow ships. Rows with a null input get null outputs
    (``nulls="null"``), are left out (``"skip"``) or fail the job (``"fail"``), and never reach the model. Outputs of another length, or a missing
    one, fail. An empty table gives an empty result.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import StructType, _parse_datatype_string

    if nulls not in ("null", "skip", "fail"):
        raise ValueError(nulls)
    wanted = _parse_datatype_string(outputs)
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = StructType([rows.schema[f"k{i}"] for i in range(len(keep))] + list(wanted))
    names = wanted.names

    def run(frames):
        model, held, size = None, [], 0

        def flush(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal model
            model = model or scorer()
            whole = part[[f"i{i}" for i in range(len(inputs))]].notna().all(axis=1).to_numpy()
            if not whole.all() and nulls == "fail":
                raise ValueError(f"{int((~whole).sum())} rows lack an input")
            given = {c: np.stack(part.loc[whole, f"i{i}"].to_list()) if whole.any() else np.zeros(0) for i, c in enumerate(inputs)}
            found = model(given) if whole.any() else {n: [] for n in names}
            out = part[[f"k{i}" for i in range(len(keep))]].copy()
            for n in names:
                if n not in found or len(found[n]) != whole.sum():
                    raise ValueError(f"the model gave no {n} for each row")
                column = np.full(len(part), None, object)
                column[whole] = pd.Series(list(found[n]), dtype=object).to_numpy()
                out[n] = column
            return out if nulls != "skip" else out[whole]

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= batch:
                joined = pd.concat(held, ignore_index=True)
                cut = size - size % batch
                for lo in range(0, cut, batch):
                    yield flush(joined.iloc[lo:lo + batch])
                held, size = [joined.iloc[cut:]], size - cut
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, schema).toDF(*keep, *names)
