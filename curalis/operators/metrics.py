"""Ranking, threshold and report metrics as aggregates and running sums over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions.lineage import checkpointed, running_sums


#: Curves are drawn for so many groups at most; each has a row for every threshold.
MAX_GROUPS = 10_000
MAX_POINTS = 2_000_000_000


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (field, value, n) of every field, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, fields: list[str], label: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(label, pairs.alias("x")).groupBy("x.field", "x.value", label).agg(F.count("*").alias("n"))


def quota_audit(df: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """Quotas (keys, quota) beside actual counts, and whether they agree."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("actual"))
    out = quotas.join(counts, keys, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn("complete", F.col("actual") == F.col("quota"))


def preparation_audit(df: DataFrame, split: str, label: str, generator: str, size: str, strata: list[str], expected: DataFrame | None = None) -> DataFrame:
    """What a prepared set holds, as rows (section, key, n, expected, short): classes and bytes by split, generators of label 1, strata.

    Keys join values by ``:``; null values read null. ``expected`` (section, key, expected) is held against the counts, with keys that have no
    row; ``short`` is how many are missing. Bytes are the section ``bytes``. One pass over the rows, then a table of groups.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    joined = lambda *c: F.concat_ws(":", *[text(x) for x in c])
    base = checkpointed(df.groupBy(*dict.fromkeys([split, label, generator, *strata])).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("bytes")))
    part = lambda name, key, n, rows=base: rows.groupBy(F.lit(name).alias("section"), key.alias("key")).agg(F.sum(n).cast("long").alias("n"))
    out = part("class", joined(split, label), "n").unionByName(part("generator", joined(split, generator), "n", base.where(F.col(label) == 1)))
    out = out.unionByName(part("stratum", joined(*strata), "n")).unionByName(part("bytes", text(split), "bytes"))
    if expected is None:
        return out.withColumns({"expected": F.lit(None).cast("long"), "short": F.lit(None).cast("long")})
    both = out.join(expected.select("section", "key", F.col("expected").cast("long").alias("expected")), ["section", "key"], "full_outer")
    return both.select("section", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "expected", F.when(F.col("expected").isNotNull(), F.greatest(F.lit(0), F.col("expected") - F.coalesce("n", F.lit(0)))).cast("long").alias("short"))


def index_quantiles(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """Sorted values at places ``min(n - 1, floor(n * f))``, from running counts per distinct value: (fraction, value)."""
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    places = running_sums(counts, [], [value], {"_hi": F.col("_c")}).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    place = F.least(F.lit(n - 1), F.floor(F.lit(n) * F.col("fraction")))
    return places.where((place < F.col("_hi")) & (place >= F.col("_hi") - F.col("_c"))).select("fraction", F.col(value).alias("value"))


def score_table(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Per group and distinct score: positives and negatives there, their running sums up to it, and the group's totals; ties are one row."""
    s = checkpointed(df.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg")))
    totals = s.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    running = running_sums(s, by, [score], {"_pos_to": F.col("pos"), "_neg_to": F.col("neg")})
    if not by:
        return running.join(F.broadcast(totals))  # one row
    same = [F.col(f"_t_{c}") for c in by]
    on = running[by[0]].eqNullSafe(same[0])
    for c, t in zip(by[1:], same[1:], strict=True):
        on &= running[c].eqNullSafe(t)
    return running.join(totals.select(*[F.col(c).alias(f"_t_{c}") for c in by], "P", "N"), on).drop(*[f"_t_{c}" for c in by])


def ranking_metrics(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """AUROC and average precision per group, ties counted half and in one step; null where a class is missing."""
    by = by or []
    s = score_table(df, label, score, by)
    tp, fp = F.col("P") - F.col("_pos_to") + F.col("pos"), F.col("N") - F.col("_neg_to") + F.col("neg")  # at this score and above
    s = s.withColumn("_a", F.col("pos") * (F.col("_neg_to") - F.col("neg") + F.col("neg") / 2)).withColumn("_p", F.col("pos") * (tp / (tp + fp)))
    ok = (F.max("P") > 0) & (F.max("N") > 0)
    return s.groupBy(*by).agg(F.when(ok, F.sum("_a") / (F.max("P").cast("double") * F.max("N"))).alias("auroc"), F.when(ok, F.sum("_p") / F.max("P")).alias("average_precision"))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold, by: list[str] | None = None) -> DataFrame:
    """Counts of the confusion table and what follows from it, per group; undefined parts are 0, single-class groups safe."""
    hit = F.col(score) >= threshold
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y = F.col(label)
    g = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), one((y == 1) & hit).alias("tp"), one((y == 0) & ~hit).alias("tn"), one((y == 0) & hit).alias("fp"), one((y == 1) & ~hit).alias("fn"),
        F.avg(score).alias("mean_score"))
    real, fake = F.col("tn") / F.greatest(F.lit(1), F.col("tn") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return (g.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n")).withColumn("real_recall", real).withColumn("fake_recall", fake)
            .withColumn("false_positive_rate", 1 - real).withColumn("predicted_rate", (F.col("tp") + F.col("fp")) / F.col("n"))
            .withColumn("balanced_accuracy", F.when(both, (real + fake) / 2).otherwise(F.when(F.col("tp") + F.col("fn") > 0, fake).otherwise(real)))
            .withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))))


def accuracy_curve(df: DataFrame, label: str, score: str, group: str, extra: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Balanced accuracy of each group at every threshold that occurs as a score in any group, and at ``extra``.

    Scores and thresholds are events on one line per group; running sums replace the table of all
    thresholds times all scores. Groups without both labels are left out. Over ``MAX_GROUPS`` groups, or ``MAX_POINTS`` points, are refused.
    """
    spark = df.sparkSession
    s = checkpointed(df.groupBy(group, F.col(score).cast("double").alias("t")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg")))
    totals = checkpointed(s.groupBy(group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where("P > 0 AND N > 0"))
    if totals.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    thresholds = checkpointed(s.select("t").unionByName(spark.createDataFrame([(float(x),) for x in extra], "t double")).distinct())
    if thresholds.count() * totals.count() > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points: round the scores or take fewer groups")
    points = thresholds.join(F.broadcast(totals))  # every threshold for each of a checked number of groups
    events = points.join(s.select(group, "t", "pos", "neg"), [group, "t"], "left").fillna(0, ["pos", "neg"])
    out = running_sums(events, [group], ["t"], {"_pos_to": F.col("pos"), "_neg_to": F.col("neg")})
    low = lambda c: F.col(f"_{c}_to") - F.col(c)
    return out.withColumn("balanced_accuracy", 0.5 * ((F.col("P") - low("pos")) / F.col("P") + low("neg") / F.col("N"))).select(group, F.col("t").alias("threshold"), "balanced_accuracy")


def robust_threshold(curve: DataFrame, group: str, clean: Column, max_drop: float) -> DataFrame:
    """The threshold best for the worst group, among those whose clean mean is within ``max_drop`` of the best."""
    t = checkpointed(curve.groupBy("threshold").agg(F.min("balanced_accuracy").alias("worst"), F.avg("balanced_accuracy").alias("macro"), F.avg(F.when(clean, F.col("balanced_accuracy"))).alias("clean_macro")))
    best = t.agg(F.max("clean_macro").alias("best"))
    return t.join(F.broadcast(best)).where(F.col("clean_macro") >= F.col("best") - max_drop - 1e-12).orderBy(
        F.desc("worst"), F.desc("macro"), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def bce(logit: Column, label: Column) -> Column:
    """Cross-entropy of a logit, stable for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def contrastive(df: DataFrame, batch: str, key: str, label: str, vector: str, temperature: float) -> DataFrame:
    """Per anchor the mean negative log-softmax over the batch's other rows of its label; anchors without any are left out.

    Pairs stay inside a batch, whose size is bounded by its maker.
    """
    a = df.select(batch, F.col(key).alias("i"), F.col(label).alias("li"), F.col(vector).alias("vi"))
    b = df.select(batch, F.col(key).alias("j"), F.col(label).alias("lj"), F.col(vector).alias("vj"))
    dot = F.aggregate(F.zip_with("vi", "vj", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, batch).where("i <> j").select(batch, "i", (F.col("li") == F.col("lj")).alias("same"), (dot / temperature).alias("s"))
    top = pairs.groupBy(batch, "i").agg(F.max("s").alias("m"))
    sums = pairs.join(top, [batch, "i"]).groupBy(batch, "i").agg(
        (F.max("m") + F.log(F.sum(F.exp(F.col("s") - F.col("m"))))).alias("lse"), F.avg(F.when(F.col("same"), F.col("s"))).alias("mean_same"))
    return sums.where("mean_same IS NOT NULL").select(batch, F.col("i").alias(key), (F.col("lse") - F.col("mean_same")).alias("loss"))


def scenario_summary(df: DataFrame, by: list[str], kind: str, metric: str, scenario: str) -> DataFrame:
    """Clean value, mean and least of single and composed scenarios, and the worst scenario by name."""
    of = lambda k: F.when(F.col(kind) == k, F.col(metric))
    return df.groupBy(*by).agg(F.max(of("clean")).alias("clean"), F.avg(of("single")).alias("mean_single"), F.min(of("single")).alias("worst_single"),
                               F.avg(of("composed")).alias("mean_composed"), F.min(of("composed")).alias("worst_composed"), F.min_by(scenario, metric).alias("worst_scenario"))


#: What an ablation report compares with its base.
ABLATION = ("clean_auroc", "mean_single_auroc", "worst_single_auroc", "mean_composed_auroc", "clean_balanced_accuracy", "mean_single_balanced_accuracy", "worst_single_real_recall")


def ablation(df: DataFrame, model: str, kind: str, base: Column) -> DataFrame:
    """Per model the values of ``ABLATION`` over its scenarios (``auroc``, ``balanced_accuracy``, ``real_recall``) and each one's difference from the base model's.

    Models without a clean or a single scenario fail the job.
    """
    of = lambda k, c: F.when(F.col(kind) == k, F.col(c))
    m = df.groupBy(model).agg(
        F.max(of("clean", "auroc")).alias("clean_auroc"), F.avg(of("single", "auroc")).alias("mean_single_auroc"), F.min(of("single", "auroc")).alias("worst_single_auroc"),
        F.avg(of("composed", "auroc")).alias("mean_composed_auroc"), F.max(of("clean", "balanced_accuracy")).alias("clean_balanced_accuracy"),
        F.avg(of("single", "balanced_accuracy")).alias("mean_single_balanced_accuracy"), F.min(of("single", "real_recall")).alias("worst_single_real_recall"))
    whole = F.col("clean_auroc").isNotNull() & F.col("mean_single_auroc").isNotNull()
    m = checkpointed(m.withColumn(model, F.when(whole, F.col(model)).otherwise(F.raise_error(F.lit("a model lacks clean or transformed scenarios")).cast(m.schema[model].dataType))))
    against = m.where(base).limit(1).select(*[F.col(c).alias(f"_{c}") for c in ABLATION])
    return m.join(F.broadcast(against)).select(*m.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ABLATION])


def affine_calibration(df: DataFrame, label: str, logit: str) -> DataFrame:
    """Slope and intercept of a logistic fit with an L2 penalty of weight 1 on the slope, and the rows of each label; a slope of 0 or less fails."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = df.agg(F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones")).first()
    if not n["zeros"] or not n["ones"]:
        raise ValueError("calibration needs both labels")
    x = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(F.col(logit).cast("double"))).alias("features"))
    fitted = LogisticRegression(regParam=1 / (n["zeros"] + n["ones"]), standardization=False, tol=1e-9).fit(x)
    slope = float(fitted.coefficients[0])
    if slope <= 0:
        raise ValueError(f"slope {slope}")
    return df.sparkSession.createDataFrame([(slope, float(fitted.intercept), n["zeros"], n["ones"])], "coefficient double, intercept double, zeros long, ones long")
