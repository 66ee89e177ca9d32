"""Queries over reports, ranking and threshold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.operators import matching as J
from curalis.operators import metrics as A
from curalis.plans.base import query

_LI = "SELECT l_orderkey, (l_returnflag = 'R')::INTEGER AS label, l_discount * 10 - l_tax AS logit, round(l_discount + l_tax / 10, 3) AS score, l_linestatus AS grp FROM lineitem"


def scored(t):
    return t("lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10 - F.col("l_tax")).alias("logit"),
                                F.round(F.col("l_discount") + F.col("l_tax") / 10, 3).alias("score"), F.col("l_linestatus").alias("grp"))


@query("a1_value_counts", """
SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def _(t):
    return A.value_counts(t("documents"), ["lang", "source"])


@query("a2_crosstab", """
WITH x AS (SELECT lang, source, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'lang' AS field, lang AS value, quality, count(*) AS n FROM x GROUP BY 2, 3 UNION ALL SELECT 'source', source, quality, count(*) FROM x GROUP BY 2, 3""")
def _(t):
    return A.crosstab(t("documents").join(t("labels"), "doc_id"), ["lang", "source"], "quality")


@query("a3_quota_audit", """
WITH q AS (SELECT * FROM (VALUES ('en', 620), ('de', 100), ('it', 5)) v(lang, quota)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, quota::BIGINT AS quota, coalesce(n, 0) AS actual, coalesce(n, 0) = quota AS complete FROM q LEFT JOIN c USING (lang)""")
def _(t):
    return A.quota_audit(t("documents"), t.spark.createDataFrame([("en", 620), ("de", 100), ("it", 5)], "lang string, quota long"), ["lang"])


@query("a4_marginal_deltas", """
WITH c AS (SELECT p_type, count(*) AS actual FROM part GROUP BY 1), w AS (SELECT *, sum(actual) OVER () AS total, count(*) OVER () AS k FROM c)
SELECT p_type, actual, round(actual - total / k, 6) AS delta FROM w""")
def _(t):
    c = t("part").groupBy("p_type").agg(F.count("*").alias("actual"))
    whole = c.agg(F.sum("actual").alias("total"), F.count("*").alias("k"))
    return c.join(F.broadcast(whole)).select("p_type", "actual", F.round(F.col("actual") - F.col("total") / F.col("k"), 6).alias("delta"))


@query("a5_preparation_audit", """
SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, sum(n_chars)::BIGINT AS chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    return t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.sum("n_chars").alias("chars"))


_EXPECTED = [("class", "en:1", 90), ("class", "xx:0", 5), ("generator", "de:src3", 2), ("stratum", "fr:src0", 1), ("stratum", "none", 4)]


@query("a5_full_audit", f"""
WITH d AS (SELECT lang, source, quality, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
x AS (SELECT 'class' AS section, lang || ':' || quality AS key, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'generator', lang || ':' || source, count(*) FROM d WHERE quality = 1 GROUP BY 2
  UNION ALL SELECT 'stratum', lang || ':' || source, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'bytes', lang, sum(n_chars)::BIGINT FROM d GROUP BY 2),
e AS (SELECT * FROM (VALUES {", ".join(map(str, _EXPECTED))}) AS e(section, key, expected))
SELECT coalesce(x.section, e.section) AS section, coalesce(x.key, e.key) AS key, coalesce(n, 0)::BIGINT AS n, expected::VARCHAR AS expected, CASE WHEN expected IS NOT NULL THEN greatest(0, expected - coalesce(n, 0))::VARCHAR END AS short FROM x FULL JOIN e ON x.section = e.section AND x.key = e.key""")
def _(t):
    d = t("documents").join(t("labels"), "doc_id").select("lang", "source", "quality", "n_chars")
    e = t.spark.createDataFrame(_EXPECTED, "section string, key string, expected long")
    a = A.preparation_audit(d, "lang", "quality", "source", "n_chars", ["lang", "source"], e)
    return a.select("section", "key", "n", F.col("expected").cast("string").alias("expected"), F.col("short").cast("string").alias("short"))


@query("a6_index_quantiles", """
WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents), f AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS fraction)
SELECT fraction, n_chars AS value FROM s JOIN f ON i = least(n - 1, floor(n * fraction))""")
def _(t):
    return A.index_quantiles(t("documents"), "n_chars", [0.25, 0.5, 0.75])


@query("a7_size_summary", """
SELECT quality, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS std, round(quantile_cont(n_chars, 0.1), 4) AS q10, round(quantile_cont(n_chars, 0.5), 4) AS q50, round(quantile_cont(n_chars, 0.9), 4) AS q90
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    g = t("documents").join(t("labels"), "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("std"), F.percentile("n_chars", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return g.select("quality", "n", "mean", "std", *[F.round(F.col("q")[i], 4).alias(k) for i, k in enumerate(("q10", "q50", "q90"))])


@query("a8_report_counters", """
SELECT lang, source, grouping(lang)::INTEGER AS no_lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))""")
def _(t):
    d = t("documents")
    return d.groupingSets([[d.lang], [d.source]], d.lang, d.source).agg(F.grouping("lang").cast("int").alias("no_lang"), F.count("*").alias("n"))


@query("a9_acquisition_stats", """
WITH x AS (SELECT DISTINCT split_part(url, '?', 1) AS path, length(html) AS size FROM pages)
SELECT (SELECT count(*) FROM pages) AS units, count(DISTINCT path) AS paths, sum(size)::BIGINT AS size FROM x""")
def _(t):
    p = t("pages").select(F.substring_index("url", "?", 1).alias("path"), F.length("html").cast("long").alias("size"))
    one = p.groupBy("path", "size").agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("units"), F.count_distinct("path").alias("paths"), F.sum("size").alias("size"))


@query("a10_dedup_events", """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT h, min(doc_id) AS kept FROM d GROUP BY 1)
SELECT 'content' AS kind, kept, doc_id AS discarded FROM d JOIN k USING (h) WHERE doc_id <> kept""")
def _(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    k = d.groupBy("h").agg(F.min("doc_id").alias("kept"))
    return d.join(k, "h").where("doc_id <> kept").select(F.lit("content").alias("kind"), "kept", F.col("doc_id").alias("discarded"))


@query("a11_provenance", """
SELECT min(doc_id) AS kept, list_sort(list(DISTINCT lang || ':' || source))[1] AS first_place, count(DISTINCT lang || ':' || source) AS places FROM documents GROUP BY sha256(text)""")
def _(t):
    p = F.concat_ws(":", "lang", "source")
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("kept"), F.collect_set(p).alias("s")).select(
        "kept", F.array_min("s").alias("first_place"), F.size("s").cast("long").alias("places"))


@query("a12_label_conflicts", """
WITH x AS (SELECT d.doc_id, sha256(text) AS h, CASE WHEN d.doc_id % 2 = 0 THEN 1 - quality ELSE quality END AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT h, count(*) AS n FROM x GROUP BY 1 HAVING min(y) <> max(y)""")
def _(t):
    x = t("documents").join(t("labels"), "doc_id").select(F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 2 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("y"))
    return J.label_conflicts(x, "h", "y")


_RANKED = f"""WITH x AS ({_LI}), s AS (SELECT grp, score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM s)"""


@query("a13_auroc", _RANKED + " SELECT grp, round(sum(pos * (below + neg / 2)) / (max(P)::DOUBLE * max(N)), 9) AS auroc FROM w GROUP BY 1")
def _(t):
    return A.ranking_metrics(scored(t), "label", "score", ["grp"]).select("grp", F.round("auroc", 9).alias("auroc"))


@query("a14_average_precision", _RANKED + " SELECT grp, round(sum(pos * (tp / (tp + fp))) / max(P), 9) AS average_precision FROM w GROUP BY 1")
def _(t):
    return A.ranking_metrics(scored(t), "label", "score", ["grp"]).select("grp", F.round("average_precision", 9).alias("average_precision"))


_CONF = f"""WITH x AS ({_LI}), g AS (SELECT {{by}}, count(*) AS n, count(*) FILTER (label = 1 AND score >= 0.05) AS tp, count(*) FILTER (label = 0 AND score < 0.05) AS tn,
  count(*) FILTER (label = 0 AND score >= 0.05) AS fp, count(*) FILTER (label = 1 AND score < 0.05) AS fn, avg(score) AS m FROM x GROUP BY 1)"""


@query("a15_balanced_accuracy_f1", _CONF.format(by="grp") + " SELECT grp, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM g")
def _(t):
    return A.threshold_metrics(scored(t), "label", "score", 0.05, ["grp"]).select("grp", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), F.round("f1", 9).alias("f1"))


@query("a16_confusion", _CONF.format(by="1 AS one") + " SELECT n, tp, tn, fp, fn, round((tp + tn) / n, 9) AS accuracy, round(tn / greatest(1, tn + fp), 9) AS real_recall, round(tp / greatest(1, tp + fn), 9) AS fake_recall FROM g")
def _(t):
    return A.threshold_metrics(scored(t), "label", "score", 0.05).select("n", "tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "real_recall", "fake_recall")])


@query("a17_group_metrics", """
WITH x AS (SELECT lang, toxic AS label, (n_chars % 100) / 100.0 AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, count(*) AS n, count(*) FILTER (label = 0) AS real, count(*) FILTER (label = 1) AS fake, round(avg(score), 9) AS mean_score, round(avg((score >= 0.5)::INTEGER), 9) AS predicted_rate,
  round(1 - count(*) FILTER (label = 0 AND score < 0.5) / greatest(1, count(*) FILTER (label = 0)), 9) AS false_positive_rate FROM x GROUP BY 1""")
def _(t):
    x = t("documents").join(t("labels"), "doc_id").select("lang", F.col("toxic").alias("label"), ((F.col("n_chars") % 100) / 100.0).alias("score"))
    g = A.threshold_metrics(x, "label", "score", 0.5, ["lang"])
    return g.select("lang", "n", (F.col("tn") + F.col("fp")).alias("real"), (F.col("tp") + F.col("fn")).alias("fake"), *[F.round(c, 9).alias(c) for c in ("mean_score", "predicted_rate", "false_positive_rate")])


@query("a18_source_metrics", """
WITH x AS (SELECT source, toxic AS label, (n_chars % 100) / 100.0 AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(((score >= 0.5)::INTEGER = label)::INTEGER), 9) AS accuracy FROM x GROUP BY 1""")
def _(t):
    x = t("documents").join(t("labels"), "doc_id").select("source", F.col("toxic").alias("label"), ((F.col("n_chars") % 100) / 100.0).alias("score"))
    return A.threshold_metrics(x, "label", "score", 0.5, ["source"]).select("source", "n", F.round("mean_score", 9).alias("mean_score"), F.round("accuracy", 9).alias("accuracy"))


_CURVE = f"""WITH x AS ({_LI}), t AS (SELECT DISTINCT score AS t FROM x UNION SELECT unnest([0.0, 0.5, 1.0])::DOUBLE),
g AS (SELECT grp, score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY 1, 2), tot AS (SELECT grp, sum(pos) AS P, sum(neg) AS N FROM g GROUP BY 1),
c AS (SELECT tot.grp, t.t AS threshold, 0.5 * ((P - coalesce((SELECT sum(pos) FROM g WHERE g.grp = tot.grp AND g.score < t.t), 0)) / P + coalesce((SELECT sum(neg) FROM g WHERE g.grp = tot.grp AND g.score < t.t), 0) / N) AS ba FROM tot, t)"""


@query("a19_accuracy_curve", _CURVE + " SELECT grp, threshold, round(ba, 9) AS balanced_accuracy FROM c")
def _(t):
    return A.accuracy_curve(scored(t), "label", "score", "grp").select("grp", "threshold", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query("a20_robust_threshold", _CURVE + """, m AS (SELECT threshold, min(ba) AS worst, avg(ba) AS macro, avg(ba) FILTER (grp = 'F') AS clean FROM c GROUP BY 1)
SELECT threshold, round(worst, 9) AS worst, round(macro, 9) AS macro FROM m WHERE clean >= (SELECT max(clean) FROM m) - 0.01 - 1e-12 ORDER BY worst DESC, macro DESC, abs(threshold - 0.5), threshold LIMIT 1""")
def _(t):
    return A.robust_threshold(A.accuracy_curve(scored(t), "label", "score", "grp"), "grp", F.col("grp") == "F", 0.01).select("threshold", F.round("worst", 9).alias("worst"), F.round("macro", 9).alias("macro"))


@query("a21_pooled_threshold", _CURVE.replace("l_linestatus AS grp", "1 AS grp") + " SELECT threshold, round(ba, 9) AS balanced_accuracy FROM c ORDER BY round(ba, 12) DESC, threshold DESC LIMIT 1")
def _(t):
    c = A.accuracy_curve(scored(t).withColumn("grp", F.lit(1)), "label", "score", "grp")
    return c.orderBy(F.desc(F.round("balanced_accuracy", 12)), F.desc("threshold")).limit(1).select("threshold", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query("a22_affine_calibration")
def _(t):
    x = t("embeddings").select((F.col("label") < 5).cast("int").alias("label"), F.col("embedding")[0].cast("double").alias("logit"))
    sign = x.agg(F.sign(F.corr("label", "logit"))).first()[0]  # a score that falls with the label is turned
    return A.affine_calibration(x.withColumn("logit", F.col("logit") * (sign or 1.0)), "label", "logit")


@query("a23_losses", f"""
WITH x AS ({_LI}) SELECT grp, round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 8) AS bce,
  round(avg(CASE WHEN abs(score - label) < 0.5 THEN 0.5 * (score - label) * (score - label) / 0.5 ELSE abs(score - label) - 0.25 END), 8) AS consistency FROM x GROUP BY 1""")
def _(t):
    return scored(t).groupBy("grp").agg(F.round(F.avg(A.bce(F.col("logit"), F.col("label"))), 8).alias("bce"), F.round(F.avg(A.smooth_l1(F.col("score"), F.col("label"), 0.5)), 8).alias("consistency"))


@query("a24_contrastive", """
WITH e AS (SELECT vec_id, label, vec_id // 64 AS batch, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v) / 0.1 AS s FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
m AS (SELECT vec_id, max(s) AS m FROM p GROUP BY 1)
SELECT vec_id, round(max(m) + ln(sum(exp(s - m))) - avg(s) FILTER (same), 6) AS loss FROM p JOIN m USING (vec_id) GROUP BY 1 HAVING count(*) FILTER (same) > 0""")
def _(t):
    e = t("embeddings").withColumn("batch", F.floor(F.col("vec_id") / 64))
    return A.contrastive(e, "batch", "vec_id", "label", "embedding", 0.1).select("vec_id", F.round("loss", 6).alias("loss"))


_SC = """SELECT CASE event_type WHEN 'error' THEN 'clean' WHEN 'signup' THEN 'combo_social' WHEN 'purchase' THEN 'combo_crop' ELSE event_type END AS scenario, user_id % 3 AS model, round(avg(value) / 1000, 6) AS auroc FROM events GROUP BY 1, 2"""


def scenario_metrics(t):
    s = F.col("event_type")
    name = F.when(s == "error", "clean").when(s == "signup", "combo_social").when(s == "purchase", "combo_crop").otherwise(s)
    m = t("events").groupBy(name.alias("scenario"), (F.col("user_id") % 3).alias("model")).agg(F.round(F.avg("value") / 1000, 6).alias("auroc"), F.count("*").alias("n"))
    return m.withColumn("kind", F.when(F.col("scenario") == "clean", "clean").when(F.col("scenario").startswith("combo_"), "composed").otherwise("single"))


_KIND = "CASE WHEN scenario = 'clean' THEN 'clean' WHEN starts_with(scenario, 'combo_') THEN 'composed' ELSE 'single' END"
_SUMMARY = f"""WITH s AS ({_SC}), k AS (SELECT *, {_KIND} AS kind FROM s), m AS (SELECT model, max(auroc) FILTER (kind = 'clean') AS clean, round(avg(auroc) FILTER (kind = 'single'), 9) AS mean_single, min(auroc) FILTER (kind = 'single') AS worst_single,
  round(avg(auroc) FILTER (kind = 'composed'), 9) AS mean_composed, min(auroc) FILTER (kind = 'composed') AS worst_composed, arg_min(scenario, auroc) AS worst_scenario FROM k GROUP BY 1)"""


@query("a25_scenario_summary", _SUMMARY + " SELECT * FROM m")
def _(t):
    return A.scenario_summary(scenario_metrics(t), ["model"], "kind", "auroc", "scenario").withColumn("mean_single", F.round("mean_single", 9)).withColumn("mean_composed", F.round("mean_composed", 9))


_ABLATION = """WITH x AS (SELECT CASE event_type WHEN 'error' THEN 'clean' WHEN 'signup' THEN 'combo_social' WHEN 'purchase' THEN 'combo_crop' ELSE event_type END AS scenario, user_id % 3 AS model, value / 1000 AS score, event_id % 2 AS label FROM events),
s AS (SELECT scenario, model, count(*) FILTER (label = 0 AND score < 0.05) / greatest(1, count(*) FILTER (label = 0)) AS real, count(*) FILTER (label = 1 AND score >= 0.05) / greatest(1, count(*) FILTER (label = 1)) AS fake, avg(score) AS auroc FROM x GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN scenario = 'clean' THEN 'clean' WHEN starts_with(scenario, 'combo_') THEN 'composed' ELSE 'single' END AS kind, (real + fake) / 2 AS ba FROM s),
m AS (SELECT model, max(auroc) FILTER (kind = 'clean') AS clean_auroc, avg(auroc) FILTER (kind = 'single') AS mean_single_auroc, min(auroc) FILTER (kind = 'single') AS worst_single_auroc, avg(auroc) FILTER (kind = 'composed') AS mean_composed_auroc,
  max(ba) FILTER (kind = 'clean') AS clean_balanced_accuracy, avg(ba) FILTER (kind = 'single') AS mean_single_balanced_accuracy, min(real) FILTER (kind = 'single') AS worst_single_real_recall FROM k GROUP BY 1)"""


@query("a26_ablation_summary", _ABLATION + " SELECT m.model, " + ", ".join(f"round(m.{c}, 9) AS {c}, round(m.{c} - b.{c}, 8) AS {c}_delta" for c in A.ABLATION) + " FROM m, (SELECT * FROM m WHERE model = 0) b")
def _(t):
    s = F.col("event_type")
    name = F.when(s == "error", "clean").when(s == "signup", "combo_social").when(s == "purchase", "combo_crop").otherwise(s)
    x = t("events").select(name.alias("scenario"), (F.col("user_id") % 3).alias("model"), (F.col("value") / 1000).alias("score"), (F.col("event_id") % 2).alias("label"))
    m = A.threshold_metrics(x, "label", "score", 0.05, ["scenario", "model"]).withColumn("auroc", F.col("mean_score")).withColumn(
        "kind", F.when(F.col("scenario") == "clean", "clean").when(F.col("scenario").startswith("combo_"), "composed").otherwise("single"))
    out = A.ablation(m, "model", "kind", F.col("model") == 0)
    return out.select("model", *[F.round(c, 9).alias(c) for c in A.ABLATION], *[F.round(f"{c}_delta", 8).alias(f"{c}_delta") for c in A.ABLATION])


@query("a27_comparability", f"""
WITH s AS ({_SC}), need AS (SELECT unnest(['clean', 'combo_social', 'combo_missing']) AS scenario), models AS (SELECT DISTINCT model FROM s)
SELECT model, scenario AS missing FROM models, need WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.model = models.model AND s.scenario = need.scenario)""")
def _(t):
    m = scenario_metrics(t)
    need = F.explode(F.array(*[F.lit(x) for x in ("clean", "combo_social", "combo_missing")]))
    return m.select("model").distinct().select("model", need.alias("scenario")).join(m, ["model", "scenario"], "left_anti").select("model", F.col("scenario").alias("missing"))


@query("a28_family_rollup", f"""
WITH s AS ({_SC}), k AS (SELECT *, {_KIND} AS family FROM s) SELECT family, scenario, round(avg(auroc), 9) AS mean, min(auroc) AS worst FROM k GROUP BY ROLLUP (family, scenario)""")
def _(t):
    return scenario_metrics(t).withColumnRenamed("kind", "family").rollup("family", "scenario").agg(F.round(F.avg("auroc"), 9).alias("mean"), F.min("auroc").alias("worst"))


@query("a29_selection_score", f"""
WITH s AS ({_SC}) SELECT model, round(0.5 * avg(auroc) FILTER (scenario IN ('clean', 'combo_crop')) + 0.5 * avg(auroc) FILTER (scenario NOT IN ('clean', 'combo_crop')), 9) AS score FROM s GROUP BY 1""")
def _(t):
    a = F.col("scenario").isin("clean", "combo_crop")
    return scenario_metrics(t).groupBy("model").agg(F.round(0.5 * F.avg(F.when(a, F.col("auroc"))) + 0.5 * F.avg(F.when(~a, F.col("auroc"))), 9).alias("score"))


@query("a30_throughput", """
SELECT event_type, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS per_second FROM events GROUP BY 1""")
def _(t):
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return t("events").groupBy("event_type").agg(F.round(F.count("*") / F.nullif(sec(F.max("ts")) - sec(F.min("ts")), F.lit(0)), 9).alias("per_second"))


@query("a31_error_mining", """
WITH x AS (SELECT d.doc_id, sha256(text) AS h, toxic AS label, (n_chars % 100) / 100.0 AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
e AS (SELECT *, abs(score - label) AS confidence FROM x WHERE (score >= 0.5)::INTEGER <> label), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1)
SELECT doc_id, label, round(confidence, 9) AS confidence FROM o ORDER BY round(confidence, 9) DESC, doc_id LIMIT 50""")
def _(t):
    x = t("documents").join(t("labels"), "doc_id").select("doc_id", F.sha2("text", 256).alias("h"), F.col("toxic").alias("label"), ((F.col("n_chars") % 100) / 100.0).alias("score"))
    e = x.where((F.col("score") >= 0.5).cast("int") != F.col("label")).withColumn("confidence", F.round(F.abs(F.col("score") - F.col("label")), 9))
    one = e.groupBy("h").agg(F.min_by(F.struct("doc_id", "label", "confidence"), "doc_id").alias("x")).select("x.*")
    return one.orderBy(F.desc("confidence"), "doc_id").limit(50)


@query("a32_interpretation", _RANKED + ", a AS (SELECT grp, sum(pos * (below + neg / 2)) / (max(P)::DOUBLE * max(N)) AS auroc FROM w GROUP BY 1) SELECT grp, CASE WHEN auroc < 0.6 THEN 'low' WHEN auroc < 0.7 THEN 'moderate' ELSE 'high' END AS band FROM a")
def _(t):
    return A.ranking_metrics(scored(t), "label", "score", ["grp"]).select("grp", F.when(F.col("auroc") < 0.6, "low").when(F.col("auroc") < 0.7, "moderate").otherwise("high").alias("band"))
