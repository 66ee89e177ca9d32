"""Queries over resumable ingestion; each run uses folders of its own under the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.functions import identity as H
from curalis.functions.lineage import scratch_folder
from curalis.plans.base import query
from curalis.streaming import ingest as R


def _folder(t) -> str:
    return scratch_folder(t.spark, "stream")


@query("r1_resumable_ingest", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    d = _folder(t)
    t("events").select("event_id", "user_id", "event_type").repartition(4).write.parquet(f"{d}/in")
    schema = "event_id long, user_id long, event_type string"
    for _ in range(2):  # the second run finds nothing new
        R.ingest(R.files(t.spark, f"{d}/in", schema), f"{d}/out", f"{d}/check")
    return t.spark.read.schema(schema).parquet(f"{d}/out")


@query("r2_identity_dedup", "SELECT DISTINCT user_id FROM events")
def _(t):
    d = _folder(t)
    t("events").select("user_id").repartition(3).write.parquet(f"{d}/in")
    R.ingest(R.files(t.spark, f"{d}/in", "user_id long"), f"{d}/out", f"{d}/check", "user_id")
    return t.spark.read.schema("user_id long").parquet(f"{d}/out")


@query("r3_bounded_reserve", """
SELECT doc_id, source, sha256('7' || chr(0) || doc_id) AS r FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('7' || chr(0) || doc_id)) <= 5""")
def _(t):
    d = _folder(t)
    t("documents").select("doc_id", "source", H.stable_rank(7, F.col("doc_id")).alias("r")).repartition(3, "doc_id").write.parquet(f"{d}/in")
    stream = R.files(t.spark, f"{d}/in", "doc_id long, source string, r string")
    R.keep_lowest(stream, f"{d}/reserve", f"{d}/check", ["source"], "r", 5)
    return R.last_version(t.spark, f"{d}/reserve", "doc_id long, source string, r string")


@query("r4_early_stop", """
WITH p AS (SELECT event_id % 4 AS part, user_id % 4 AS g, event_id FROM events), c AS (SELECT s, p.g, count(*) AS n FROM range(0, 4) r(s) JOIN p ON p.part <= s GROUP BY 1, 2),
k AS (SELECT coalesce(min(s), 3) AS s FROM (SELECT s FROM c GROUP BY 1 HAVING count(*) FILTER (n >= 300) >= 4))
SELECT g, event_id FROM (SELECT g, event_id, row_number() OVER (PARTITION BY g ORDER BY sha256('7' || chr(0) || event_id)) AS n FROM p, k WHERE part <= k.s) WHERE n <= 300""")
def _(t):
    d = _folder(t)
    rows = t("events").select("event_id", (F.col("user_id") % 4).alias("g"), H.stable_rank(7, F.col("event_id")).alias("r"))
    schema = "event_id long, g long, r string"
    for part in range(4):  # units in order: one file each
        rows.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{d}/in")
    full = lambda x: x.groupBy("g").count().where("count >= 300").count() >= 4
    R.keep_lowest(R.files(t.spark, f"{d}/in", schema), f"{d}/kept", f"{d}/check", ["g"], "r", 300, full)
    return R.last_version(t.spark, f"{d}/kept", schema).select("g", "event_id")


@query("r5_invalidation", "SELECT event_id, event_type FROM events")
def _(t):
    d = _folder(t)
    t("events").select("event_id", "event_type").repartition(2).write.parquet(f"{d}/in")
    schema = "event_id long, event_type string"
    for revision in ("1", "1", "2"):  # the second run adds nothing, the third starts anew
        R.invalidate(t.spark, d, revision)
        R.ingest(R.files(t.spark, f"{d}/in", schema), f"{d}/out", f"{d}/check")
    return t.spark.read.schema(schema).parquet(f"{d}/out")


@query("r6_metric_log", """
WITH x AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
SELECT event_id, user_id, b IS NULL OR value > b AS improved FROM x""")
def _(t):
    from curalis.operators.selection import improvements

    d = _folder(t)
    t("events").select("event_id", "user_id", "ts", "value").repartition(2).write.parquet(f"{d}/in")
    schema = t("events").select("event_id", "user_id", "ts", "value").schema
    R.ingest(R.files(t.spark, f"{d}/in", schema), f"{d}/log", f"{d}/check")
    return improvements(t.spark.read.schema(schema).parquet(f"{d}/log"), "user_id", "ts", "value").select("event_id", "user_id", "improved")


@query("s1_manifest", "SELECT d.doc_id AS id, CASE WHEN d.doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, toxic::INTEGER AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 10 <> 0")
def _(t):
    from curalis.sources.tables import read_manifest

    d = _folder(t)
    t("documents").join(t("labels"), "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), F.col("toxic").alias("label")).write.json(f"{d}/manifest")
    return read_manifest(t.spark, f"{d}/manifest", "id long, split string, label int", "train", ["id", "label"])


@query("s2_metadata_csv", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_type FROM part")
def _(t):
    from curalis.sources.tables import read_metadata_csv

    d = _folder(t)
    t("part").select("p_partkey", "p_brand", "p_type").write.option("header", True).csv(f"{d}/part")
    return read_metadata_csv(t.spark, f"{d}/part", ["p_brand", "p_type"])


@query("s8_prediction_sink", "SELECT l_orderkey AS id, l_linenumber AS line, l_discount AS pred FROM lineitem")
def _(t):
    d = _folder(t)
    t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("pred")).write.json(f"{d}/predictions")
    return t.spark.read.schema("id long, line int, pred double").json(f"{d}/predictions")


@query("s4_payloads", "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(t):
    from curalis.sources.tables import payload

    d = _folder(t)
    t("documents").where("text IS NOT NULL").select("doc_id", F.struct(F.col("text").cast("binary").alias("bytes"), F.lit("x").alias("path")).alias("image")).write.parquet(f"{d}/rows")
    rows = t.spark.read.schema("doc_id long, image struct<bytes: binary, path: string>").parquet(f"{d}/rows")
    b = payload(F.col("image"), rows.schema["image"].dataType.simpleString())
    return rows.select("doc_id", F.octet_length(b).cast("long").alias("bytes"), F.sha2(b, 256).alias("digest"))


@query("s8_json_array", """
SELECT l_suppkey, '[' || string_agg('{"id":' || l_orderkey || ',"line":' || l_linenumber || ',"qty":' || l_quantity::BIGINT || '}', ',' ORDER BY l_orderkey, l_linenumber, l_quantity::BIGINT) || ']' AS json FROM lineitem GROUP BY 1""")
def _(t):
    from curalis.sources.tables import json_array

    x = t("lineitem").select("l_suppkey", F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("qty"))
    return json_array(x, ["id", "line", "qty"], ["l_suppkey"])


@query("s9_report_sinks", """
WITH r AS (SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1) SELECT 'csv' AS kind, * FROM r UNION ALL SELECT 'json', * FROM r""")
def _(t):
    from curalis.sources.tables import write_report

    d = _folder(t)
    write_report(t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")), f"{d}/report")
    schema = "event_type string, n long, mean double"
    both = t.spark.read.schema(schema).option("header", True).csv(f"{d}/report/csv").withColumn("kind", F.lit("csv"))
    return both.unionByName(t.spark.read.schema(schema).json(f"{d}/report/json").withColumn("kind", F.lit("json"))).select("kind", "event_type", "n", "mean")


@query("s11_metric_log", "SELECT event_type, count(*) AS n, 1 AS schema_version, true AS stamped FROM events GROUP BY 1")
def _(t):
    from curalis.sources.tables import append_metric

    d = _folder(t)
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    for part in ("event_type < 'm'", "event_type >= 'm'"):
        append_metric(counts.where(part), f"{d}/log")
    return t.spark.read.schema("event_type string, n long, schema_version int, timestamp timestamp").parquet(f"{d}/log").select("event_type", "n", "schema_version", F.col("timestamp").isNotNull().alias("stamped"))


@query("s12_feature_table", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, variant, label FROM embeddings, (VALUES (0), (1)) v(variant)")
def _(t):
    from curalis.sources.tables import merge_features, write_features

    d = _folder(t)
    rows = t("embeddings").select("vec_id", "embedding", "label", F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"), F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"))
    write_features(rows, f"{d}/features", 64)
    return merge_features(t.spark, f"{d}/features", "vec_id long, embedding array<float>, label int, split string, variant int", "vec_id").select("vec_id", "split", "variant", "label")
