"""Queries over joins, set operations and data-quality assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.functions import identity as H
from curalis.functions.lineage import checkpointed
from curalis.operators import matching as J
from curalis.plans.base import query
from curalis.plans.scalars import sandwich_sql


@query("j1_verified_join", """
SELECT d.doc_id, d.lang, d.n_chars <> length(d.text) AS wrong_size FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    chosen = t("labels").join(t("documents").select("doc_id", F.length("text").cast("long").alias("n_chars")), "doc_id")
    x = J.verified_join(t("documents"), chosen.select("doc_id", "n_chars"), "doc_id", ["n_chars"])
    return x.select("doc_id", "lang", (F.size("violations") > 0).alias("wrong_size"))


@query("j2_denied_paths", """
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE length(q.html) < 1024 AND split_part(p.url, '?', 1) = split_part(q.url, '?', 1))""")
def _(t):
    p = t("pages").withColumn("path", F.substring_index("url", "?", 1))
    return p.join(p.where(F.length("html") < 1024).select("path"), "path", "left_anti").select("page_id", "url")


_CANON = "trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("j3_exact_duplicates", f"""
WITH d AS (SELECT doc_id, sha256(text) AS content, sha256({_CANON}) AS canonical FROM documents),
c AS (SELECT min(doc_id) OVER (PARTITION BY content) AS kept, doc_id AS discarded, 'content' AS kind FROM d), c2 AS (SELECT * FROM c WHERE kept <> discarded),
n AS (SELECT min(doc_id) OVER (PARTITION BY canonical) AS kept, doc_id AS discarded, 'canonical' AS kind FROM d)
SELECT * FROM c2 UNION ALL SELECT * FROM n WHERE kept <> discarded AND discarded NOT IN (SELECT discarded FROM c2)""")
def _(t):
    d = t("documents").select("doc_id", H.content_digest(F.col("text")).alias("content"), H.content_digest(H.canonical_text(F.col("text"))).alias("canonical"))
    return J.exact_duplicates(d, "doc_id", ["content", "canonical"])


_SIGN = """WITH s AS (SELECT vec_id, list_aggregate(list_transform(range(0, 15), lambda i: format('{:x}', list_sum(list_transform(range(0, 4), lambda j: (embedding[i * 4 + j + 2] > embedding[i * 4 + j + 1])::INTEGER * (8 >> j)))::BIGINT)), 'string_agg', '') AS s FROM embeddings),
n AS (SELECT vec_id, ('0x' || substr(s, 1, 7))::BIGINT AS a, ('0x' || substr(s, 8, 8))::BIGINT AS b FROM s)"""


@query("j4_hamming_join", _SIGN + """
SELECT x.vec_id AS a, y.vec_id AS b, (bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)))::INTEGER AS distance FROM n x JOIN n y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) <= 12""")
def _(t):
    s = checkpointed(t("embeddings").select("vec_id", H.difference_signature(F.col("embedding"), 60).alias("s")))
    return J.hamming_join(s, s, "vec_id", "vec_id", "s", 12, 15).where("a < b")


_SEG = "SELECT {0} AS k, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[ \\t\\n]*'), lambda s: trim(regexp_replace(lower(s), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda s: s <> ''))) AS s FROM {1}"


@query("j5_segment_matches", f"""
WITH a AS ({_SEG.format("doc_id", "documents")}), b AS ({_SEG.format("item_id", "benchmark")}) SELECT a.k AS a, b.k AS b, count(*) AS shared FROM a JOIN b ON a.s = b.s GROUP BY 1, 2""")
def _(t):
    d = t("documents").select("doc_id", H.segment_signatures(F.col("text")).alias("s"))
    return J.segment_matches(d, t("benchmark").select("item_id", H.segment_signatures(F.col("text")).alias("s")), "doc_id", "item_id", "s")


def _two_signatures(name: str, grid: str) -> str:
    """SQL of both signatures of grids as lists of eight 32-bit numbers."""
    m, tall, wide = H.low_frequencies(8), H.stretched(8, 16), H.stretched(8, 17)
    word = "list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, 32), lambda j: ({0})::BIGINT << (31 - j))))"
    bit_p, bit_d = "c[k * 32 + j + 1] > m", "e[k * 32 + j + (k * 32 + j) // 16 + 2] > e[k * 32 + j + (k * 32 + j) // 16 + 1]"
    rounded = lambda x: f"list_transform({x}, lambda v: round(v, 6))"
    return f"""{name}_g AS (SELECT vec_id, {grid} AS g FROM embeddings), {name}_c AS MATERIALIZED (SELECT vec_id, {rounded(sandwich_sql(m, "g", m, 8))} AS c, {rounded(sandwich_sql(tall, "g", wide, 8))} AS e FROM {name}_g),
{name} AS MATERIALIZED (SELECT vec_id, {word.format(bit_p)} AS p, {word.format(bit_d)} AS d FROM (SELECT *, list_sort(c)[128] AS m FROM {name}_c))"""


_BITS = "list_sum(list_transform(range(1, 9), lambda k: bit_count(xor(x.{0}[k]::BIGINT, y.{0}[k]::BIGINT))))::INTEGER"
_COPY = 1.003, 0.004  # what copies are scaled and tilted by


@query("j4_two_signatures", f"""
WITH {_two_signatures("x", "list_transform(embedding, lambda v: v::DOUBLE)")}, {_two_signatures("y", f"list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_COPY[0]} + {_COPY[1]} * (i % 5))")},
n AS (SELECT x.vec_id AS a, y.vec_id AS b, {_BITS.format("p")} AS p_distance, {_BITS.format("d")} AS d_distance FROM x, y)
SELECT * FROM n WHERE p_distance <= 8 AND d_distance <= 8""")
def _(t):
    own = F.transform("embedding", lambda v: v.cast("double"))
    copy = F.transform("embedding", lambda v, i: v.cast("double") * _COPY[0] + _COPY[1] * ((i + 1) % 5))
    of = lambda g: checkpointed(t("embeddings").select("vec_id", H.cosine_signature_256(g).alias("p"), H.difference_signature_256(g).alias("d")))
    return J.near_signatures(of(own), of(copy), "vec_id", "vec_id", "p", "d", 8, 8)


_SEGMENT_BITS = """{0}_s AS (SELECT DISTINCT k, s FROM (SELECT {1} AS k, trim(unnest(regexp_split_to_array(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')), '[.!?]+ *'))) AS s FROM {2}) WHERE s <> ''),
{0}_w AS (SELECT s, md5(w) AS h FROM (SELECT s, unnest(string_split(s, ' ')) AS w FROM (SELECT DISTINCT s FROM {0}_s))),
{0}_v AS (SELECT s, k, h, sum((('0x' || substr(h0, 1 + 8 * h, 8))::BIGINT >> (31 - k)) & 1) * 2 > count(*) AS b FROM (SELECT s, h AS h0, unnest(range(0, 32)) AS k FROM {0}_w), (VALUES (0), (1)) AS t(h) GROUP BY ALL),
{0}_x AS (SELECT s, sum(CASE WHEN b AND h = 0 THEN 1::BIGINT << (31 - k) ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN b AND h = 1 THEN 1::BIGINT << (31 - k) ELSE 0 END)::BIGINT AS hi FROM {0}_v GROUP BY s),
{0} AS MATERIALIZED (SELECT DISTINCT k, lo, hi FROM {0}_s JOIN {0}_x USING (s))"""


@query("j5_near_segments", f"""
WITH {_SEGMENT_BITS.format("x", "doc_id", "documents")}, {_SEGMENT_BITS.format("y", "item_id", "benchmark")},
xs AS (SELECT DISTINCT lo, hi FROM x), ys AS (SELECT DISTINCT lo, hi FROM y),
n AS (SELECT xs.lo AS xl, xs.hi AS xh, ys.lo AS yl, ys.hi AS yh, bit_count(xor(xs.lo, ys.lo)) + bit_count(xor(xs.hi, ys.hi)) AS distance FROM xs, ys WHERE bit_count(xor(xs.lo, ys.lo)) + bit_count(xor(xs.hi, ys.hi)) <= 3)
SELECT x.k AS a, y.k AS b, count(DISTINCT (xl, xh)) AS matched, min(distance)::INTEGER AS closest FROM n JOIN x ON x.lo = xl AND x.hi = xh JOIN y ON y.lo = yl AND y.hi = yh GROUP BY 1, 2""")
def _(t):
    d, items = H.segment_bits(t("documents"), "doc_id", "text"), H.segment_bits(t("benchmark"), "item_id", "text")
    return J.near_segments(d, items, "doc_id", "item_id", "segments", 3, spare=3)


@query("j6_leakage_exclusion", f"""
WITH a AS ({_SEG.format("doc_id", "documents")}), b AS (SELECT s FROM ({_SEG.format("item_id", "benchmark")}))
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT k FROM a WHERE s IN (SELECT s FROM b))""")
def _(t):
    d = t("documents").select("doc_id", H.segment_signatures(F.col("text")).alias("s"))
    hits = J.sharing_parents(d, t("benchmark").select(H.segment_signatures(F.col("text")).alias("s")), "doc_id", "s")
    return J.exclude_parents(t("documents"), "doc_id", hits).select("doc_id", "lang")


@query("j7_shared_digest_parents", """
SELECT DISTINCT n_chars AS parent FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    return J.shared_digest_parents(t("documents").select(F.col("n_chars").alias("parent"), F.sha2("text", 256).alias("h")), "parent", "h")


@query("j8_enrich", "SELECT doc_id, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE length(text)::VARCHAR END AS result FROM documents")
def _(t):
    cache = t("documents").where("doc_id % 2 = 0").select("doc_id", "n_chars", F.lit("cached").alias("result")).unionByName(t.spark.createDataFrame([(-1, 1, "stale")], "doc_id long, n_chars long, result string"))
    return J.enrich(t("documents"), cache, ["doc_id", "n_chars"], lambda m: m.select("doc_id", "n_chars", F.length("text").cast("string").alias("result")))


@query("j9_reconcile", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'unknown' END AS side FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a
FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def _(t):
    return J.reconcile(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("j10_scenario_fan_out", "SELECT scenario, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings, (SELECT unnest(['clean', 'blur_1.0', 'resize_0.5']) AS scenario) GROUP BY 1")
def _(t):
    s = F.explode(F.array(*[F.lit(x) for x in ("clean", "blur_1.0", "resize_0.5")]))
    return t("embeddings").select("vec_id", s.alias("scenario")).groupBy("scenario").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("j11_flips", """
SELECT user_id FROM events GROUP BY 1 HAVING max(CASE WHEN event_type = 'error' THEN (value > 100)::INTEGER END) = 1 AND max(CASE WHEN event_type = 'signup' THEN (value > 150)::INTEGER END) = 0""")
def _(t):
    hit = F.when(F.col("event_type") == "error", F.col("value") > 100).otherwise(F.col("value") > 150)
    return J.flips(t("events"), "user_id", "event_type", hit, "signup", "error")


@query("j12_sidecar_mismatch", """
SELECT a.vec_id, a.label <> b.label AS mismatch FROM embeddings a JOIN (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN label + 1 ELSE label END AS label FROM embeddings) b ON a.vec_id = b.vec_id""")
def _(t):
    side = t("embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("label"))
    x = J.verified_join(t("embeddings").select("vec_id", "label"), side, "vec_id", ["label"])
    return x.select("vec_id", (F.size("violations") > 0).alias("mismatch"))


_RANGES = """a AS (SELECT vec_id // 20 AS part, vec_id % 20 AS place, vec_id, label, 'v2' AS version FROM embeddings),
b AS (SELECT part, CASE WHEN part = 1 AND place < 2 THEN 1 - place ELSE place END AS place, CASE WHEN part = 2 AND place = 3 THEN vec_id + 100000 ELSE vec_id END AS vec_id,
  CASE WHEN part = 3 AND place = 7 THEN label + 1 ELSE label END AS label, CASE WHEN part = 4 THEN 'v1' ELSE version END AS version FROM a WHERE part <> 5 AND NOT (part = 6 AND place = 0)
  UNION ALL SELECT -1, place, vec_id, label, version FROM a WHERE part = 0)"""


@query("j12_sidecar_faults", f"""
WITH {_RANGES}, x AS (SELECT coalesce(a.part, b.part) AS part, count(a.vec_id) AS na, count(b.vec_id) AS nb, count(*) FILTER (a.vec_id IS NULL OR b.vec_id IS NULL) AS alone,
  count(*) FILTER (a.place <> b.place) AS moved, count(*) FILTER (a.label <> b.label) AS changed, count(*) FILTER (a.version <> b.version) AS old FROM a FULL JOIN b ON a.part = b.part AND a.vec_id = b.vec_id GROUP BY 1)
SELECT * FROM (SELECT part, CASE WHEN nb = 0 THEN 'missing' WHEN na = 0 THEN 'unknown' WHEN old > 0 THEN 'version' WHEN na <> nb THEN 'rows' WHEN alone > 0 THEN 'keys' WHEN moved > 0 THEN 'order' WHEN changed > 0 THEN 'label' END AS faults FROM x) WHERE faults IS NOT NULL""")
def _(t):
    a = t("embeddings").select(F.floor(F.col("vec_id") / 20).alias("part"), (F.col("vec_id") % 20).alias("place"), "vec_id", "label", F.lit("v2").alias("version"))
    at = lambda p, *more: (F.col("part") == p) & F.col("place").isin(*more)
    b = a.where((F.col("part") != 5) & ~at(6, 0)).select(  # one fault of each kind
        "part", F.when(at(1, 0, 1), 1 - F.col("place")).otherwise(F.col("place")).alias("place"), F.when(at(2, 3), F.col("vec_id") + 100000).otherwise(F.col("vec_id")).alias("vec_id"),
        F.when(at(3, 7), F.col("label") + 1).otherwise(F.col("label")).alias("label"), F.when(F.col("part") == 4, "v1").otherwise(F.col("version")).alias("version"))
    b = b.unionByName(a.where("part = 0").withColumn("part", F.lit(-1).cast("long")))
    return J.sidecar_faults(a, b, "part", "place", "vec_id", ["label"], "version").select("part", F.array_join("faults", ",").alias("faults"))


@query("j13_bound_calibrator", """
SELECT l_linestatus, count(*) AS n, count(*) FILTER (1 / (1 + exp(-((CASE l_linestatus WHEN 'O' THEN 2.0 ELSE 1.0 END) * (l_discount * 100 - 5)))) >= 0.5) AS positive FROM lineitem GROUP BY 1""")
def _(t):
    cal = t.spark.createDataFrame([("O", 2.0), ("F", 1.0)], "l_linestatus string, coefficient double")
    p = 1 / (1 + F.exp(-(F.col("coefficient") * (F.col("l_discount") * 100 - 5))))
    return t("lineitem").join(F.broadcast(cal), "l_linestatus").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(p >= 0.5).alias("positive"))


@query("j14_opposite_class", """
WITH x AS (SELECT lang, toxic, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id), own AS (SELECT lang, toxic, count(*) AS own_n, sum(n_chars)::BIGINT AS own_sum FROM x GROUP BY 1, 2),
o AS (SELECT 1 - toxic AS toxic, count(*) AS other_n, sum(n_chars)::BIGINT AS other_sum FROM x GROUP BY 1) SELECT own.*, other_n, other_sum FROM own JOIN o USING (toxic)""")
def _(t):
    return J.opposite_class(t("documents").join(t("labels"), "doc_id").select("lang", "toxic", "n_chars"), "lang", "toxic", "n_chars")


@query("j15_cross_model", """
WITH m AS (SELECT user_id % 3 AS model, event_type, count(*) AS n, round(avg(value), 6) AS metric FROM events GROUP BY 1, 2)
SELECT a.model, a.event_type, round(a.metric - b.metric, 6) AS delta FROM m a JOIN m b ON b.model = 0 AND a.event_type = b.event_type""")
def _(t):
    m = t("events").groupBy((F.col("user_id") % 3).alias("model"), "event_type").agg(F.round(F.avg("value"), 6).alias("metric"))
    return m.join(m.where("model = 0").select("event_type", F.col("metric").alias("base")), "event_type").select("model", "event_type", F.round(F.col("metric") - F.col("base"), 6).alias("delta"))


@query("q1_required_fields", """
SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL OR trim(text) = '') AS text, count(*) FILTER (lang IS NULL) AS lang FROM documents""")
def _(t):
    return t("documents").agg(F.count_if(F.col("doc_id").isNull()).alias("doc_id"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("text"), F.count_if(F.col("lang").isNull()).alias("lang"))


@query("q2_unique_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("q3_balanced_labels", "SELECT count(*) FILTER (toxic = 0) AS zeros, count(*) FILTER (toxic = 1) AS ones, count(*) FILTER (toxic = 0) = count(*) FILTER (toxic = 1) AS balanced FROM labels")
def _(t):
    z, o = F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)
    return t("labels").agg(z.alias("zeros"), o.alias("ones"), (z == o).alias("balanced"))


@query("q4_one_revision", "SELECT source, count(DISTINCT lang) AS revisions, count(DISTINCT lang) = 1 AS one FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.count_distinct("lang").alias("revisions")).withColumn("one", F.col("revisions") == 1)


@query("q5_missing_strata", "SELECT unnest(list_sort(['ECONOMY', 'STANDARD', 'MISSING'])) AS stratum EXCEPT SELECT p_type FROM part")
def _(t):
    return t.spark.createDataFrame([("ECONOMY",), ("STANDARD",), ("MISSING",)], "stratum string").join(t("part").select(F.col("p_type").alias("stratum")), "stratum", "left_anti")


@query("q6_completeness_gate", "SELECT lang, count(*) >= 100 AS complete FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("lang").agg((F.count("*") >= 100).alias("complete"))


@query("q7_declared_size", "SELECT doc_id, n_chars, length(text) AS found FROM documents WHERE n_chars <> length(text)")
def _(t):
    return t("documents").where(F.col("n_chars") != F.length("text")).select("doc_id", "n_chars", F.length("text").cast("long").alias("found"))


@query("q7_declared_values", """
WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 41 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 37 = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS digest, CASE WHEN doc_id % 53 = 0 THEN 1 ELSE 2 END AS version FROM documents),
y AS (SELECT doc_id, concat_ws(',', CASE WHEN size IS DISTINCT FROM length(text) THEN 'size' END, CASE WHEN digest IS DISTINCT FROM sha256(text) THEN 'digest' END, CASE WHEN version <> 2 THEN 'version' END) AS violations FROM x)
SELECT * FROM y WHERE violations <> ''""")
def _(t):
    x = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 41 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"),
                              F.sha2(F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("digest"), F.when(F.col("doc_id") % 53 == 0, 1).otherwise(2).alias("version"))
    bad = J.declared_mismatches(x, "doc_id", {n: n for n in ("size", "digest", "version")}, {"size": F.length("text").cast("long"), "digest": F.sha2("text", 256), "version": F.lit(2)})
    return bad.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("u1_union", "SELECT doc_id AS id, 'd' AS origin FROM documents UNION ALL SELECT page_id, 'p' FROM pages UNION ALL SELECT conv_id, 'c' FROM conversations")
def _(t):
    a = t("documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("origin"))
    return a.unionByName(t("pages").select(F.col("page_id").alias("id"), F.lit("p").alias("origin"))).unionByName(t("conversations").select(F.col("conv_id").alias("id"), F.lit("c").alias("origin")))


@query("u2_difference", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return t("orders").select("o_orderkey").distinct().join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("u3_intersection", "SELECT count(*) AS n FROM (SELECT text FROM documents WHERE source = 'src0' INTERSECT SELECT text FROM documents WHERE source <> 'src0')")
def _(t):
    d = t("documents").select("source", F.sha2("text", 256).alias("h"))
    return d.where("source = 'src0'").select("h").intersect(d.where("source <> 'src0'").select("h")).agg(F.count("*").alias("n"))


@query("u4_last_write_wins", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))
