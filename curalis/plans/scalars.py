"""Queries over scalar functions: names, buckets, paths, scenarios, digests and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from curalis.functions import identity as H
from curalis.functions import normalise as N
from curalis.plans.base import query

_COMPACT = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("f1_canonical_generator", f"""
SELECT p_partkey, CASE {_COMPACT.format("p_brand")} WHEN 'brand13' THEN 'house' WHEN 'brand5' THEN 'house' ELSE {_COMPACT.format("p_brand")} END AS generator,
       {_COMPACT.format("p_name")} AS name FROM part""")
def _(t):
    return t("part").select("p_partkey", N.canonical_generator(F.col("p_brand"), {"brand13": "house", "brand5": "house"}).alias("generator"),
                            N.canonical_generator(F.col("p_name")).alias("name"))


_ALIAS = """({0} = '{1}' OR (starts_with({0}, '{1}') AND (regexp_matches(substr({0}, length('{1}') + 1), '^[0-9]')
  OR starts_with(substr({0}, length('{1}') + 1), 'v') OR starts_with(substr({0}, length('{1}') + 1), 'base')
  OR starts_with(substr({0}, length('{1}') + 1), 'large') OR starts_with(substr({0}, length('{1}') + 1), 'small')
  OR starts_with(substr({0}, length('{1}') + 1), 'xl'))))"""


@query("f2_matches_alias", f"""
SELECT p_partkey, {_ALIAS.format(_COMPACT.format("p_brand"), "brand1")} AS brand1, {_ALIAS.format(_COMPACT.format("p_type"), "economy")} AS economy FROM part""")
def _(t):
    return t("part").select("p_partkey", N.matches_alias(F.col("p_brand"), "Brand#1").alias("brand1"), N.matches_alias(F.col("p_type"), "economy").alias("economy"))


@query("f3_held_out", f"""
SELECT p_partkey, p_brand, p_type FROM part WHERE NOT ({_ALIAS.format(_COMPACT.format("p_brand"), "brand2")} OR {_ALIAS.format(_COMPACT.format("p_type"), "brand2")}
  OR {_ALIAS.format(_COMPACT.format("p_brand"), "economy")} OR {_ALIAS.format(_COMPACT.format("p_type"), "economy")})""")
def _(t):
    return t("part").where(~N.held_out([F.col("p_brand"), F.col("p_type")], ["brand2", "economy"])).select("p_partkey", "p_brand", "p_type")


@query("f4_group_name", f"""
SELECT c_custkey, {_COMPACT.format("trim(c_mktsegment)")} AS segment, translate(lower(trim(c_name)), '- ', '__') AS dataset,
       CASE {_COMPACT.format("trim(c_mktsegment)")} WHEN 'na' THEN 'unknown' WHEN 'laion5b' THEN 'laion' WHEN 'celebhq' THEN 'celebahq' ELSE {_COMPACT.format("trim(c_mktsegment)")} END AS real_source
FROM customer""")
def _(t):
    return t("customer").select("c_custkey", N.group_name(F.col("c_mktsegment"), "segment").alias("segment"),
                                N.group_name(F.col("c_name"), "source_dataset").alias("dataset"), N.group_name(F.col("c_mktsegment"), "real_source").alias("real_source"))


@query("f5_generator_family", f"""
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'LatDiff' WHEN p_size % 5 = 1 THEN '' WHEN p_size % 5 = 2 THEN 'GAN_based' WHEN p_size % 5 = 3 THEN NULL ELSE p_type END AS f,
             CASE WHEN p_size % 2 = 0 THEN 'SD-15' ELSE p_brand END AS a FROM part),
y AS (SELECT p_partkey, CASE {_COMPACT.format("coalesce(f, '')")} WHEN 'ganbased' THEN 'gan' WHEN 'diffusionbased' THEN 'diffusion' WHEN 'otherbased' THEN 'other' ELSE {_COMPACT.format("coalesce(f, '')")} END AS f, {_COMPACT.format("a")} AS a FROM x)
SELECT p_partkey, CASE WHEN f IN ('latdiff', 'pixdiff') THEN 'diffusion' WHEN f NOT IN ('', 'unknown') THEN f WHEN a = 'sd15' THEN 'diffusion' ELSE 'unknown' END AS family FROM y""")
def _(t):
    s = F.col("p_size") % 5
    family = F.when(s == 0, "LatDiff").when(s == 1, "").when(s == 2, "GAN_based").when(s == 3, F.lit(None)).otherwise(F.col("p_type"))
    architecture = F.when(F.col("p_size") % 2 == 0, "SD-15").otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", N.generator_family(family, architecture).alias("family"))


@query("f6_nuisance_buckets", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS w, 100 + (l_orderkey % 700) AS h, l_extendedprice AS size,
                  CASE l_returnflag WHEN 'R' THEN 'JPG' WHEN 'A' THEN 'png' ELSE 'tiff' END AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN least(w, h) < 192 THEN 'lt192' WHEN least(w, h) < 256 THEN '192_255' WHEN least(w, h) < 384 THEN '256_383' WHEN least(w, h) < 512 THEN '384_511' WHEN least(w, h) < 768 THEN '512_767' ELSE 'ge768' END AS resolution_bucket,
  CASE WHEN w / greatest(1, h) < 0.8 THEN 'portrait' WHEN w / greatest(1, h) > 1.25 THEN 'landscape' ELSE 'squareish' END AS aspect_bucket,
  CASE WHEN lower(kind) IN ('jpg', 'jpeg') THEN 'jpeg' WHEN lower(kind) IN ('png', 'webp') THEN lower(kind) ELSE 'other' END AS format_bucket,
  CASE WHEN size / greatest(1, w * h) < 0.5 THEN 'low' WHEN size / greatest(1, w * h) < 1.5 THEN 'medium' ELSE 'high' END AS encoding_density_bucket FROM x""")
def _(t):
    kind = F.when(F.col("l_returnflag") == "R", "JPG").when(F.col("l_returnflag") == "A", "png").otherwise("tiff")
    b = N.nuisance_buckets(F.col("l_quantity") * 20, 100 + F.col("l_orderkey") % 700, kind, F.col("l_extendedprice"))
    return t("lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in b.items()])


@query("f7_split_name", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'val' WHEN 'F' THEN 'train' END AS split FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderstatus") == "O", "validation").when(F.col("o_orderstatus") == "F", "train").otherwise(F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", N.split_name(raw).alias("split"))


@query("f8_safe_path", """
WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' || regexp_extract(url, '://[^/]*/?([^?#]*)', 1) WHEN 1 THEN '../' || regexp_extract(url, '://[^/]*/?([^?#]*)', 1)
   WHEN 2 THEN './' || regexp_extract(url, '://[^/]*/?([^?#]*)', 1) ELSE regexp_extract(url, '://[^/]*/?([^?#]*)', 1) END AS p FROM pages),
y AS (SELECT page_id, regexp_replace(p, '^(\\./)+', '') AS p FROM x)
SELECT page_id, CASE WHEN p <> '' AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') THEN p END AS path FROM y""")
def _(t):
    rest = F.regexp_extract("url", "://[^/]*/?([^?#]*)", 1)
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("/"), rest)).when(k == 1, F.concat(F.lit("../"), rest)).when(k == 2, F.concat(F.lit("./"), rest)).otherwise(rest)
    return t("pages").select("page_id", N.safe_path(raw).alias("path"))


@query("f9_archive_routing", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN lower(p_type) || '.zip' ELSE 'other_' || substr(regexp_replace(p_brand, '^Brand#', ''), 1, 1) || '.zip' END AS archive,
       regexp_replace(p_brand, '^Brand#', '') || '/' || p_name AS member FROM part""")
def _(t):
    number = F.regexp_replace("p_brand", "^Brand#", "")
    archive = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), F.concat(F.lower("p_type"), F.lit(".zip"))).otherwise(F.concat(F.lit("other_"), F.substring(number, 1, 1), F.lit(".zip")))
    return t("part").select("p_partkey", archive.alias("archive"), F.concat(number, F.lit("/"), F.col("p_name")).alias("member"))


@query("f10_unified_candidates", """
SELECT 'documents' AS source_dataset, doc_id::VARCHAR AS source_id, coalesce(nullif(trim(source), ''), 'unknown') AS content_group, length(text) AS size FROM documents
UNION ALL SELECT 'pages', page_id::VARCHAR, coalesce(nullif(trim(regexp_extract(url, '://([^/?#]*)', 1)), ''), 'unknown'), length(html) FROM pages
UNION ALL SELECT 'conversations', conv_id || '-' || turn, coalesce(nullif(trim(role), ''), 'unknown'), length(text) FROM conversations""")
def _(t):
    d = t("documents").select(F.lit("documents").alias("source_dataset"), F.col("doc_id").cast("string").alias("source_id"),
                              N.first_of(F.col("source"), default="unknown").alias("content_group"), F.length("text").cast("long").alias("size"))
    p = t("pages").select(F.lit("pages").alias("source_dataset"), F.col("page_id").cast("string").alias("source_id"),
                          N.first_of(F.regexp_extract("url", "://([^/?#]*)", 1), default="unknown").alias("content_group"), F.length("html").cast("long").alias("size"))
    c = t("conversations").select(F.lit("conversations").alias("source_dataset"), F.concat_ws("-", "conv_id", "turn").alias("source_id"),
                                  N.first_of(F.col("role"), default="unknown").alias("content_group"), F.length("text").cast("long").alias("size"))
    return d.unionByName(p, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("f11_eligible", """
SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IN (0, 1) AND l.toxic = 0 AND d.source NOT IN ('src0', 'src1')""")
def _(t):
    good = t("labels").where(F.col("quality").isin(0, 1) & (F.col("toxic") == 0))
    return t("documents").where(~F.col("source").isin("src0", "src1")).join(good, "doc_id").select("doc_id", "lang", "quality")


@query("f12_enum_decode", """
SELECT vec_id, (['zero','one','two','three','four','five','six','seven','eight','nine'])[label + 1] AS name, label NOT BETWEEN 0 AND 9 AS violated FROM embeddings""")
def _(t):
    names = F.array(*[F.lit(x) for x in "zero one two three four five six seven eight nine".split()])
    return t("embeddings").select("vec_id", F.get(names, F.col("label")).alias("name"), (~F.col("label").between(0, 9)).alias("violated"))


@query("f13_metadata_bucket", """
WITH x AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'train' WHEN p_size < 40 THEN 'val' END AS split, lower(p_type) AS grp, p_brand AS name FROM part)
SELECT * FROM x WHERE split IS NOT NULL""")
def _(t):
    place = F.when(F.col("p_size") < 10, F.struct(F.lit("train").alias("split"), F.lower("p_type").alias("grp"), F.col("p_brand").alias("name"))).when(
        F.col("p_size") < 40, F.struct(F.lit("val").alias("split"), F.lower("p_type").alias("grp"), F.col("p_brand").alias("name")))
    return t("part").select("p_partkey", place.alias("x")).where("x IS NOT NULL").select("p_partkey", "x.*")


@query("f14_prescribed_subset", """
SELECT 'event' AS origin, event_id AS id FROM events WHERE event_type = 'error' AND value > 50
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1-%'""")
def _(t):
    a = t("events").where("event_type = 'error' AND value > 50").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"))
    b = t("orders").where("o_orderstatus = 'P' AND o_orderpriority LIKE '1-%'").select(F.lit("order").alias("origin"), F.col("o_orderkey").alias("id"))
    return a.unionByName(b)


@query("f15_encoding_density", "SELECT l_orderkey, l_linenumber, l_extendedprice / greatest(1, l_quantity * l_linenumber) AS density FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", N.encoding_density(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")).alias("density"))


@query("f16_calibrated", """
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(2.0 * (l_discount * 100 - 5) - 1.0))), 9) AS pred, 1 / (1 + exp(-(2.0 * (l_discount * 100 - 5) - 1.0))) >= 0.7 AS positive FROM lineitem""")
def _(t):
    p = N.calibrated(F.col("l_discount") * 100 - 5, 2.0, -1.0)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(p, 9).alias("pred"), (p >= 0.7).alias("positive"))


_SCENARIO = """CASE event_type WHEN 'error' THEN 'clean' WHEN 'signup' THEN 'combo_social_resize_0.5_jpeg_70' WHEN 'purchase' THEN 'combo_blur_1.0_resize_0.5_jpeg_50'
  ELSE event_type || '_0.5' END"""


def scenario_of(c):
    return (F.when(c == "error", "clean").when(c == "signup", "combo_social_resize_0.5_jpeg_70").when(c == "purchase", "combo_blur_1.0_resize_0.5_jpeg_50")
            .otherwise(F.concat(c, F.lit("_0.5"))))


@query("f17_scenario_kind", f"""
WITH x AS (SELECT event_id, {_SCENARIO} AS scenario FROM events)
SELECT scenario, CASE WHEN scenario = 'clean' THEN 'clean' WHEN starts_with(scenario, 'combo_') THEN 'composed' ELSE 'single' END AS kind, count(*) AS n FROM x GROUP BY 1, 2""")
def _(t):
    s = scenario_of(F.col("event_type"))
    return t("events").groupBy(s.alias("scenario"), N.scenario_kind(s).alias("kind")).agg(F.count("*").alias("n"))


@query("f18_scenario_operations", f"""
WITH x AS (SELECT event_id, {_SCENARIO} AS scenario FROM events)
SELECT event_id, CASE WHEN scenario = 'clean' THEN '' WHEN scenario = 'combo_social_resize_0.5_jpeg_70' THEN 'resize_0.5>jpeg_70'
  WHEN scenario = 'combo_blur_1.0_resize_0.5_jpeg_50' THEN 'blur_1.0>resize_0.5>jpeg_50' ELSE scenario END AS operations FROM x""")
def _(t):
    return t("events").select("event_id", F.array_join(N.scenario_operations(scenario_of(F.col("event_type"))), ">").alias("operations"))


_RANK = "sha256('7' || chr(0) || {0})"


@query("h1_stable_rank", "SELECT doc_id, sha256('7' || chr(0) || coalesce(lang, 'None') || chr(0) || doc_id) AS rank FROM documents")
def _(t):
    return t("documents").select("doc_id", H.stable_rank(7, F.col("lang"), F.col("doc_id")).alias("rank"))


@query("h2_integer_seed", "SELECT vec_id, ('0x' || substr(sha256('7:' || vec_id), 1, 13))::BIGINT AS seed FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", H.hex_number(F.sha2(F.concat(F.lit("7:"), F.col("vec_id").cast("string")), 256)).alias("seed"))


@query("h3_logical_id", "SELECT page_id, sha256('web' || chr(0) || 'r1' || chr(0) || url) AS id FROM pages")
def _(t):
    return t("pages").select("page_id", H.logical_id("web", "r1", F.col("url")).alias("id"))


CANONICAL_SQL = "trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query("h4_content_digest", f"SELECT doc_id, sha256(text) AS content, sha256({CANONICAL_SQL}) AS canonical FROM documents")
def _(t):
    return t("documents").select("doc_id", H.content_digest(F.col("text")).alias("content"), H.content_digest(H.canonical_text(F.col("text"))).alias("canonical"))


@query("h5_uniform", "SELECT doc_id, round((('0x' || substr(sha256('7' || chr(0) || doc_id), 1, 13))::BIGINT + 1) / (pow(2.0, 52) + 1), 12) AS u FROM documents")
def _(t):
    return t("documents").select("doc_id", F.round(H.uniform(H.stable_rank(7, F.col("doc_id"))), 12).alias("u"))


@query("h6_fingerprint", """
WITH b AS (SELECT source, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::BIGINT % 64 AS b, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS d FROM documents GROUP BY 1, 2)
SELECT source, sha256(string_agg(d, chr(10) ORDER BY b)) AS fingerprint FROM b GROUP BY 1""")
def _(t):
    return H.fingerprint(t("documents"), value="doc_id", by=["source"])


@query("h7_hamming", """
SELECT doc_id, list_sum(list_transform(range(0, 8), lambda i: bit_count(xor(('0x' || substr(sha256(text), i * 8 + 1, 8))::BIGINT, ('0x' || substr(sha256(lang), i * 8 + 1, 8))::BIGINT))))::BIGINT AS distance FROM documents""")
def _(t):
    return t("documents").select("doc_id", H.hamming(H.content_digest(F.col("text")), H.content_digest(F.col("lang"))).cast("long").alias("distance"))


SANDWICH_SQL = """flatten(list_transform({left}, lambda a: list_transform({right}, lambda b:
  list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, {n}), lambda i: {grid}[i + 1]::DOUBLE * a[i // {side} + 1] * b[i % {side} + 1])), lambda x, y: x + y))))"""


def sandwich_sql(left, grid: str, right, side: int) -> str:
    text = lambda m: "[" + ", ".join("[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in r) + "]" for r in m) + "]"
    return SANDWICH_SQL.format(left=text(left), right=text(right), grid=grid, n=side * side, side=side)


def _dct_sql() -> str:
    c = H.cosine_matrix(8)
    return f"""WITH x AS (SELECT vec_id, list_transform({sandwich_sql(c, "embedding", c, 8)}, lambda v: round(v, 6)) AS c FROM embeddings), y AS (SELECT vec_id, c, list_sort(c)[32] AS m FROM x)
SELECT vec_id, list_aggregate(list_transform(range(0, 16), lambda i: format('{{:x}}', list_sum(list_transform(range(0, 4), lambda j: (c[i * 4 + j + 1] > m)::INTEGER * (8 >> j)))::BIGINT)), 'string_agg', '') AS signature FROM y"""


@query("h8_cosine_signature", _dct_sql())
def _(t):
    return t("embeddings").select("vec_id", H.cosine_signature(F.col("embedding")).alias("signature"))


_HEX = "list_aggregate(list_transform(range(0, 64), lambda i: format('{{:x}}', list_sum(list_transform(range(0, 4), lambda j: ({0})::INTEGER * (8 >> j)))::BIGINT)), 'string_agg', '')"


@query("h8_cosine_signature_256", f"""
WITH x AS (SELECT vec_id, list_transform({sandwich_sql(H.low_frequencies(8), "embedding", H.low_frequencies(8), 8)}, lambda v: round(v, 6)) AS c FROM embeddings), y AS (SELECT vec_id, c, list_sort(c)[128] AS m FROM x)
SELECT vec_id, {_HEX.format("c[i * 4 + j + 1] > m")} AS signature FROM y""")
def _(t):
    return t("embeddings").select("vec_id", H.cosine_signature_256(F.col("embedding")).alias("signature"))


@query("h9_difference_signature_256", f"""
WITH x AS (SELECT vec_id, list_transform({sandwich_sql(H.stretched(8, 16), "embedding", H.stretched(8, 17), 8)}, lambda v: round(v, 6)) AS c FROM embeddings)
SELECT vec_id, {_HEX.format("c[i * 4 + j + (i * 4 + j) // 16 + 2] > c[i * 4 + j + (i * 4 + j) // 16 + 1]")} AS signature FROM x""")
def _(t):
    return t("embeddings").select("vec_id", H.difference_signature_256(F.col("embedding")).alias("signature"))


@query("h9_difference_signature", """
SELECT vec_id, list_aggregate(list_transform(range(0, 15), lambda i: format('{:x}', list_sum(list_transform(range(0, 4), lambda j: (embedding[i * 4 + j + 2] > embedding[i * 4 + j + 1])::INTEGER * (8 >> j)))::BIGINT)), 'string_agg', '') AS signature FROM embeddings""")
def _(t):
    return t("embeddings").select("vec_id", H.difference_signature(F.col("embedding"), 60).alias("signature"))


@query("h10_segment_signatures", """
WITH x AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+[ \\t\\n]*')) AS text FROM documents), y AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS s FROM x)
SELECT doc_id, count(*) AS segments, min(sha256(s)) AS lowest FROM y WHERE s <> '' GROUP BY 1""")
def _(t):
    s = H.segment_signatures(F.col("text"))
    return t("documents").select("doc_id", s.alias("s")).where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("segments"), F.array_min("s").alias("lowest"))


@query("h11_token_signature")
def _(t):
    return H.token_signature(t("documents"), "doc_id", "text")
