"""Queries over quotas, selections, windows and admission."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curalis.functions import identity as H
from curalis.functions.lineage import checkpointed
from curalis.operators import admission as A
from curalis.operators import selection as W
from curalis.plans.base import query

_R = "sha256('7' || chr(0) || {0})"


def rank(c):
    return H.stable_rank(7, F.col(c))


def root_quotas(counts: str, total: str, cap: str = "n", by: str = "0", q: str = "q") -> str:
    """SQL (after WITH RECURSIVE; ``counts`` gives g, n, and p where ``by`` is p) for quotas by rounds of filling; ``total`` at most what is there."""
    return f"""{q}_c AS (SELECT *, least(n, {cap})::BIGINT AS room FROM ({counts}) WHERE n > 0),
{q}_r AS (SELECT *, 0::BIGINT AS quota, least({total}, sum(room) OVER (PARTITION BY {by}))::BIGINT AS rest FROM {q}_c
  UNION ALL SELECT * EXCLUDE given REPLACE (quota + given AS quota, (rest - sum(given) OVER (PARTITION BY {by}))::BIGINT AS rest) FROM (
    SELECT * EXCLUDE part, greatest(0, least(part, rest - coalesce(sum(part) OVER (PARTITION BY {by} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS given FROM (
      SELECT *, CASE WHEN quota < room THEN least(room - quota, greatest(1, floor(rest * sqrt(n) / sum(CASE WHEN quota < room THEN sqrt(n) END) OVER (PARTITION BY {by}))))::BIGINT ELSE 0 END AS part
      FROM {q}_r WHERE rest > 0))),
{q} AS (SELECT * EXCLUDE (n, room, rest) FROM {q}_r WHERE rest = 0)"""


@query("w1_square_root_quotas", f"""
WITH RECURSIVE {root_quotas("SELECT p_brand AS g, count(*) AS n FROM part GROUP BY 1", "500")} SELECT g AS p_brand, quota FROM q""")
def _(t):
    q = W.square_root_quotas(W.strata(t("part"), F.col("p_brand")), 500, fill=True)
    return q.select(F.col("_g").alias("p_brand"), F.col("_quota").alias("quota"))


@query("w2_select_by_groups", f"""
WITH RECURSIVE {root_quotas("SELECT lang AS g, count(*) AS n FROM documents GROUP BY 1", "300")},
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_R.format("doc_id")}) AS n FROM documents)
SELECT doc_id, lang FROM r JOIN q ON q.g = r.lang WHERE n <= quota""")
def _(t):
    return W.select_by_groups(t("documents"), 300, F.col("lang"), rank("doc_id"), fill=True).select("doc_id", "lang")


@query("w2_literal_quotas", f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_R.format("doc_id")}) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE n <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 15 ELSE 0 END""")
def _(t):
    q = W.quota_table(t("documents"), {"en": 40, "de": 20, "fr": 15})
    return W.lowest_per_group(t("documents"), F.col("lang"), q, rank("doc_id")).select("doc_id", "lang")


@query("w3_even_quotas", """
SELECT n_name, 103 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY n_name) <= 103 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM nation""")
def _(t):
    return W.even_quotas(t("nation"), 103, "n_name").select("n_name", "quota")


@query("w4_hierarchical", f"""
WITH cells AS (SELECT DISTINCT p_type, p_brand FROM part),
types AS (SELECT p_type, 200 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY p_type) <= 200 % count(*) OVER () THEN 1 ELSE 0 END AS tq FROM (SELECT DISTINCT p_type FROM part)),
q AS (SELECT p_type, p_brand, tq // count(*) OVER (PARTITION BY p_type) + CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_brand) <= tq % count(*) OVER (PARTITION BY p_type) THEN 1 ELSE 0 END AS quota FROM cells JOIN types USING (p_type)),
r AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY {_R.format("p_partkey")}) AS n FROM part)
SELECT p_partkey, p_type, p_brand FROM r JOIN q USING (p_type, p_brand) WHERE n <= quota""")
def _(t):
    part = t("part")
    types = W.even_quotas(part.select("p_type").distinct(), 200, "p_type").withColumnRenamed("quota", "tq")
    cells = W.even_quotas(part.select("p_type", "p_brand").distinct().join(types, "p_type"), F.col("tq"), "p_brand", ["p_type"])
    quotas = cells.select(F.concat_ws("|", "p_type", "p_brand").alias("_g"), F.col("quota").alias("_quota"))
    return W.lowest_per_group(part, F.concat_ws("|", "p_type", "p_brand"), quotas, rank("p_partkey")).select("p_partkey", "p_type", "p_brand")


@query("w5_bottom_k_per_shard", f"""
WITH r AS (SELECT d.doc_id, source, quality, row_number() OVER (PARTITION BY source, quality ORDER BY {_R.format("d.doc_id")}) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, source, quality FROM r WHERE n <= 3""")
def _(t):
    return W.bottom_k(t("documents").join(t("labels"), "doc_id"), ["source", "quality"], rank("doc_id"), 3).select("doc_id", "source", "quality")


@query("w6_balanced_sample", f"""
WITH r AS (SELECT d.doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_R.format("d.doc_id")}) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, toxic FROM r WHERE n <= CASE WHEN toxic = 0 THEN 30 ELSE 31 END""")
def _(t):
    return W.balanced_sample(t("documents").join(t("labels"), "doc_id"), "toxic", 61, rank("doc_id")).select("doc_id", "toxic")


@query("w7_diagnostic_sample", f"""
WITH r AS (SELECT d.doc_id, quality, source, {_R.format("d.doc_id")} AS rank FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT *, row_number() OVER (PARTITION BY quality, source ORDER BY rank) AS n FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY (n > 1)::INTEGER, CASE WHEN n = 1 THEN quality END, CASE WHEN n = 1 THEN source END, rank) AS place FROM n)
SELECT doc_id, quality, source, place FROM o WHERE place <= 100""")
def _(t):
    d = t("documents").join(t("labels"), "doc_id").withColumn("rank", rank("doc_id"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("quality", "source").orderBy("rank")))
    first = F.col("n") == 1
    order = [F.col("n") > 1, F.when(first, F.col("quality")), F.when(first, F.col("source")), F.col("rank")]
    top = d.orderBy(*order).limit(100)  # the sample's size bounds the numbering
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")).select("doc_id", "quality", "source", "place")


@query("w8_reservoir", f"""
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_R.format("l_partkey")}) AS n FROM d)
SELECT l_suppkey, l_partkey FROM r WHERE n <= 5""")
def _(t):
    return W.bottom_k(t("lineitem").select("l_suppkey", "l_partkey"), ["l_suppkey"], rank("l_partkey"), 5, "l_partkey")


@query("w9_weighted_targets", """
WITH c AS (SELECT p_type AS name, count(*) AS n, CASE p_type WHEN 'ECONOMY' THEN 6.0 WHEN 'STANDARD' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM part GROUP BY 1),
f AS (SELECT *, least(n, floor(1500 * w / sum(w) OVER ()))::BIGINT AS t FROM c),
x AS (SELECT *, 1500 - sum(t) OVER () AS deficit, coalesce(sum(n - t) OVER (ORDER BY w DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT name, n, (t + greatest(0, least(n - t, deficit - before)))::BIGINT AS target FROM x""")
def _(t):
    weight = F.when(F.col("p_type") == "ECONOMY", 6.0).when(F.col("p_type") == "STANDARD", 3.0).otherwise(1.0)
    c = t("part").groupBy(F.col("p_type").alias("name"), weight.alias("weight")).agg(F.count("*").alias("n"))
    return W.weighted_targets(c, 1500).select("name", "n", "target")


@query("w10_two_marginals", f"""
WITH RECURSIVE k AS (SELECT p_partkey, p_type, p_brand, p_size, concat_ws('|', p_type, p_brand) AS cell FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY {_R.format("p_partkey")}) <= 20),
{root_quotas("SELECT cell AS g, count(*) AS n FROM k GROUP BY 1", "600")},
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_R.format("p_partkey")}) AS n FROM k)
SELECT p_partkey, p_type, p_brand, p_size FROM r JOIN q ON q.g = r.cell WHERE n <= quota""")
def _(t):
    capped = W.bottom_k(t("part"), ["p_size"], rank("p_partkey"), 20)
    return W.select_by_groups(capped, 600, F.concat_ws("|", "p_type", "p_brand"), rank("p_partkey"), fill=True).select("p_partkey", "p_type", "p_brand", "p_size")


@query("w10_relaxed_passes")
def _(t):
    # half of the parts under targets of type and brand and a cap for each size; a test holds the passes against a walk
    part = t("part").select("p_partkey", "p_type", "p_brand", "p_size", rank("p_partkey").alias("r"))
    total = part.count() // 2
    types = A.marginal_targets(part, "p_type", total, {"ECONOMY": 5.0, "STANDARD": 3.0, "PROMO": 2.0})
    brands = A.marginal_targets(part, "p_brand", total, {f"Brand#{k}": float(k % 5 + 1) for k in range(11, 56)})
    caps = part.groupBy(F.col("p_size").cast("string").alias("_g")).agg(F.ceil(F.count("*") * 0.6).alias("_quota"))
    return A.two_marginals(part, "p_partkey", "r", ("p_type", types), ("p_brand", brands), "p_size", caps, total).select("p_partkey", "p_type", "p_brand", "p_size", "pass")


@query("w11_reserve_pruning", f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_R.format("doc_id")}) AS n FROM documents)
SELECT doc_id, source FROM r WHERE n <= CASE WHEN source IN ('src0', 'src1') THEN ceil(4 * 1.25) ELSE ceil(8 * 1.25) END""")
def _(t):
    cap = F.when(F.col("source").isin("src0", "src1"), F.ceil(F.lit(4 * 1.25))).otherwise(F.ceil(F.lit(8 * 1.25)))
    return W.bottom_k(t("documents"), ["source"], rank("doc_id"), cap, most=10).select("doc_id", "source")


@query("w12_successive_draws", f"""
WITH RECURSIVE {root_quotas("SELECT source AS g, count(*) AS n FROM documents GROUP BY 1", "100")},
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY {_R.format("doc_id")}) AS n FROM documents),
first AS (SELECT doc_id, lang, source FROM r JOIN q ON q.g = r.source WHERE n <= quota), left_ AS (SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM first)),
{root_quotas("SELECT lang AS g, count(*) AS n FROM left_ GROUP BY 1", "50", q="p")},
s AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {_R.format("doc_id")}) AS n FROM left_), second AS (SELECT doc_id, lang, source FROM s JOIN p ON p.g = s.lang WHERE n <= quota)
SELECT *, 'train' AS role FROM first UNION ALL SELECT *, 'val' FROM second""")
def _(t):
    d = t("documents").select("doc_id", "lang", "source")
    first = checkpointed(W.select_by_groups(d, 100, F.col("source"), rank("doc_id"), fill=True).withColumn("role", F.lit("train")))
    rest = d.join(first.select("doc_id"), "doc_id", "left_anti")
    return first.unionByName(W.select_by_groups(rest, 50, F.col("lang"), rank("doc_id"), fill=True).withColumn("role", F.lit("val")))


def _nested_role(k: int, role: str, amount: int) -> str:
    """SQL of one role: groups by roots, their sources by roots, then the parents of least rank; ``there{k}`` holds who is left."""
    return f"""{root_quotas(f"SELECT p_type AS g, count(*) AS n FROM there{k} GROUP BY 1", str(amount), q=f"o{k}")},
{root_quotas(f"SELECT p_type AS p, p_brand AS g, count(*) AS n, any_value(quota) AS total FROM there{k} JOIN o{k} ON o{k}.g = p_type GROUP BY ALL", "total", by="p", q=f"i{k}")},
took{k} AS (SELECT p_partkey, p_type, p_brand, '{role}' AS role FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY sha256('{role}' || chr(0) || p_partkey)) AS k FROM there{k})
  JOIN i{k} ON p = p_type AND g = p_brand WHERE k <= quota),
there{k + 1} AS (SELECT * FROM there{k} ANTI JOIN took{k} USING (p_partkey))"""


_ROLES = [("train", 80), ("val", 30), ("train reserve", 20), ("val reserve", 9)]


@query("w12_nested_roles", "WITH RECURSIVE there0 AS (SELECT p_partkey, p_type, p_brand FROM part), " + ", ".join(_nested_role(k, *r) for k, r in enumerate(_ROLES))
       + " " + " UNION ALL ".join(f"SELECT * FROM took{k}" for k in range(len(_ROLES))))
def _(t):
    by = lambda role: H.stable_rank(role, F.col("p_partkey"))
    return A.successive_roles(t("part").select("p_partkey", "p_type", "p_brand"), "p_partkey", "p_type", "p_brand", _ROLES, by)


@query("w13_roles", f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_R.format("doc_id")}) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN n <= 50 THEN 'train' WHEN n <= 70 THEN 'val' WHEN (n - 1) % 14 = 0 THEN 'reserve' END AS role FROM r""")
def _(t):
    return W.roles(t("documents"), ["lang"], rank("doc_id"), 50, 20).select("doc_id", "lang", "role")


@query("w14_hold_out_groups", f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), x AS (SELECT *, sum(least(n, 40)) OVER (ORDER BY {_R.format("source")} ROWS UNBOUNDED PRECEDING) - least(n, 40) AS before FROM s)
SELECT source, n FROM x WHERE before < 150""")
def _(t):
    return W.hold_out_groups(t("documents"), "source", 40, 150, 7)


@query("w15_block_assignment", f"""
WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_R.format("o_orderkey")}) - 1 AS place FROM orders),
c AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS choice),
b AS (SELECT block, choice, row_number() OVER (PARTITION BY block ORDER BY sha256('7' || chr(0) || choice || chr(0) || block)) - 1 AS k FROM (SELECT DISTINCT place // 5 AS block FROM p), c)
SELECT o_orderkey, choice FROM p JOIN b ON block = place // 5 AND k = place % 5""")
def _(t):
    return W.block_assignment(t("orders"), "o_orderkey", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 7, ["o_orderstatus"]).select("o_orderkey", "choice")


@query("w15_block_counts")
def _(t):
    return W.block_assignment(t("orders"), "o_orderkey", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 7, ["o_orderstatus"]).groupBy("o_orderstatus", "choice").agg(F.count("*").alias("n"))


@query("w16_whole_pairs", """
WITH x AS (SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 0 END AS label FROM conversations),
g AS (SELECT conv_id FROM x GROUP BY 1 HAVING count(*) FILTER (label = 0) = 1 AND count(*) FILTER (label = 1) = 1)
SELECT conv_id, turn, role FROM x WHERE conv_id IN (SELECT conv_id FROM g)""")
def _(t):
    c = t("conversations").withColumn("label", F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 0)).withColumn("split", F.lit("train"))
    return W.whole_pairs(c, "conv_id", "label", "split").select("conv_id", "turn", "role")


@query("w17_capacity", """
WITH g AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, sum(least(n, CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 150 END))::BIGINT AS capacity, sum(least(n, CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 150 END)) >= 10000 AS enough FROM g GROUP BY 1""")
def _(t):
    cap = F.when(F.col("l_suppkey") % 2 == 0, 100).otherwise(150)
    g = t("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return g.groupBy("l_returnflag").agg(F.sum(F.least("n", cap)).alias("capacity")).withColumn("enough", F.col("capacity") >= 10000)


@query("w18_priority", f"""
WITH x AS (SELECT doc_id, count(*) OVER (PARTITION BY lang, source) AS n, (('0x' || substr({_R.format("doc_id")}, 1, 13))::BIGINT + 1) / (pow(2.0, 52) + 1) AS u FROM documents)
SELECT doc_id, round(-ln(u) * sqrt(n), 9) AS priority FROM x""")
def _(t):
    return W.priority(t("documents"), ["lang", "source"], rank("doc_id")).select("doc_id", F.round("priority", 9).alias("priority"))


@query("w19_admission_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END DESC, source, {_R.format("doc_id")}) AS place FROM documents""")
def _(t):
    # the total order by a range sort; numbers are each partition's first number plus the place in it
    p = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 1).otherwise(0)
    d = t("documents").select("doc_id", (-p).alias("p"), "source", rank("doc_id").alias("r"))
    part = checkpointed(d.repartitionByRange("p", "source", "r").withColumn("part", F.spark_partition_id()))
    sizes = part.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("p", "source", "r"))
    return part.withColumn("k", inside).join(F.broadcast(sizes), "part").select("doc_id", (F.col("before") + F.col("k")).alias("place"))


@query("w20_admission")
def _(t):
    # one copy of each text, by a cap of one for each digest; rows whose canonical texts agree are duplicates of the first.
    # A test holds the walk against a sequential one.
    d = t("documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"), H.content_digest(H.canonical_text(F.col("text"))).alias("c"), rank("doc_id").alias("r"))
    d = checkpointed(d)
    edges = d.join(d.groupBy("c").agg(F.min_by("doc_id", "r").alias("b")), "c").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    copies = d.select(F.col("h").alias("_g")).distinct().withColumn("_quota", F.lit(1).cast("long"))
    caps = {"lang": W.quota_table(d, {"en": 60, "de": 40, "fr": 40, "es": 40}), "source": W.quota_table(d, {"src0": 50}), "h": copies}
    return A.admit(d.drop("c"), edges, "doc_id", "r", caps).select("doc_id", "lang", "source")


@query("w20_units")
def _(t):
    # conversations enter with their first question and answer or not at all, before documents; one unit for each text.
    # A test holds units, caps and quotas against a sequential walk.
    turn = t("conversations").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user"),
                                                     F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant"))
    unit = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("user", "assistant")]))
    pairs = turn.where("user IS NOT NULL AND assistant IS NOT NULL").select(unit.alias("unit"), F.lit(0).alias("p"), F.lit(None).cast("string").alias("source"), sides.alias("m")).select("unit", "p", "source", "m.*")
    own = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("unit"), F.lit(1).alias("p"), "source", F.col("lang").alias("side"), "text")
    members = pairs.unionByName(own).withColumn("h", H.content_digest(H.canonical_text(F.col("text")))).withColumn("r", rank("unit")).drop("text")
    members = checkpointed(members.withColumn("m", F.concat_ws(":", "unit", "side")))
    once = members.select(F.col("h").alias("_g")).distinct().withColumn("_quota", F.lit(1).cast("long"))
    caps = {"side": (F.col("side"), W.quota_table(members, {"user": 20, "assistant": 20, "en": 60, "de": 30, "fr": 30})), "source": (F.col("source"), W.quota_table(members, {"src0": 12, "src1": 4})),
            "text": (F.col("h"), once)}
    return A.admit_units(members, None, "unit", ["p", "r"], caps, required=("side",), member="m").select("unit", "side", "source")


@query("w20_one_per_text", f"""
WITH d AS (SELECT doc_id, lang, sha256(text) AS h, {_R.format("doc_id")} AS r FROM documents),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY r) = 1)
SELECT doc_id, lang FROM f""")
def _(t):
    d = t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"), rank("doc_id").alias("r"), F.lit("all").alias("whole"))
    best = d.groupBy("h").agg(F.min_by("doc_id", "r").alias("b"))
    edges = d.join(best, "h").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")  # copies lead to the best of them
    return A.admit(d.drop("h"), edges, "doc_id", "r", {"whole": W.quota_table(d, {"all": 1 << 40})}).select("doc_id", "lang")


@query("w21_budget_prefix", f"""
SELECT * FROM (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY {_R.format("doc_id")} ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 100000""")
def _(t):
    d = t("documents").select("doc_id", "lang", "n_chars", rank("doc_id").alias("r"))
    return W.budget_prefix(d, "n_chars", ["r"], 100000, ["lang"]).select("doc_id", "lang", "running")


_FAMILIES = ("ECONOMY", "STANDARD", "PROMO")


@query("w22_fixed_quotas", f"""
WITH RECURSIVE {root_quotas("SELECT p_brand AS g, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#13', 'Brand#21') GROUP BY 1", "93", "15")} SELECT g AS p_brand, quota FROM q
UNION ALL SELECT * FROM (VALUES ('Brand#13', 5), ('Brand#21', 2)) AS fixed(p_brand, quota)""")
def _(t):
    q = A.fixed_and_rooted(W.strata(t("part"), F.col("p_brand")), 100, {"Brand#13": 5, "Brand#21": 2}, 15)
    return q.select(F.col("_g").alias("p_brand"), F.col("_quota").alias("quota"))


@query("w22_quota_table", "\nUNION ALL ".join(
    "SELECT * FROM (WITH RECURSIVE " + root_quotas(f"SELECT p_brand AS g, count(*) AS n FROM part WHERE p_type = '{kind}' GROUP BY 1", "100", "1000") + f" SELECT '{kind}' AS p_type, g AS p_brand, quota FROM q)"
    for kind in _FAMILIES))
def _(t):
    out = None
    for kind in _FAMILIES:
        own = W.strata(t("part").where(F.col("p_type") == kind), F.col("p_brand"))
        q = W.square_root_quotas(own, 100, 1000, fill=True).select(F.lit(kind).alias("p_type"), F.col("_g").alias("p_brand"), F.col("_quota").alias("quota"))
        out = q if out is None else out.unionByName(q)
    return out


@query("w23_contiguous", """
WITH x AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 - 10 AS s, o_orderkey FROM orders),
y AS (SELECT o_custkey, s, s + CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE 10 END AS e FROM x), z AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY o_custkey ORDER BY s), 0) = s AS ok FROM y)
SELECT o_custkey, bool_and(ok) AS contiguous, max(e)::BIGINT AS covered FROM z GROUP BY 1""")
def _(t):
    s = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 10 - 10).cast("long")
    x = t("orders").withColumn("s", s).withColumn("e", F.col("s") + F.when(F.col("o_orderkey") % 97 == 0, 9).otherwise(10))
    return W.contiguous(x, ["o_custkey"], "s", "e")


@query("w24_improvements", """
WITH x AS (SELECT event_id, user_id, value, max(value) OVER w AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, b IS NULL OR value > b AS improved FROM x)
SELECT event_id, user_id, b AS best_before, improved, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS since_improvement FROM y""")
def _(t):
    e = t("events").select("event_id", "user_id", "ts", "value")
    return W.improvements(e, "user_id", "ts", "value").select("event_id", "user_id", "best_before", "improved", F.col("since_improvement").cast("long").alias("since_improvement"))
