"""Quotas, stratified selection, top-k, admission: windows and small strata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalis.functions import identity as H
from curalis.functions.lineage import checkpointed, running_sums

MAX_STRATA = 1_000_000


def square_root_quotas(strata: DataFrame, total: int | str, cap: int | None = None, fill: bool = False, by: list[str] | None = None) -> DataFrame:
    """``total`` over strata (``_g``, ``n``) in proportion to the roots of their sizes: columns ``_g``, ``_quota``, and those of ``by``.

    Rounds of filling: each stratum with room (of its ``n`` and of ``cap``) gets the whole part of its share of what is left, one at
    least, in the order of ``_g`` while something is left. With ``by``, each of its groups has a total of its own, a column that
    ``total`` names. A total of more than there is fails, or with ``fill`` takes everything. Over ``MAX_STRATA`` strata are refused.
    """
    by = by or []
    most = F.least("n", F.lit(cap)) if cap is not None else F.col("n")
    asked = F.col(total) if isinstance(total, str) else F.lit(total)
    state = strata.where("n > 0").select(*by, "_g", "n", most.cast("long").alias("_room"), asked.cast("long").alias("_left"), F.lit(0).cast("long").alias("_quota"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # a bounded table of strata
    state = checkpointed(state.withColumn("_there", F.sum("_room").over(group)))
    if state.count() > MAX_STRATA:
        raise ValueError("too many strata")
    bad = state.where((F.col("_left") < 0) | (F.col("_left") > F.col("_there")) if not fill else F.col("_left") < 0).select("_left", "_there").first()
    if bad or not fill and not by and total and not state.limit(1).count():
        raise ValueError(f"{bad['_left'] if bad else total} records asked of {bad['_there'] if bad else 0}")
    state = state.withColumn("_left", F.least("_left", "_there"))
    before = group.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        state = state.withColumn("_w", F.when((F.col("_quota") < F.col("_room")) & (F.col("_left") > 0), F.sqrt("n")))
        share = F.greatest(F.lit(1), F.floor(F.col("_left") * F.col("_w") / F.sum("_w").over(group)))
        state = state.withColumn("_p", F.when(F.col("_w").isNotNull(), F.least(F.col("_room") - F.col("_quota"), share)).otherwise(0))
        given = F.greatest(F.lit(0), F.least("_p", F.col("_left") - F.coalesce(F.sum("_p").over(before), F.lit(0))))
        state = state.withColumn("_add", given)
        state = checkpointed(state.select(*by, "_g", "n", "_room", (F.col("_left") - F.sum("_add").over(group)).alias("_left"), (F.col("_quota") + F.col("_add")).alias("_quota")))
        if not state.where("_left > 0").limit(1).count():
            return state.select(*by, "_g", "_quota")


def strata(df: DataFrame, group: Column) -> DataFrame:
    """Rows of each stratum: columns ``_g``, ``n``."""
    return df.groupBy(group.cast("string").alias("_g")).agg(F.count("*").alias("n"))


def quota_table(df: DataFrame, quotas: dict[str, int]) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(quotas.items()), "_g string, _quota long")


def lowest_per_group(df: DataFrame, group: Column, quotas: DataFrame, rank: Column) -> DataFrame:
    """The rows of least rank in each group, as many as its quota (columns ``_g``, ``_quota``).

    The largest quota bounds the numbering first, as a literal: tasks keep no more rows of a group than that before the shuffle.
    """
    quotas = checkpointed(quotas)
    most = quotas.agg(F.max("_quota")).first()[0] or 0
    ranked = df.withColumn("_g", group.cast("string")).withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(rank)))
    return ranked.where(F.col("_n") <= F.lit(int(most))).join(quotas, "_g").where(F.col("_n") <= F.col("_quota")).drop("_g", "_n", "_quota")


def select_by_groups(df: DataFrame, total: int, group: Column, rank: Column, cap: int | None = None, fill: bool = False) -> DataFrame:
    """``total`` rows, spread over groups by the root of their sizes; see ``square_root_quotas``."""
    return lowest_per_group(df, group, square_root_quotas(strata(df, group), total, cap, fill), rank)


def even_quotas(names: DataFrame, total: int, name: str, by: list[str] | None = None) -> DataFrame:
    """``total`` in equal parts over the names (per ``by``), the remainder to the first in order."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(name))
    t = F.lit(total) if isinstance(total, int) else total
    return names.withColumn("quota", F.floor(t / n) + F.when(place <= t % n, 1).otherwise(0))


def bottom_k(df: DataFrame, by: list[str], rank: Column, k: Column | int, identity: str | None = None, most: int | None = None) -> DataFrame:
    """The ``k`` rows of least rank in each group; a repeated identity counts once.

    Where ``k`` is a column, ``most`` is the largest of its values; it bounds what tasks keep of a group before the shuffle.
    """
    rows = df.dropDuplicates([*by, identity]) if identity else df
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(rank)))
    most = k if isinstance(k, int) else most
    return (ranked if most is None else ranked.where(F.col("_n") <= F.lit(most))).where(F.col("_n") <= k).drop("_n")


def balanced_sample(df: DataFrame, label: str, most: int, rank: Column) -> DataFrame:
    """Half of ``most`` rows with label 0, the rest with label 1; all rows if there are no more."""
    target = F.when(F.col(label) == 0, most // 2).otherwise(most - most // 2)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(rank))).where(F.col("_n") <= F.lit(most))
    size = df.groupBy().agg(F.count("*").alias("_all"))
    return ranked.join(F.broadcast(size)).where((F.col("_n") <= target) | (F.col("_all") <= most)).drop("_n", "_all")


def weighted_targets(counts: DataFrame, total: int, name: str = "name", available: str = "n", weight: str = "weight") -> DataFrame:
    """Floors of weighted shares within what is there; what is missing goes to the heaviest first. A table of strata."""
    known = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    everything = Window.partitionBy(F.lit(0))
    first = counts.withColumn("_w", known).withColumn("_t", F.least(F.col(available), F.floor(F.lit(total) * F.col("_w") / F.sum("_w").over(everything))))
    order = everything.orderBy(F.desc("_w"), name).rowsBetween(Window.unboundedPreceding, -1)
    spare = F.col(available) - F.col("_t")
    deficit = F.lit(total) - F.sum("_t").over(everything)
    extra = F.greatest(F.lit(0), F.least(spare, deficit - F.coalesce(F.sum(spare).over(order), F.lit(0))))
    return first.withColumn("target", (F.col("_t") + extra).cast("long")).drop("_w", "_t")


def hold_out_groups(df: DataFrame, group: str, cap: int, target: int, seed: int) -> DataFrame:
    """Whole groups in hash order until their capped sizes reach the target."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("rank", H.stable_rank(seed, F.col(group)))
    own = F.least(F.col("n"), F.lit(cap))
    return running_sums(sizes, [], ["rank"], {"running": own}).where(F.col("running") - own < target).select(group, "n")


def roles(df: DataFrame, by: list[str], rank: Column, train: int, val: int, every: int = 14) -> DataFrame:
    """Role of each row by place in its group: training first, then validation; every so many of the rest a reserve.

    Places are running sums over ranges, so no task holds a group. ``rank`` tells the rows of a group apart.
    """
    n = running_sums(df.withColumn("_rank", rank), by, ["_rank"], {"_n": F.lit(1)})
    return n.withColumn("role", F.when(F.col("_n") <= train, "train").when(F.col("_n") <= train + val, "val")
                        .when((F.col("_n") - 1) % every == 0, "reserve")).drop("_n", "_rank")


def block_assignment(df: DataFrame, key: str, choices: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """One choice per row, in blocks that use each once, in a hashed order per block: counts differ by one at most.

    Places are running sums over ranges of the hashed order, so no task holds a group; ``key`` tells its rows apart.
    """
    k = len(choices)
    rows = running_sums(df.withColumn("_rank", H.stable_rank(seed, F.col(key))), by or [], ["_rank"], {"_place": F.lit(1)}).withColumn("_place", F.col("_place") - 1)
    block = F.floor(F.col("_place") / k)
    order = F.array_sort(F.array(*[F.struct(H.stable_rank(seed, F.lit(c), block).alias("r"), F.lit(c).alias("c")) for c in choices]))
    return rows.withColumn("choice", F.get(order, (F.col("_place") % k).cast("int"))["c"]).drop("_place", "_rank")


def whole_pairs(df: DataFrame, parent: str, label: str, split: str) -> DataFrame:
    """Rows of parents with one row of each label and a single split."""
    good = df.groupBy(parent).agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("b"),
                                  F.count_distinct(split).alias("s")).where("a = 1 AND b = 1 AND s = 1")
    return df.join(good.select(parent), parent, "left_semi")


def priority(df: DataFrame, bucket: list[str], digest: Column) -> DataFrame:
    """Exponential race with weight one over the root of the bucket's size: the least come first."""
    n = df.groupBy(*bucket).agg(F.count("*").alias("_n"))
    return df.join(n, bucket).withColumn("priority", -F.log(H.uniform(digest)) * F.sqrt("_n")).drop("_n")


def budget_prefix(df: DataFrame, size: str, order: list[str], budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order while the running size stays within the budget; ``order`` tells the rows of a group apart."""
    return running_sums(df, by or [], order, {"running": F.col(size)}).where(F.col("running") <= budget)


def contiguous(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Per group, whether its ``[start, end)`` ranges follow on from 0 without gap or overlap."""
    before = F.lag(end, 1, 0).over(Window.partitionBy(*by).orderBy(start))
    return df.withColumn("_ok", before == F.col(start)).groupBy(*by).agg(F.bool_and("_ok").alias("contiguous"), F.max(end).alias("covered"))


def improvements(df: DataFrame, by: str, order: str, metric: str) -> DataFrame:
    """Per row: best value before it, whether it improves on that, and rows since the last improvement."""
    w = Window.partitionBy(by).orderBy(order)
    best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("best_before", best).withColumn("improved", F.col("best_before").isNull() | (F.col(metric) > F.col("best_before"))).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("since_improvement", F.col("_n") - last).drop("_n")
