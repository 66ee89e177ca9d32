"""Quota admission: what a walk through units in order lets in, found in rounds over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalis.functions.lineage import checkpointed, numbered, running_sums
from curalis.operators.selection import lowest_per_group, square_root_quotas, weighted_targets


def admit_units(members: DataFrame, edges: DataFrame | None, unit: str, order: list[str], caps: dict[str, tuple[Column, DataFrame]], *,
                required: tuple[str, ...] = (), deny: DataFrame | None = None, label: str | None = None, member: str | None = None,
                exact: bool = False) -> DataFrame:
    """Rows of ``members`` whose units a walk in ``order`` admits; a unit's rows enter or stay out together.

    ``caps`` maps a name to (key of a row, table ``_g``, ``_quota``): a row takes one place of its key; null keys take none. A unit is
    passed over if one of its keys is full; then if a row of it is the duplicate of a denied row or of a row of an admitted
    unit; else it is admitted. So a unit passed over for a full key strikes no duplicate of its own. Keys without a quota are
    never admitted under the caps in ``required``, and not limited under the others. ``order`` are columns of the unit (the
    least values of its rows count) and tell units apart. ``edges`` (a, b) holds duplicate pairs of values of ``member`` (or of
    units, if that is not given), ``deny`` those that equal a denied row. With ``label``, a duplicate with another label than the row
    that it equals fails the job, unless its unit is passed over for a full key. With ``exact``, quotas that are not met fail it.

    In rounds: a unit goes in when no better unit that is still open could fill its keys or strike it, and is rejected
    when admitted ones do. The first open unit is decided in every round, so rounds end. Chains, where each unit waits for one
    other alone, are settled within a round by doubling steps. Places are running sums over ranges, so no task holds a key.
    """
    member = member or unit
    units = members.groupBy(F.col(unit).alias("_u")).agg(*[F.min(c).alias(f"_o{k}") for k, c in enumerate(order)])
    units = checkpointed(numbered(units, [f"_o{k}" for k in range(len(order))], "_o").select("_u", "_o"))
    rows = members.select(F.col(unit).alias("_u"), F.col(member).alias("_m"), *([F.col(label).alias("_l")] if label else []),
                          *[c.cast("string").alias(f"_k{k}") for k, (c, _) in enumerate(caps.values())])
    claims, banned = None, units.select("_u").limit(0)
    for k, (name, (_, quotas)) in enumerate(caps.items()):
        own = rows.groupBy("_u", F.col(f"_k{k}").alias("_g")).agg(F.count("*").alias("_n"))
        own = own.join(quotas.select("_g", F.col("_quota").alias("_cap")), "_g", "left")
        if name in required:
            banned = banned.unionByName(own.where("_cap IS NULL").select("_u"))
        part = own.where("_cap IS NOT NULL").select("_u", F.concat(F.lit(f"{name}:"), "_g").alias("_key"), "_n", "_cap")
        claims = part if claims is None else claims.unionByName(part)
    claims = checkpointed(claims.join(units, "_u"))
    of = rows.select("_m", "_u").distinct()
    struck = of.join(deny.select(F.col(member).alias("_m")).distinct(), "_m", "left_semi").select("_u") if deny is not None else units.select("_u").limit(0)
    out = banned.withColumn("_b", F.lit(True)).unionByName(struck.withColumn("_b", F.lit(False))).groupBy("_u").agg(F.max("_b").alias("_banned"))
    state = units.join(out, "_u", "left").select("_u", "_o", F.when(F.col("_banned").isNotNull(), F.lit(False)).alias("_in"), F.coalesce("_banned", F.lit(False)).alias("_banned"))
    state = checkpointed(state)
    better = None
    if edges is not None:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.join(of.select(F.col("_m").alias("a"), F.col("_u").alias("_x")), "a").join(of.select(F.col("_m").alias("b"), F.col("_u").alias("_y")), "b")
        o = lambda u, n: units.select(F.col("_u").alias(u), F.col("_o").alias(n))
        pairs = both.where("_x <> _y").join(o("_x", "_ox"), "_x").join(o("_y", "_oy"), "_y").where("_oy < _ox")
        pairs = checkpointed(pairs.select("a", "b", "_x", "_y"))  # b's unit comes before a's
        better = checkpointed(pairs.select("_x", "_y").distinct())
    while state.where("_in IS NULL").limit(1).count():
        state = checkpointed(_round(state, claims, better))
    if label:
        _hold_labels(state, claims, rows, pairs if edges is not None else None, deny, member, label)
    chosen = state.where("_in").select(F.col("_u").alias(unit))
    if exact:
        _hold_quotas(members.join(chosen, unit, "left_semi"), caps)
    return members.join(chosen, unit, "left_semi")


def _places(state: DataFrame, claims: DataFrame) -> DataFrame:
    """Per unit: whether a key of it is full with better admitted units (``_full``), or may be with open ones too (``_tight``)."""
    live = claims.join(state.select("_u", "_in"), "_u")
    counts = {"_si": F.when(F.col("_in"), F.col("_n")).otherwise(0), "_so": F.when(F.coalesce("_in", F.lit(True)), F.col("_n")).otherwise(0)}
    sums = running_sums(live, ["_key"], ["_o"], counts)
    before = {k: F.col(k) - v for k, v in counts.items()}
    return sums.groupBy("_u").agg(F.bool_or(before["_si"] >= F.col("_cap")).alias("_full"), F.bool_or(before["_so"] >= F.col("_cap")).alias("_tight"))


def _round(state: DataFrame, claims: DataFrame, better: DataFrame | None) -> DataFrame:
    seen = state.join(_places(state, claims), "_u", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_full", "_tight")})
    if better is None:
        return seen.withColumn("_in", F.coalesce("_in", F.when(F.col("_full"), False).when(~F.col("_tight"), True))).select(*state.columns)
    met = better.join(state.select(F.col("_u").alias("_y"), F.col("_in").alias("_b")), "_y").groupBy(F.col("_x").alias("_u")).agg(
        F.coalesce(F.bool_or("_b"), F.lit(False)).alias("_hit"), F.count_if(F.col("_b").isNull()).alias("_waits"), F.max(F.when(F.col("_b").isNull(), F.col("_y"))).alias("_for"))
    seen = seen.join(met, "_u", "left").withColumns({"_hit": F.coalesce("_hit", F.lit(False)), "_waits": F.coalesce("_waits", F.lit(0))})
    now = F.when(F.col("_hit") | F.col("_full"), False).when((F.col("_waits") == 0) & ~F.col("_tight"), True)
    link = F.col("_in").isNull() & now.isNull() & ~F.col("_tight") & (F.col("_waits") == 1)
    seen = checkpointed(seen.select(*[c for c in state.columns if c != "_in"], F.coalesce("_in", now).alias("_in"), F.when(link, F.col("_for")).alias("_for")))
    links = seen.where("_for IS NOT NULL").select("_u", "_for", F.lit(True).alias("_turns"))  # in if the other is out
    if not links.limit(1).count():
        return seen.select(*state.columns)
    while links.join(links.select(F.col("_u").alias("_for")), "_for", "left_semi").limit(1).count():
        ahead = links.select(F.col("_u").alias("_for"), F.col("_for").alias("_next"), F.col("_turns").alias("_more"))
        links = checkpointed(links.join(ahead, "_for", "left").select("_u", F.coalesce("_next", "_for").alias("_for"),
                             F.when(F.col("_more").isNull(), F.col("_turns")).otherwise(F.col("_turns") != F.col("_more")).alias("_turns")))
    ends = links.join(seen.select(F.col("_u").alias("_for"), F.col("_in").alias("_end")), "_for").select("_u", (F.col("_end") != F.col("_turns")).alias("_then"))
    return seen.join(ends, "_u", "left").withColumn("_in", F.coalesce("_in", "_then")).select(*state.columns)


def _hold_labels(state: DataFrame, claims: DataFrame, rows: DataFrame, pairs: DataFrame | None, deny: DataFrame | None, member: str, label: str) -> None:
    """Fails on a duplicate with another label than the denied or admitted row that it equals."""
    met = None
    if pairs is not None:
        held = rows.join(state.where("_in").select("_u"), "_u", "left_semi").select(F.col("_m").alias("b"), F.col("_l").alias("_other"))
        met = pairs.join(held, "b").select(F.col("a").alias("_m"), "_other")
    if deny is not None:
        denied = deny.select(F.col(member).alias("_m"), F.col(label).alias("_other"))
        met = denied if met is None else met.unionByName(denied)
    if met is None:
        return
    passed = _places(state, claims).where("_full").select("_u").unionByName(state.where("_banned").select("_u"))
    found = rows.join(passed, "_u", "left_anti").join(met, "_m").where("_l <> _other").select("_m").first()
    if found:
        raise ValueError(f"{found[0]} has another label than its duplicate")


def _hold_quotas(chosen: DataFrame, caps: dict[str, tuple[Column, DataFrame]]) -> None:
    """Fails where the rows of a key are not as many as its quota."""
    for name, (key, quotas) in caps.items():
        there = chosen.groupBy(key.cast("string").alias("_g")).agg(F.count("*").alias("_n"))
        short = quotas.join(there, "_g", "left").where(F.coalesce("_n", F.lit(0)) != F.col("_quota"))
        found = short.select("_g", "_quota", F.coalesce("_n", F.lit(0)).alias("_n")).orderBy("_g").limit(20).collect()
        if found:
            raise ValueError(f"{name} quotas are not met: " + ", ".join(f"{r._g} {r._n} of {r._quota}" for r in found))


def admit(units: DataFrame, edges: DataFrame, key: str, order: str, caps: dict[str, DataFrame], *, deny: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """``admit_units`` for units of one row: ``caps`` maps columns to quotas, the first of them is required."""
    named = {name: (F.col(name), quotas) for name, quotas in caps.items()}
    return admit_units(units, edges, key, [order], named, required=(next(iter(caps)),), deny=deny, label=label)


def two_marginals(df: DataFrame, key: str, order: str, a: tuple[str, DataFrame], b: tuple[str, DataFrame], model: str, caps: DataFrame, total: int) -> DataFrame:
    """``total`` rows under a cap per ``model``, by passes in ``order``, with the number of the pass that took each.

    The first pass fills targets of both ``a`` and ``b`` (column, table ``_g``, ``_quota``), the second those of ``a`` alone, the third takes
    what the models' caps let in; every pass walks all rows that are left and counts those before it. Fewer than ``total`` fail.
    """
    rows = checkpointed(df)
    chosen = None
    whole = df.sparkSession.createDataFrame([("all", total)], "_g string, _quota long")
    for k in range(3):
        named = {"whole": (F.lit("all"), whole), "model": (F.col(model), caps)}
        if k < 2:
            named["a"] = F.col(a[0]), a[1]
        if k < 1:
            named["b"] = F.col(b[0]), b[1]
        rest = rows
        if chosen is not None:
            rest = rows.join(chosen.select(key), key, "left_anti")
            named = {n: (c, _left(chosen, c, q)) for n, (c, q) in named.items()}
        found = admit_units(rest, None, key, [order], named, required=tuple(named)).withColumn("pass", F.lit(k))
        chosen = checkpointed(found if chosen is None else chosen.unionByName(found))
        if chosen.count() >= total:
            break
    else:
        raise ValueError(f"{chosen.count()} of {total} rows under the caps")
    return chosen


def _left(chosen: DataFrame, key: Column, quotas: DataFrame) -> DataFrame:
    """Quotas less the rows that have been chosen."""
    used = chosen.groupBy(key.cast("string").alias("_g")).agg(F.count("*").alias("_n"))
    return checkpointed(quotas.join(used, "_g", "left").select("_g", F.greatest(F.lit(0), F.col("_quota") - F.coalesce("_n", F.lit(0))).alias("_quota")))


def marginal_targets(df: DataFrame, column: str, total: int, weights: dict[str, float]) -> DataFrame:
    """Targets of a column's values by ``weighted_targets``: ``_g``, ``_quota``."""
    given = df.sparkSession.createDataFrame(sorted(weights.items()), "name string, weight double")
    counts = df.groupBy(F.col(column).cast("string").alias("name")).agg(F.count("*").alias("n")).join(F.broadcast(given), "name", "left")
    return weighted_targets(counts, total).select(F.col("name").alias("_g"), F.col("target").alias("_quota"))


def successive_roles(parents: DataFrame, parent: str, group: str, source: str, amounts: list[tuple[str, int]], rank) -> DataFrame:
    """Parents drawn without replacement for one role after another: the columns of ``parents`` and ``role``.

    A role's amount is spread over groups by the roots of their sizes, a group's part over its sources in the same way; a
    source gives its parents of least ``rank(role)`` (a column). Whom a role takes is not there for the next. An amount of more
    than is left fails. ``parents`` has a row for each parent; null groups and sources are not drawn.
    """
    rest = checkpointed(parents.where(F.col(group).isNotNull() & F.col(source).isNotNull()))
    chosen = None
    for role, amount in amounts:
        counts = checkpointed(rest.groupBy(F.col(group).cast("string").alias("_a"), F.col(source).cast("string").alias("_b")).agg(F.count("*").alias("n")))
        outer = square_root_quotas(counts.groupBy(F.col("_a").alias("_g")).agg(F.sum("n").alias("n")), amount)
        inner = counts.join(outer.select(F.col("_g").alias("_a"), "_quota"), "_a").select("_a", F.col("_b").alias("_g"), "n", F.col("_quota").alias("_total"))
        quotas = square_root_quotas(inner, "_total", by=["_a"]).select(pair_key(F.col("_a"), F.col("_g")).alias("_g"), "_quota")
        took = lowest_per_group(rest, pair_key(F.col(group), F.col(source)), quotas, rank(role)).withColumn("role", F.lit(role))
        chosen = checkpointed(took if chosen is None else chosen.unionByName(took))
        rest = checkpointed(rest.join(chosen.select(parent), parent, "left_anti"))
    return chosen


def pair_key(a: Column, b: Column) -> Column:
    """One key of two values; the first's length keeps pairs apart."""
    return F.concat_ws("|", F.length(a.cast("string")).cast("string"), a.cast("string"), b.cast("string"))


def fixed_and_rooted(strata: DataFrame, total: int, fixed: dict[str, int], cap: int | None = None) -> DataFrame:
    """A table of quotas: ``fixed`` ones as they are given, the rest of ``total`` over the other strata by the roots of their sizes.

    A fixed stratum that has fewer rows than its quota fails.
    """
    given = strata.sparkSession.createDataFrame(sorted(fixed.items()), "_g string, _quota long")
    short = given.join(strata, "_g", "left").where(F.coalesce("n", F.lit(0)) < F.col("_quota")).select("_g").first()
    if short:
        raise ValueError(f"{short[0]} has fewer rows than its quota")
    others = strata.join(given.select("_g"), "_g", "left_anti")
    return given.unionByName(square_root_quotas(others, total - sum(fixed.values()), cap))
