"""Duplicate, leakage and reconciliation joins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalis.functions import identity as H
from curalis.functions.lineage import checkpointed


def verified_join(payload: DataFrame, chosen: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Chosen rows with their payload; ``violations`` names the columns on which the two sides differ."""
    left = chosen.select(key, *[F.col(c).alias(f"_{c}") for c in same])
    bad = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in same]))
    return payload.join(left, key).withColumn("violations", bad).drop(*[f"_{c}" for c in same])


def exact_duplicates(df: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """Rows (kept, discarded, kind): each row under the smallest key of its first digest that repeats.

    One pass over ``df`` and one small aggregate for each kind; a digest that many rows share is no
    group in any task, as least keys are found by partial aggregation and joined back.
    """
    rows = checkpointed(df.select(key, *digests))
    for kind in digests:
        least = rows.groupBy(kind).agg(F.min(key).alias(f"_kept_{kind}"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        rows = rows.join(least, kind, "left")
    found = F.coalesce(*[F.when(F.col(f"_kept_{k}") != F.col(key), F.struct(F.col(f"_kept_{k}").alias("kept"), F.lit(k).alias("kind"))) for k in digests])
    return rows.withColumn("_f", found).where("_f IS NOT NULL").select("_f.kept", F.col(key).alias("discarded"), "_f.kind")


# Fixed value: the share of all pairs that meet under a key of random signatures, over which comparing all pairs costs less than joining keys.
_CROWDED_KEYS = 1 / 500


def _chosen_parts(radius: int, digits: int, spare: int) -> list[list[tuple[int, int]]]:
    """For each key its parts, as first and last digit (exclusive)."""
    n = min(radius + 1 + spare, digits)
    edges = [k * digits // n for k in range(n + 1)]
    return [[(edges[p], edges[p + 1]) for p in c] for c in combinations(range(n), max(1, n - radius))]


def _cuts(signature: str, radius: int, digits: int, spare: int) -> Column:
    """Keys of a signature: it is cut into radius + 1 + spare parts, and every choice of 1 + spare parts is a key."""
    part = lambda low, high: F.substring(signature, low + 1, high - low)
    return F.array(*[F.struct(F.lit(k).alias("n"), F.concat(*[part(*p) for p in c]).alias("bits")) for k, c in enumerate(_chosen_parts(radius, digits, spare))])


def hamming_join(a: DataFrame, b: DataFrame, key_a: str, key_b: str, signature: str, radius: int, digits: int, spare: int = 0) -> DataFrame:
    """Pairs of signatures (hex strings of ``digits`` digits) that differ in at most ``radius`` bits.

    Of radius + 1 + spare parts, 1 + spare at least are equal: every choice of so many is a key; more ``spare`` parts make
    more and longer keys. ``radius`` is below ``digits``. Equal signatures meet once: the join runs on distinct signatures and
    its rows stand for all keys that have them, dealt to several tasks where a signature has many. Keys so short that a large
    share of all pairs would meet under one (12 bits of 60: some half) are no help: then ``signature_pairs`` compares all.
    """
    if radius >= digits:
        raise ValueError("the radius needs as many digits at least")

    def keyed(x: DataFrame, name: str) -> DataFrame:
        return x.select(signature).distinct().select(F.col(signature).alias(name), F.explode(_cuts(signature, radius, digits, spare)).alias("key")).select(name, "key.*")

    if sum(16.0 ** -sum(high - low for low, high in c) for c in _chosen_parts(radius, digits, spare)) > _CROWDED_KEYS:
        near = signature_pairs(a, b, signature, radius)
    else:
        met = keyed(a, "sa").join(keyed(b, "sb"), ["n", "bits"]).select("sa", "sb").distinct()
        near = met.withColumn("distance", H.hamming(F.col("sa"), F.col("sb"))).where(F.col("distance") <= radius)
    out = spread_join(a.select(F.col(key_a).alias("a"), F.col(signature).alias("sa")), near, "sa", "a")
    return spread_join(b.select(F.col(key_b).alias("b"), F.col(signature).alias("sb")), out, "sb", "b").select("a", "b", "distance")


def signature_pairs(a: DataFrame, b: DataFrame, signature: str, radius: int, most: int = 16_384) -> DataFrame:
    """All pairs of distinct signatures of equal length that differ in at most ``radius`` bits: columns sa, sb, distance.

    Every pair is compared, a block of up to about ``most`` signatures against another in each unit of work, so the time grows with
    the square of the table, dealt over tasks, and the memory of a task does not grow. Where ``a`` is ``b`` each pair is compared once.
    """
    same = a is b
    own = [checkpointed(x.select(F.col(signature).alias("_s")).where(F.col("_s").rlike("^[0-9A-Fa-f]+$")).distinct()) for x in ([a] if same else [a, b])]
    counts = [x.count() for x in own]
    size = min(most, max(2_048, max(counts) // 16))
    n = [max(1, -(-c // size)) for c in counts]
    dealt = lambda x, k: x.groupBy(F.length("_s").alias("_length"), F.pmod(F.xxhash64("_s"), F.lit(k)).cast("int").alias("_block")).agg(F.array_join(F.collect_list("_s"), "").alias("_all"))
    left, right = dealt(own[0], n[0]), dealt(own[-1], n[-1])
    tasks = min(2_000, 2 * n[0] * n[-1])
    on = ["_length", "_i", "_j"]
    left = left.select("_length", F.col("_block").alias("_i"), F.explode(F.sequence(F.col("_block") if same else F.lit(0), F.lit(n[-1] - 1))).alias("_j"), F.col("_all").alias("_x"))
    right = right.select("_length", F.explode(F.sequence(F.lit(0), F.col("_block") if same else F.lit(n[0] - 1))).alias("_i"), F.col("_block").alias("_j"), F.col("_all").alias("_y"))
    units = left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on).select("_length", F.lit(same) & (F.col("_i") < F.col("_j")), "_x", "_y")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        value = np.zeros(256, np.uint8)
        for k, c in enumerate("0123456789abcdef"):
            value[ord(c)] = value[ord(c.upper())] = k

        def words(text, length):
            """64 bits of all signatures at a time, a row for each 16 digits."""
            wide = -(-length // 16) * 16
            digits = np.zeros((len(text) // length, wide), np.uint8)
            digits[:, wide - length:] = value[np.frombuffer(text, np.uint8)].reshape(-1, length)
            return np.ascontiguousarray((digits[:, ::2] << 4 | digits[:, 1::2]).view(">u8").T.astype(np.uint64))

        def near(x, y):
            rows = max(1, 131_072 // y.shape[1])
            for at in range(0, x.shape[1], rows):
                part = x[:, at:at + rows]
                distance = np.bitwise_count(part[0][:, None] ^ y[0])
                for k in range(1, len(x)):
                    distance = np.add(distance, np.bitwise_count(part[k][:, None] ^ y[k]), dtype=np.int32)
                found = np.flatnonzero(distance <= radius)
                if len(found):
                    yield found // y.shape[1] + at, found % y.shape[1], distance.ravel()[found].astype(np.int32)

        def made(parts):
            sa, sb, distance = (np.concatenate(c) for c in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(sa).cast(pa.string()), pa.array(sb).cast(pa.string()), pa.array(distance)], ["sa", "sb", "distance"])

        for batch in batches:
            for length, both, *texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, y = (t.encode() for t in texts)
                names, parts, held = [np.frombuffer(t, f"S{length}") for t in (x, y)], [], 0
                for i, j, distance in near(words(x, length), words(y, length)):
                    parts.append((names[0][i], names[1][j], distance))
                    if both:
                        parts.append((names[1][j], names[0][i], distance))
                    held += len(i)
                    if held > 50_000:
                        yield made(parts)
                        parts, held = [], 0
                if parts:
                    yield made(parts)

    return units.mapInArrow(compare, "sa string, sb string, distance int")


def spread_join(rows: DataFrame, other: DataFrame, on: str, key: str, most: int = 10_000) -> DataFrame:
    """Inner join where rows of a value of ``on`` that has over ``most`` of them are dealt by ``key`` to parts; ``other`` goes to each part."""
    parts = rows.groupBy(on).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")
    dealt = rows.join(parts, on, "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).otherwise(0))
    copied = other.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0)))))
    return dealt.drop("_parts").join(copied.drop("_parts"), [on, "_part"]).drop("_part")


def near_signatures(a: DataFrame, b: DataFrame, key_a: str, key_b: str, p: str, d: str, radius_p: int, radius_d: int, digits: int = 64, crowded: int = 1_000) -> DataFrame:
    """Pairs whose signatures ``p`` differ in at most ``radius_p`` bits and ``d`` in at most ``radius_d``: columns a, b, p_distance, d_distance.

    Parts of ``p`` are keys, by pigeonhole; a key that over ``crowded`` distinct signatures share is refined by each part of
    ``d``, which loses no pair either. Distinct pairs of signatures meet once; see ``signature_candidates`` for their number.
    """
    near = signature_candidates(a, b, p, d, radius_p, radius_d, digits, crowded)
    near = near.withColumn("p_distance", H.hamming(F.col("pa"), F.col("pb"))).withColumn("d_distance", H.hamming(F.col("da"), F.col("db")))
    near = near.where((F.col("p_distance") <= radius_p) & (F.col("d_distance") <= radius_d))
    near = near.withColumn("sa", F.concat("pa", "da")).withColumn("sb", F.concat("pb", "db")).select("sa", "sb", "p_distance", "d_distance")
    own = lambda x, key, name: x.select(F.col(key).alias(name), F.concat(p, d).alias(f"s{name}"))
    out = spread_join(own(a, key_a, "a"), near, "sa", "a")
    return spread_join(own(b, key_b, "b"), out, "sb", "b").select("a", "b", "p_distance", "d_distance")


def signature_candidates(a: DataFrame, b: DataFrame, p: str, d: str, radius_p: int, radius_d: int, digits: int = 64, crowded: int = 1_000) -> DataFrame:
    """Distinct pairs of signatures (pa, da), (pb, db) that share a key; ``near_signatures`` verifies them."""
    if max(radius_p, radius_d) >= digits:
        raise ValueError("the radius needs as many digits at least")

    def keyed(x: DataFrame, name: str) -> DataFrame:
        own = x.where(F.col(p).isNotNull() & F.col(d).isNotNull()).select(F.col(p).alias(f"p{name}"), F.col(d).alias(f"d{name}")).distinct()
        return own.select("*", F.explode(_cuts(f"p{name}", radius_p, digits, 0)).alias("key")).select(f"p{name}", f"d{name}", "key.*")

    x, y = keyed(a, "a"), keyed(b, "b")
    many = x.unionByName(y.select(F.col("pb").alias("pa"), F.col("db").alias("da"), "n", "bits")).groupBy("n", "bits").agg(F.count("*").alias("_m")).where(F.col("_m") > crowded).select("n", "bits", F.lit(True).alias("_many"))

    def refined(x: DataFrame, name: str) -> DataFrame:
        more = F.when(F.col("_many"), _cuts(f"d{name}", radius_d, digits, 0)).otherwise(F.array(F.struct(F.lit(-1).alias("n"), F.lit("").alias("bits"))))
        return x.join(many, ["n", "bits"], "left").withColumn("_d", F.explode(more)).select(f"p{name}", f"d{name}", "n", "bits", F.col("_d.n").alias("m"), F.col("_d.bits").alias("more"))

    return refined(x, "a").join(refined(y, "b"), ["n", "bits", "m", "more"]).select("pa", "da", "pb", "db").distinct()


def near_segments(a: DataFrame, b: DataFrame, key_a: str, key_b: str, segments: str, radius: int, digits: int = 16, spare: int = 2, least: int = 1) -> DataFrame:
    """Pairs with at least ``least`` segments of a (arrays of hex strings) within ``radius`` bits of a segment of b: columns a, b, matched, closest.

    Distinct segments meet once, over keys of several parts. A segment that many rows hold is dealt to tasks by their keys, so that
    no task has all rows of one.
    """
    x = a.select(F.col(key_a).alias("_k"), F.explode(F.array_distinct(segments)).alias("_s"))
    y = b.select(F.col(key_b).alias("_k"), F.explode(F.array_distinct(segments)).alias("_s"))
    one = lambda z, name: z.select(F.col("_s").alias(name)).distinct().select(name, F.explode(_cuts(name, radius, digits, spare)).alias("key")).select(name, "key.*")
    met = one(x, "sa").join(one(y, "sb"), ["n", "bits"]).select("sa", "sb").distinct()
    near = met.withColumn("distance", H.hamming(F.col("sa"), F.col("sb"))).where(F.col("distance") <= radius)
    out = spread_join(x.select(F.col("_k").alias("a"), F.col("_s").alias("sa")), near, "sa", "a")
    out = spread_join(y.select(F.col("_k").alias("b"), F.col("_s").alias("sb")), out, "sb", "b")
    return out.groupBy("a", "b").agg(F.count_distinct("sa").alias("matched"), F.min("distance").alias("closest")).where(F.col("matched") >= least)


def segment_matches(a: DataFrame, b: DataFrame, key_a: str, key_b: str, segments: str) -> DataFrame:
    """Pairs that share a segment, and how many; rows of a segment that many rows of a hold are dealt to several tasks."""
    x = a.select(F.col(key_a).alias("a"), F.explode(F.array_distinct(segments)).alias("s"))
    y = b.select(F.col(key_b).alias("b"), F.explode(F.array_distinct(segments)).alias("s"))
    return spread_join(x, y, "s", "a").groupBy("a", "b").agg(F.count("*").alias("shared"))


def sharing_parents(df: DataFrame, protected: DataFrame, parent: str, segments: str) -> DataFrame:
    """Parents with a segment that ``protected`` has too: a semi-join on distinct segments, no pairs."""
    own = df.select(parent, F.explode(F.array_distinct(segments)).alias("_s"))
    return own.join(protected.select(F.explode(segments).alias("_s")).distinct(), "_s", "left_semi").select(parent).distinct()


def exclude_parents(df: DataFrame, parent: str, hits: DataFrame) -> DataFrame:
    """Rows whose parent has no hit; ``hits`` has the parent column."""
    return df.join(hits.select(parent).distinct(), parent, "left_anti")


def shared_digest_parents(df: DataFrame, parent: str, digest: str) -> DataFrame:
    """Parents with a record whose digest another record has too."""
    repeated = df.groupBy(digest).agg(F.count("*").alias("_n")).where("_n > 1").select(digest)
    return df.join(repeated, digest, "left_semi").select(parent).distinct()


def enrich(df: DataFrame, cache: DataFrame, keys: list[str], compute) -> DataFrame:
    """Cached results for the keys that are there, ``compute`` for the rest; cached keys that no row has are dropped."""
    hit = cache.join(df.select(*keys), keys, "left_semi")
    return hit.unionByName(compute(df.join(cache.select(*keys), keys, "left_anti")))


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` or ``unknown``."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(True)), actual.select(key).distinct().withColumn("_a", F.lit(True))
    return e.join(a, key, "full_outer").where("_e IS NULL OR _a IS NULL").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("unknown").alias("side"))


def flips(df: DataFrame, key: str, scenario: str, hit: Column, transformed: str, clean: str = "clean") -> DataFrame:
    """Keys right on clean rows and wrong under one transformation."""
    of = lambda s: F.max(F.when(F.col(scenario) == s, hit))
    return df.groupBy(key).agg(of(clean).alias("right_clean"), of(transformed).alias("right_transformed")).where("right_clean AND NOT right_transformed").select(key)


def opposite_class(df: DataFrame, group: str, label: str, value: str) -> DataFrame:
    """Per group and label side: its own rows and all rows of the other label, from two aggregates, not a theta join."""
    own = df.groupBy(group, label).agg(F.count("*").alias("own_n"), F.sum(value).alias("own_sum"))
    other = df.groupBy((1 - F.col(label)).alias(label)).agg(F.count("*").alias("other_n"), F.sum(value).alias("other_sum"))
    return own.join(other, label)


def label_conflicts(df: DataFrame, digest: str, label: str, fail: bool = False) -> DataFrame:
    """Digests whose rows have different labels, with the number of rows; with ``fail`` any such digest is an error."""
    found = df.groupBy(digest).agg(F.count("*").alias("n"), F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a <> _b").select(digest, "n")
    if fail and found.limit(1).count():
        raise ValueError("rows of equal content have different labels")
    return found


def declared_mismatches(df: DataFrame, key: str, declared: dict[str, str], found: dict[str, Column]) -> DataFrame:
    """Rows where a declared value differs from the recomputed one, nulls included: ``key`` and the names that differ."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(declared[n]).eqNullSafe(found[n]), F.lit(n)) for n in declared]))
    return df.select(key, wrong.alias("violations")).where(F.size("violations") > 0)


def sidecar_faults(base: DataFrame, side: DataFrame, part: str, place: str, key: str, same: list[str], version: str) -> DataFrame:
    """Parts of a base table that its sidecar does not match: ``part`` and ``faults``, an array of names; none where all is well.

    Per part (a range of rows) both sides are summed up, never listed: rows, versions, and sums of digests of the keys, of keys with their
    ``place``, and of keys with each column of ``same``. Faults: ``missing`` or ``unknown`` part, ``version``, ``rows``, ``keys``, ``order`` (the same
    keys at other places), and each column that differs for equal keys. Null keys and values count as a value of their own.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *[text(x) for x in c])), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = {"keys": number(key), "order": number(key, place), **{c: number(key, c) for c in same}}

    def summed(df: DataFrame, name: str) -> DataFrame:
        own = df.groupBy(part).agg(F.count("*").alias("rows"), F.min(text(version)).alias("low"), F.max(text(version)).alias("high"), *[F.sum(v).alias(f"sum_{k}") for k, v in sums.items()])
        return own.select(F.col(part).alias("_part"), F.struct(*own.columns[1:]).alias(name))

    both = summed(base, "a").join(summed(side, "b"), "_part", "full_outer")
    differ = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    same_keys = ~differ("rows") & ~differ("sum_keys")
    found = F.when(F.col("b").isNull(), F.array(F.lit("missing"))).when(F.col("a").isNull(), F.array(F.lit("unknown"))).otherwise(F.array_compact(F.array(
        F.when(differ("low") | differ("high"), F.lit("version")), F.when(differ("rows"), F.lit("rows")), F.when(~differ("rows") & differ("sum_keys"), F.lit("keys")),
        F.when(same_keys & differ("sum_order"), F.lit("order")), *[F.when(same_keys & differ(f"sum_{c}"), F.lit(c)) for c in same])))
    return both.select(F.col("_part").alias(part), found.alias("faults")).where(F.size("faults") > 0)
