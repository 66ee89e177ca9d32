"""Embedding near-duplicates by product quantisation: coarse lists, residual codes, table distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.chosen_path import forest, groups
from curalis.llm.common import DEFAULT_SEED, connected_components, slots, stage

COSINE = 0.9
#: The quantisers are fitted on at most so many distinct vectors, or 32 for each list, those with the least hashes; every vector is indexed.
SAMPLE = 20_000
SAMPLE_PER_LIST = 32
LEAST_LISTS = 64
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 64
LIST_ROWS = 1024
CHUNK = 1024


def lists_for(entries: int) -> int:
    """The power of two next to the root of the number of entries, 64 to 4096."""
    return int(min(MOST_LISTS, max(LEAST_LISTS, 2 ** round(math.log2(max(1, entries)) / 2))))


def margin_for(width: int) -> float:
    """The part of the largest distance of a link by which a query looks over a list's border, two over the root of the width: 0.25 at 64."""
    return min(1.0, 2 / math.sqrt(width))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of at most ``k`` clusters of the rows of ``x``."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        nearest = assign(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=len(centres))
        some = count > 0
        centres[some] = sums[some] / count[some, None]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a chunk of rows at a time."""
    square = (centres**2).sum(axis=1)[None, :]
    return np.concatenate([(square - 2 * x[k:k + CHUNK] @ centres.T).argmin(axis=1) for k in range(0, len(x), CHUNK)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centres, and per subspace the centres of what is left of a vector after its coarse centre."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int, seed: int = DEFAULT_SEED):
        rng = np.random.default_rng(seed)
        self.coarse = kmeans(sample, lists, rng)
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        rest = sample - self.coarse[assign(sample, self.coarse)]
        self.books = [kmeans(rest[:, a:b], codes, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the final remainder of each row."""
        at = assign(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([assign(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1)
        for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            rest[:, a:b] -= self.books[k][codes[:, k]]
        return at, codes.astype(np.uint8), np.sqrt((rest**2).sum(axis=1))

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """The lists whose border, the plane between their centre and the row's nearest, is within ``reach`` of each row."""
        square = (self.coarse**2).sum(axis=1)
        out = []
        for k in range(0, len(x), CHUNK):
            d = square[None, :] - 2 * x[k:k + CHUNK] @ self.coarse.T
            home = d.argmin(axis=1)
            apart = square[home][:, None] + square[None, :] - 2 * self.coarse[home] @ self.coarse.T
            inside = d - d[np.arange(len(d)), home][:, None] <= 2 * reach * np.sqrt(np.maximum(apart, 0)) + 1e-12
            out += [np.nonzero(row)[0] for row in inside]
        return out

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Per subspace, the products of each row with each centre."""
        return [x[:, a:b] @ book.T for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]

    def products(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of each row of ``x`` with each coded vector of list ``at``, by table look-up."""
        out = np.repeat((x @ self.coarse[at])[:, None], len(codes), axis=1)
        for k, table in enumerate(self.tables(x)):
            out += table[:, codes[:, k]]
        return out


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Indices of usable vectors, and these at length 1 in double precision."""
    at, rows = [], []
    for k, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        v = np.array(v, np.float64)
        if len(v) and np.isfinite(v).all():
            top = np.abs(v).max()
            if top > 0:
                v = v / top
                at.append(k)
                rows.append(v / np.sqrt((v * v).sum()))
    return np.array(at, np.int64), rows


def _unit(key: str, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit(batch.column(1).to_pylist())
            made: list = [None] * batch.num_rows
            for k, v in zip(at.tolist(), rows, strict=True):
                made[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "unit"])

    return run


def _index(model, reach: float):
    """Each vector once as a member of its list, and as a query of each list that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            at, codes, error = q.encode(x)
            near = [n.tolist() for n in q.probes(x, reach)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), batch.column("copies"), batch.column("unit"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(error), pa.array(near, pa.list_(pa.int32()))],
                names=["vid", "copies", "unit", "list", "codes", "error", "near"])

    return run


def _search(model, cosine: float):
    """One (list, member block, query block): links of each side and edges; see ``near_duplicates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = model.value
        for (at, _, _), rows in groups(batches, 3):
            members = [r for r in rows if r[3]]
            queries = [r for r in rows if not r[3]]
            if not members or not queries:
                continue
            ids = np.array([r[4] for r in members])
            y = np.frombuffer(b"".join(r[6] for r in members), np.float64).reshape(len(members), -1)
            codes = np.frombuffer(b"".join(r[8] for r in members), np.uint8).reshape(len(members), -1)
            error = np.array([r[9] for r in members])
            near = np.concatenate([np.asarray(r[10], np.int64) for r in members])
            owner = np.repeat(np.arange(len(members)), [len(r[10]) for r in members])
            copies = np.array([r[5] for r in members], np.int64)
            qid = np.array([r[4] for r in queries])
            x = np.frombuffer(b"".join(r[6] for r in queries), np.float64).reshape(len(queries), -1)
            home = np.array([r[7] for r in queries])
            qcopies = np.array([r[5] for r in queries], np.int64)
            # the true product differs from the looked-up one by the member's coding error at most
            may = q.products(x, at, codes) + error[None, :] >= cosine - 1e-9
            may &= qid[:, None] != ids[None, :]
            i, j = np.nonzero(may)
            exact = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            i, j = i[exact], j[exact]
            # where the member does not look into the query's list, this is the only place that sees the pair
            homes, home_at = np.unique(home, return_inverse=True)
            slot = np.minimum(np.searchsorted(homes, near), len(homes) - 1)
            looks = np.zeros((len(members), len(homes)), bool)
            there = homes[slot] == near
            looks[owner[there], slot[there]] = True
            one_sided = ~looks[j, home_at[i]]
            found: dict[int, int] = {}
            for who, much in ((qid[i], copies[j]), (ids[j[one_sided]], qcopies[i[one_sided]])):
                for v, k in zip(who.tolist(), much.tolist(), strict=True):
                    found[v] = found.get(v, 0) + k
            out = [(v, None, k) for v, k in found.items()]
            if len(i):
                nodes, place = np.unique(np.concatenate([qid[i], ids[j]]), return_inverse=True)
                a, b = place[:len(i)], place[len(i):]
                label = np.arange(len(nodes))
                while True:
                    new = label.copy()
                    np.minimum.at(new, a, label[b])
                    np.minimum.at(new, b, label[a])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                out += [(v, w, None) for v, w in zip(nodes.tolist(), nodes[label].tolist(), strict=True) if v != w]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, lists: int | None = None,
                    subspaces: int = SUBSPACES, codes: int = CODES, margin: float | None = None, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links between vectors of a cosine of ``cosine`` or more (double precision).

    One row per input row: vec_id, n_links (other rows linked directly, equal vectors included),
    component_id (smallest vec_id reachable), kept (vec_id = component_id). Equal vectors (after
    scaling) are one entry with a count. Every entry stands in the list of its nearest coarse
    centre and is looked up in that list and in those whose border lies within ``margin`` times the
    distance of vectors of cosine ``cosine`` (1: no link is lost); table look-ups plus the entry's coding
    error rule out what cannot reach ``cosine``, the rest is compared exactly. A pair is found if
    either side probes the other's list, and counted once for each side. Lists are dealt in blocks
    of about ``list_rows`` entries, queries too, so no task holds a list; links are counted inside
    tasks and never written as pairs, components get a spanning forest per block.

    Unless given, ``lists`` is near the root of the number of entries, so lists stay short as the table
    grows, and ``margin`` is two over the root of the vectors' length: dense clusters, which centres cut
    up, are looked up in more lists than sparse regions. The quantisers are fitted on ``sample`` entries,
    or 32 a list, at most; only which pairs are seen depends on them. Null vectors, null or non-finite components and zero vectors link with nothing; vectors of
    another length than most of the sample's are compared among those of their own length by a
    separate index. Null keys are kept and never become a component id. Repeated rows link with
    each other. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    made = stage(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
                 .mapInArrow(_unit(key, vector), "vec_id long, unit binary"), "unit")
    some = made.where("unit IS NOT NULL")
    digest = F.unhex(F.sha2("unit", 256)).alias("digest")
    entries = stage(some.select("vec_id", "unit", digest).groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
                    .withColumn("vid", F.monotonically_increasing_id()), "entries")
    exact = None
    widths = entries.groupBy(F.length("unit").alias("width")).agg(F.count("*").alias("n")).where("n > 1")
    for width, n in widths.collect():  # lengths that several entries have: as a rule one
        own = entries.where(F.length("unit") == width)
        own_lists = lists or lists_for(n)
        reach = (margin or margin_for(width // 8)) * math.sqrt(max(0.0, 2 - 2 * cosine))
        drawn = own.select("unit").orderBy(F.xxhash64("digest"), "digest").limit(max(sample, SAMPLE_PER_LIST * own_lists)).toArrow()["unit"].to_pylist()
        fitted = np.frombuffer(b"".join(drawn), np.float64).reshape(len(drawn), -1)
        model = spark.sparkContext.broadcast(Quantiser(fitted, own_lists, subspaces, codes))
        indexed = stage(own.select("vid", "copies", "unit").repartition(slots(spark)).mapInArrow(
            _index(model, reach), "vid long, copies long, unit binary, list int, codes binary, error double, near array<int>"), "indexed")
        size = stage(indexed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(list_rows)).cast("int").alias("list_blocks")), "lists")
        asked = indexed.withColumn("probe", F.explode("near"))
        asking = stage(asked.groupBy("probe").agg(F.ceil(F.count("*") / F.lit(list_rows)).cast("int").alias("query_blocks")), "asking")
        plan = stage(size.join(asking, size["list"] == asking["probe"]).select("list", "list_blocks", "query_blocks"), "plan")
        by_hash = lambda blocks: F.pmod(F.xxhash64("vid"), F.col(blocks)).cast("int")
        columns = ("at", "member_block", "query_block", "member", "vid", "copies", "unit", "home", "codes", "error", "near")
        member = (indexed.join(plan, "list").withColumn("member_block", by_hash("list_blocks"))
                  .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
                  .select(F.col("list").alias("at"), "member_block", "query_block", F.lit(True).alias("member"), "vid", "copies", "unit",
                          F.col("list").alias("home"), "codes", "error", "near"))
        query = (asked.withColumnRenamed("list", "home").join(plan, F.col("probe") == plan["list"]).withColumn("query_block", by_hash("query_blocks"))
                 .withColumn("member_block", F.explode(F.sequence(F.lit(0), F.col("list_blocks") - 1)))
                 .select(F.col("probe").alias("at"), "member_block", "query_block", F.lit(False).alias("member"), "vid", "copies", "unit", "home",
                         F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("near")))
        order = columns[:3]
        met = member.unionByName(query).repartition(*order).sortWithinPartitions(*order)
        part = stage(met.mapInArrow(_search(model, cosine), "a long, b long, links long"), "found")
        exact = part if exact is None else exact.unionByName(part)
    if exact is None:
        exact = spark.createDataFrame([], "a long, b long, links long")
    links = exact.where("b IS NULL").groupBy(F.col("a").alias("vid")).agg(F.sum("links").alias("links"))
    comps = connected_components(exact.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "vid")
    lowest = comps.join(entries.select("vid", "low"), "vid").groupBy("component").agg(F.min("low").alias("lowest"))
    outcome = stage(entries.select("vid", "digest", "low", "copies").join(links, "vid", "left").join(comps, "vid", "left").join(lowest, "component", "left").select(
        "digest", F.coalesce("lowest", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "outcome")
    rows = some.select("vec_id", digest).join(outcome, "digest").select("vec_id", "n_links", "component_id")
    alone = made.where("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: cosine 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
