"""N-gram Jaccard join by chosen paths: sets meet where they sample the same shared tokens, level after level."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.common import connected_components, slots, stage, working
from curalis.llm.suffix_sort import VALUES, powers

WORDS = 5
SIMILARITY = 0.8
#: Sets choose a token with chance 1 / (SPLIT * size) in each node; lower than the similarity, so that similar pairs multiply.
SPLIT = 0.7
FIRST_DEPTH = 2
MAX_DEPTH = 6
BUCKET = 64
RECALL = 0.999
#: A sketch has so many min-hashes of 16 bits. Sets in one bucket whose sketches agree in this share are compared exactly.
SKETCH = 64
LOOSE = 0.6
#: A set like one that agrees in ``LOOSE`` with a pivot is at a Jaccard distance of 0.6 from the pivot at most (0.4 and 0.2
#: by the triangle inequality), so its sketch agrees with the pivot's in 0.4 on average; five standard deviations less are held.
BESIDE = 0.1
BLOCK_ROWS = 512
BLOCK_BYTES = 16 << 20

#: Odd multipliers of the words of a window, by place.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def survival(depth: int, overlap: float, split: float = SPLIT) -> float:
    """Chance that a pair with this overlap (shared tokens over the larger size) shares a node at ``depth`` in one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q * overlap / split)
    return q


def runs_for(recall: float, depth: int = MAX_DEPTH, overlap: float = SIMILARITY, split: float = SPLIT) -> int:
    """Runs until a pair at the threshold, of the least favourable sizes and in the deepest nodes, is found with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, overlap, split)))


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BREAK = re.compile(rb"[ \t\n\v\f\r]")


def word_hashes(data: bytes, segment: int = 1 << 20) -> np.ndarray:
    """Hash of every word, a run of bytes other than ASCII white space: differences of polynomial prefix sums.

    Long texts are taken in segments that end between words.
    """
    made, lo = [], 0
    while lo < len(data) or not made:
        found = _BREAK.search(data, lo + segment) if len(data) - lo > segment else None
        hi = found.end() if found else len(data)
        raw = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
        edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        up, down = powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUES[raw] * up[:len(raw)], out=sums[1:])
        made.append(mix((sums[end] - sums[start]) * down[start]))
        lo = hi
        if not len(data):
            break
    return made[0] if len(made) == 1 else np.concatenate(made)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct window hashes of a text. A text of fewer words is one window; without words it has none."""
    h = word_hashes(text.encode()) if text else np.zeros(0, np.uint64)
    n = len(h)
    if not n:
        return h
    k = min(width, n)
    code = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        code += h[i:n - k + 1 + i] * _PLACE[i % len(_PLACE)]
    return np.unique(mix(code))


def children(tokens: np.ndarray, nodes: np.ndarray, split: float) -> np.ndarray:
    """Nodes below ``nodes`` that this set goes to: one for each token it chooses in one of them."""
    if len(nodes) > 1 and len(nodes) * len(tokens) > 1 << 18:
        return np.concatenate([children(tokens, nodes[k:k + 1], split) for k in range(len(nodes))])
    h = (tokens[None, :] ^ nodes[:, None]) * _K1
    h ^= h >> np.uint64(32)
    h *= _K2
    chance = 1 / (split * len(tokens))
    return mix(h[h <= np.uint64(min(1.0, chance) * (2**64 - 2048))] + np.uint64(1))


def paths(tokens: np.ndarray, runs: int, depth: int, split: float) -> np.ndarray:
    """All nodes of a set at ``depth``, over all runs."""
    level = mix(np.arange(1, runs + 1, dtype=np.uint64))
    for _ in range(depth):
        level = children(tokens, level, split)
    return np.unique(level)


_SEEDS = (mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(7919)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(tokens: np.ndarray) -> bytes:
    """Low 16 bits of the least hash under each of ``SKETCH`` multipliers."""
    short = (tokens >> np.uint64(16)).astype(np.uint32)
    if len(short) <= 2048:
        least = (short[None, :] * _SEEDS[:, None]).min(axis=1)
    else:
        least = np.array([(short * s).min() for s in _SEEDS], np.uint32)
    return least.astype("<u2").tobytes()


def _sets(width: int, runs: int, split: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                keys, sizes, sketches, nodes = [], [], [], []
                for tokens in (shingles(t, width) for t in cut.column("text").to_pylist()):
                    some = len(tokens) > 0
                    keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if some else None)
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens) if some else None)
                    nodes.append(paths(tokens, runs, FIRST_DEPTH, split).view(np.int64) if some else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("did"), cut.column("digest"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sketches, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    names=["doc_id", "did", "digest", "sid", "n", "sketch", "nodes"])

    return run


def _split(width: int, split: float):
    """Rows (nodes, sid, text) -> (node, sid): the children of each crowded node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                out: tuple[list, list] = ([], [])
                for sid, tokens, nodes in zip(cut.column("sid").to_pylist(), cut.column("tokens").to_pylist(), cut.column("nodes").to_pylist(), strict=True):
                    tokens = np.frombuffer(tokens, np.uint64)
                    found = np.unique(children(tokens, np.array(nodes, np.int64).view(np.uint64), split)).view(np.int64).tolist()
                    out[0].extend(found)
                    out[1].extend([sid] * len(found))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["node", "sid"])

    return run


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                made = [shingles(t, width).tobytes() for t in cut.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column("sid"), pa.array(made, pa.binary())], names=["sid", "tokens"])

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in their first ``keys`` columns; the partition is sorted by these."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held[0][:keys], held
                held = []
            held.append(row)
    if held:
        yield held[0][:keys], held


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of crowded nodes beside one of them (..., sketch, pivot, pivot_sketch) -> the same with the share of min-hashes that agree."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in ("sketch", "pivot_sketch"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "sid", "vid", "pivot")), pa.array((a == b).mean(axis=1))],
                                             names=["node", "sid", "vid", "pivot", "agree"])


def _beside(share: float):
    """Blocks (pivot, inner block, outer block, inner, vid, sketch) -> an edge from each outer set to an inner one whose sketch agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            ids = np.array([r[4] for r in rows])
            s = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(len(rows), -1)
            inner = np.array([r[3] for r in rows])
            x, y = s[~inner], s[inner]
            agree = np.zeros((len(x), len(y)), np.int16)
            for k in range(s.shape[1]):
                agree += x[:, None, k] == y[None, :, k]
            if agree.size:
                best = agree.argmax(axis=1)
                hit = agree[np.arange(len(x)), best] >= share * s.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[~inner][hit]), pa.array(ids[inner][best[hit]])], names=["a", "b"])

    return run


#: Every two sets of a bucket of so many are compared side by side with those of other buckets; larger ones get a matrix each.
_SIDE_BY_SIDE = 8


def _sketches(column: pa.Array) -> np.ndarray:
    """Rows of min-hashes from a column of sketches of one length."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(column), -1).view("<u2")


def _held_together(rows: pa.RecordBatch, share: float) -> set[tuple[int, int]]:
    """Edges (larger id, smaller id) that hold together the sets of each bucket whose sketches agree; buckets are whole."""
    keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
    start = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
    size = np.diff(start, append=rows.num_rows)
    ids, s = rows.column(3).to_numpy(), _sketches(rows.column(4))
    least = share * s.shape[1]
    out: set[tuple[int, int]] = set()
    beside = np.repeat(np.where(size <= _SIDE_BY_SIDE, size, 0), size) - (np.arange(rows.num_rows) - np.repeat(start, size))  # rows from here to the bucket's end
    for d in range(1, _SIDE_BY_SIDE):
        i = np.flatnonzero(beside > d)
        for lo in range(0, len(i), 16384):
            k = i[lo:lo + 16384]
            k = k[(s[k] == s[k + d]).sum(axis=1) >= least]
            x, y = ids[k], ids[k + d]
            out.update(zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist(), strict=True))
    for lo, n in zip(start[size > _SIDE_BY_SIDE].tolist(), size[size > _SIDE_BY_SIDE].tolist(), strict=True):
        order = lo + np.argsort(ids[lo:lo + n], kind="stable")  # edges then lead to the smallest id, in every bucket
        part, own = s[order], ids[order]
        agree = np.zeros((n, n), np.int16)
        for k in range(s.shape[1]):
            agree += part[:, None, k] == part[None, :, k]
        label = forest(agree >= least)
        out.update((x, y) for x, y in zip(own.tolist(), own[label].tolist(), strict=True) if x != y)
    return out


def _loose(share: float):
    """Buckets (node, b1, b2, vid, sketch), sorted -> edges that hold together the sets whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, set()
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
                keys = [held.column(k).to_numpy() for k in range(3)]
                cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
                ready, held = (held.slice(0, int(cut[-1]) + 1), held.slice(int(cut[-1]) + 1)) if len(cut) else (None, held)
            else:
                ready = held if held is not None and held.num_rows else None
            if ready is not None:
                out |= _held_together(ready, share)
            if len(out) > 50_000 or batch is None and out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = set()

    return run


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Size of the intersection of every two sets, by products of indicator matrices over shared tokens."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    use = count[token] > 1
    token, owner = rank[token[use]], owner[use]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((n, n), np.int64)
    top = int(token[-1]) + 1 if len(token) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((n, min(width, top - lo)), np.float32)
        part[owner[a:b], token[a:b] - lo] = 1
        out += (part @ part.T).astype(np.int64)  # at most ``width``, so exact
    return out


def _exact(similarity: float):
    """Blocks of a loose component: (comp, b1, b2, block, vid, copies, tokens) -> links per set and edges.

    Output rows (a, b, links): an edge a-b with null links, or the links of a with null b. The
    similarity is taken as a fraction and compared in whole numbers.
    """
    part, whole = Fraction(similarity).limit_denominator(1_000_000).as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, b1, b2), rows in groups(batches, 3):
            sets = [np.frombuffer(r[6], np.uint64) for r in rows]
            block = np.array([r[3] for r in rows])
            copies = np.array([r[5] for r in rows], np.int64)
            size = np.array([len(x) for x in sets])
            linked = intersections(sets) * (whole + part) >= part * (size[:, None] + size[None, :])
            np.fill_diagonal(linked, False)
            if b1 != b2:
                linked &= block[:, None] != block[None, :]
            label = forest(linked)
            links = linked @ copies
            ids = [r[4] for r in rows]
            out += [(i, None, k) for i, k in zip(ids, links.tolist(), strict=True) if k]
            out += [(i, ids[k], None) for i, k in zip(ids, label.tolist(), strict=True) if i != ids[k]]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "links"])

    return run


def _blocks(members: DataFrame, limit_rows: int, limit_bytes: int, by: str, weight: str) -> DataFrame:
    """Deals each group ``by`` into blocks and each row to all pairs of its block: columns b1, b2, block. No block is unbounded."""
    need = F.ceil(F.greatest(F.count("*") / F.lit(limit_rows), F.sum(weight) / F.lit(limit_bytes))).cast("int")
    sizes = stage(members.groupBy(by).agg(F.greatest(need, F.lit(1)).alias("blocks")), "sizes")
    dealt = members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
                 recall: float = RECALL, split: float = SPLIT, bucket: int = BUCKET, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Documents whose sets of ``words``-word windows have a Jaccard similarity of ``similarity`` or more.

    One row per input row: doc_id, class_id (smallest doc_id reachable over links), n_links (other
    rows linked directly, copies included), copy_of (smallest doc_id with the same set), kept
    (doc_id = class_id). Steps:

    1. Rows with equal sets are one set. Each set follows the tokens it samples to its nodes at depth
       2, in as many runs as ``recall`` takes; sets that sample the same shared tokens meet.
    2. Nodes of one set are dropped, nodes of over ``bucket`` sets split again, down to ``max_depth``. Before
       that, sets like a crowded node's first one (its pivot) are held together with it and leave the
       node; those that stay but may be like one that left are looked up among these, in blocks. What
       is still crowded at ``max_depth`` is compared in blocks. In a bucket, sets whose sketches agree
       in ``LOOSE`` of their min-hashes are held together.
    3. Sets held together are compared exactly, block by block; links are counted there and not
       written as pairs.

    Words are runs of bytes other than ASCII white space. A text of fewer words than ``words`` has
    one window, all of it; a null text, or one without words, links with nothing. Null keys never
    become a class id; where a class has no other key, class_id is null and its rows are kept.
    Repeated rows are copies of each other. An empty table gives an empty result. Other columns are
    not read. Sets are told apart by 128-bit digests and numbered for the graph of links.
    """
    with working(docs.sparkSession) as keep:
        return keep(stage(_classes(docs, key, text, words, similarity, recall, split, bucket, max_depth), "joined"))


def _classes(docs: DataFrame, key: str, text: str, words: int, similarity: float, recall: float, split: float, bucket: int, max_depth: int) -> DataFrame:
    """``jaccard_join``, reading staged tables."""
    spark = docs.sparkSession
    runs = runs_for(recall, max_depth, similarity, split)
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    made = stage(read.mapInArrow(_sets(words, runs, split),
                                 "doc_id long, did long, digest string, sid binary, n long, sketch binary, nodes array<long>"), "sets")
    full = made.where("sid IS NOT NULL")
    sets = stage(full.groupBy("sid").agg(F.min(F.struct("did", "digest")).alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies"))
                 .select("sid", F.monotonically_increasing_id().alias("vid"), "rep.did", "rep.digest", "low", "copies"), "classes")
    reps = made.join(sets.select("sid", "did", "digest", "vid"), ["sid", "did", "digest"]).dropDuplicates(["sid"])
    reps = stage(reps.select("sid", "vid", "did", "digest", "sketch", "nodes"), "reps")

    light = reps.select("sid", "vid", "sketch")

    def parted(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (node, sid) of nodes of two sets or more, small and crowded."""
        counts = stage(members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "counts")
        both = stage(members.select("sid", "node").join(counts, "node"), "nodes")
        return both.where(F.col("size") <= bucket).select("sid", "node"), both.where(F.col("size") > bucket).select("sid", "node")

    small, crowded = parted(reps.select("sid", F.explode("nodes").alias("node")))
    buckets, depth = [small], FIRST_DEPTH
    tokens, families = None, None
    while crowded.limit(1).count():
        # a crowd of similar sets would stay together at any depth: those like the node's first set leave it here
        members = stage(crowded.join(light, "sid").select("node", "sid", "vid", "sketch"), "crowd")
        pivots = stage(members.groupBy("node").agg(F.min(F.struct("vid", "sketch")).alias("p")).select(
            "node", F.col("p.vid").alias("pivot"), F.col("p.sketch").alias("pivot_sketch")), "pivots")
        met = stage(members.join(pivots, "node").mapInArrow(_agreement, "node long, sid binary, vid long, pivot long, agree double"), "met")
        family = met.where(F.col("agree") >= BESIDE).groupBy("pivot", "vid").agg((F.max("agree") >= LOOSE).alias("inner"))
        families = family if families is None else families.unionByName(family)
        small, crowded = parted(met.where(F.col("agree") < LOOSE))
        buckets.append(small)
        if depth == max_depth:
            break
        if tokens is None:
            deep = crowded.select("sid").distinct().join(reps.select("sid", "did", "digest"), "sid")
            tokens = stage(read.select("did", "digest", "text").join(deep, ["did", "digest"]).dropDuplicates(["sid"]).select("sid", "text")
                           .mapInArrow(_tokens(words), "sid binary, tokens binary"), "tokens")
        below = crowded.groupBy("sid").agg(F.collect_list("node").alias("nodes")).join(tokens, "sid")
        members = stage(below.select("sid", "tokens", "nodes").repartition(slots(spark)).mapInArrow(_split(words, split), "node long, sid binary").distinct(), "members")
        small, crowded = parted(members)
        buckets.append(small)
        depth += 1
    def beside(families: DataFrame) -> DataFrame:
        """Edges between the sets that left a node with its pivot and those that stayed but may be like one of them, in blocks."""
        blocks = stage(families.groupBy("pivot").agg(*[
            F.ceil(F.count_if(F.col("inner") == side) / F.lit(BLOCK_ROWS)).cast("int").alias(name) for side, name in ((True, "inner_blocks"), (False, "outer_blocks"))])
            .where("outer_blocks > 0"), "beside")
        own = lambda name: F.pmod(F.xxhash64("vid"), F.col(name)).cast("int")
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        dealt = families.join(blocks, "pivot").join(light.select("vid", "sketch"), "vid")
        inner = dealt.where("inner").select("pivot", own("inner_blocks").alias("b1"), every("outer_blocks").alias("b2"), "inner", "vid", "sketch")
        outer = dealt.where("NOT inner").select("pivot", every("inner_blocks").alias("b1"), own("outer_blocks").alias("b2"), "inner", "vid", "sketch")
        return inner.unionByName(outer).repartition("pivot", "b1", "b2").sortWithinPartitions("pivot", "b1", "b2").mapInArrow(_beside(LOOSE), "a long, b long")

    near = None
    for part in buckets:
        near = part if near is None else near.unionByName(part)
    near = near.withColumns({"b1": F.lit(0), "b2": F.lit(0)}).join(light, "sid").select("node", "b1", "b2", "vid", "sketch")
    if crowded.limit(1).count():
        rest = _blocks(crowded.join(light, "sid").withColumn("weight", F.lit(1)), BLOCK_ROWS, BLOCK_BYTES, "node", "weight")
        near = near.unionByName(rest.select("node", "b1", "b2", "vid", "sketch"))
    near = near.repartition("node", "b1", "b2").sortWithinPartitions("node", "b1", "b2")
    edges = near.mapInArrow(_loose(LOOSE), "a long, b long")
    if families is not None:
        families = stage(families.groupBy("pivot", "vid").agg(F.max("inner").alias("inner")), "families")
        edges = edges.unionByName(families.where("inner").select(F.col("vid").alias("a"), F.col("pivot").alias("b"))).unionByName(beside(families))
    loose = connected_components(edges)

    linked = stage(sets.join(loose.withColumnRenamed("node", "vid"), "vid"), "linked")
    found = read.select("did", "digest", "text").join(linked.select("did", "digest", "sid"), ["did", "digest"]).dropDuplicates(["sid"])
    found = stage(found.select("sid", "text").mapInArrow(_tokens(words), "sid binary, tokens binary").join(
        linked.select("sid", "vid", "copies", "component"), "sid").withColumn("weight", F.length("tokens")), "found")
    pairs = _blocks(found, BLOCK_ROWS, BLOCK_BYTES, "component", "weight").select("component", "b1", "b2", "block", "vid", "copies", "tokens")
    pairs = pairs.repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2")
    exact = stage(pairs.mapInArrow(_exact(similarity), "a long, b long, links long"), "exact")
    links = exact.where("links IS NOT NULL").groupBy(F.col("a").alias("vid")).agg(F.sum("links").alias("links"))
    comps = connected_components(exact.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "vid")
    owners = comps.join(sets.select("vid", "low"), "vid")
    lowest = owners.groupBy("component").agg(F.min("low").alias("lowest"))
    outcome = stage(sets.select("sid", "vid", "low", "copies").join(links, "vid", "left").join(comps, "vid", "left").join(lowest, "component", "left")
                    .select("sid", F.col("low").alias("copy_of"), F.coalesce("lowest", "low").alias("class_id"),
                            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "outcome")
    alone = made.where("sid IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"))
    rows = full.select("doc_id", "sid").join(outcome, "sid").select("doc_id", "class_id", "n_links", "copy_of").unionByName(alone)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: five-word windows, Jaccard 0.8 or more."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
