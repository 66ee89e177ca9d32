"""Removes every byte that lies in a long string which also starts elsewhere in the corpus."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.common import stage, working
from curalis.llm.suffix_sort import Texts, anchors, extents, word_anchors, words

LENGTH = 400
GRAM = 64
#: A passage that other documents share: so many words, and how many of them an anchor has.
PASSAGE_WORDS = 50
WORD_GRAM = 8
#: Anchors with more kinds of context are compared by window hashes over many tasks instead of in one.
MAX_GROUP = 4096
#: Kinds of context of a hot anchor for each bucket of window hashes; there are at least ``BUCKETS``.
BUCKET_KINDS = 1024
BUCKETS = 64
_SORT_ROWS = 4000
_NO_KEY = -(1 << 63)

_FOUND = ("rid long, did long, digest string, n_bytes long, pos array<int>, h array<long>, c array<long>, d array<long>, "
          "own array<struct<h: long, c: long, d: long, lo: int, hi: int>>, n_words long, grams array<struct<w: long, v: long>>")
_CONTEXT = "g long, h long, rid long, pos int, wanted boolean, several boolean, before binary, after binary"
_SPAN = "rid long, lo int, hi int"
_MATCHED = "h long, rid long, pos int, several boolean, lo int, hi int"


def _context_digests(data: bytes, at: list[int], length: int, back: int) -> list[bytes]:
    """16 bytes of BLAKE2 for each anchor's context and place in it: ``back`` bytes before it and ``length`` from it on, less at a text's ends."""
    made = []
    for p in at:
        lo = p - back if p > back else 0
        made.append(hashlib.blake2b(data[lo:p + length], digest_size=16, salt=(p - lo).to_bytes(4, "little")).digest())
    return made


def _word_grams(data: bytes, passage: int) -> tuple[int, np.ndarray]:
    """Number of words, and each different pair of an anchor's hash and its window's."""
    starts, ends = words(data)
    _, w, v = word_anchors(data, starts, ends, passage, min(WORD_GRAM, passage))
    pairs = np.stack([w, v], axis=1).view(np.int64)
    if len(set(w.tolist())) < len(w):
        pairs = np.unique(pairs, axis=0)
    return len(starts), pairs


def _anchors(length: int, gram: int, passage: int):
    """Anchors of each text, each context twice at most; where a text repeats one, ``own`` has the spans of all its places.

    With ``passage`` its anchors among words too.
    """
    back = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                cut = batch.slice(lo, 512)
                sizes, made, own, counts, grams = [], [], [], [], []
                for text in cut.column("text").to_pylist():
                    data = text.encode() if text else b""
                    at, h = anchors(data, length, gram)
                    sizes.append(len(data))
                    if passage:
                        n_words, pairs = _word_grams(data, passage)
                        counts.append(n_words)
                        grams.append(pairs)
                    digests = _context_digests(data, at.tolist(), length, back)
                    spans: list[dict] = []
                    if len(set(digests)) < len(digests):
                        count, last, seen, first = Counter(digests), {}, Counter(), []
                        for k, (p, x) in enumerate(zip(at.tolist(), digests, strict=True)):
                            seen[x] += 1
                            if seen[x] < 3:
                                first.append(k)
                            if count[x] < 2:
                                continue
                            a, b = max(p - back, 0), min(p + length, len(data))
                            if x in last and a <= last[x]["hi"]:
                                last[x]["hi"] = b
                            else:
                                c, d = np.frombuffer(x, np.int64).tolist()
                                last[x] = {"h": int(h[k].astype(np.int64)), "c": c, "d": d, "lo": a, "hi": b}
                                spans.append(last[x])
                        at, h, digests = at[first], h[first], [digests[k] for k in first]
                    own.append(spans)
                    made.append((at.astype(np.int32), h.view(np.int64), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in made])]), pa.int32())
                both = np.concatenate([x[2] for x in made])
                flat = [pa.array(np.concatenate([x[k] for x in made])) for k in range(2)] + [pa.array(both[:, k].copy()) for k in range(2)]
                if passage:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in grams])]), pa.int32())
                    pairs = np.concatenate(grams)
                    of_words = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pairs[:, k].copy()) for k in range(2)], names=["w", "v"]))
                else:
                    counts = [None] * cut.num_rows
                    of_words = pa.nulls(cut.num_rows, pa.list_(pa.struct([("w", pa.int64()), ("v", pa.int64())])))
                ids = pa.array(np.arange(next_id, next_id + cut.num_rows))
                next_id += cut.num_rows
                yield pa.RecordBatch.from_arrays(
                    [ids, cut.column("did"), cut.column("digest"), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(offsets, x) for x in flat),
                     pa.array(own, pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))),
                     pa.array(counts, pa.int64()), of_words],
                    names=["rid", "did", "digest", "n_bytes", "pos", "h", "c", "d", "own", "n_words", "grams"])

    return run


def _passages(passage: int):
    """Per text: 16 bytes of BLAKE2 of each different window of ``passage`` words, joined by a blank, over one of its anchors asked for."""
    width = min(WORD_GRAM, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                ids, keys = [], []
                for r in batch.slice(lo, 64).to_pylist():
                    data = r["text"].encode()
                    starts, ends = words(data)
                    at, w, _ = word_anchors(data, starts, ends, passage, width)
                    at = at[np.isin(w.view(np.int64), np.array(r["asked"], np.int64))]
                    # windows that start at most passage - width words before an anchor
                    opened = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(opened, np.maximum(at - (passage - width), 0), 1)
                    np.add.at(opened, at + 1, -1)
                    begin = np.flatnonzero(np.cumsum(opened[:max(0, len(starts) - passage + 1)]) > 0)
                    joined = b" ".join(data.split())
                    place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
                    found = {hashlib.blake2b(joined[a:b], digest_size=16).digest()
                             for a, b in zip(place[begin].tolist(), (place[begin + passage] - 1).tolist(), strict=True)}
                    ids += [r["rid"]] * len(found)
                    keys += found
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["rid", "k"])

    return run


def _contexts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(lo, 64).to_pylist():
                    data = r["text"].encode()
                    for s in r["spots"]:
                        p = s["pos"]
                        rows.append((s["g"], s["h"], r["rid"], p, s["wanted"], s["several"], data[max(0, p - length + gram):p], data[p:p + length]))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                     names=["g", "h", "rid", "pos", "wanted", "several", "before", "after"])

    return run


def _reached(rid: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Span rows of contexts that reach anywhere."""
    some = (left > 0) | (right > 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(rid[some]), pa.array((pos - left)[some].astype(np.int32)), pa.array((pos + right)[some].astype(np.int32))], names=["rid", "lo", "hi"])


def _match(length: int):
    """Contexts sorted by anchor -> spans; whole groups of equal anchors are suffix-sorted together."""

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        _, group = np.unique(rows.column("g").to_numpy(), return_inverse=True)
        wanted, several = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("wanted", "several"))
        left, right = extents(Texts.column(rows.column("before"), back=True), Texts.column(rows.column("after")), group, length, wanted=wanted)
        size = [pc.binary_length(rows.column(c)).to_numpy() for c in ("before", "after")]
        if ((left < size[0]) | (right < size[1]))[wanted & several].any():
            raise ValueError("contexts of one digest differ")
        some = wanted & ((left > 0) | (right > 0))
        pos = rows.column("pos").to_numpy().astype(np.int64)
        made = [pa.array((pos - left).astype(np.int32)), pa.array((pos + right).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("h", "rid", "pos", "several")), *made], names=["h", "rid", "pos", "several", "lo", "hi"]).filter(pa.array(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _SORT_ROWS):
                part = batch.slice(lo, _SORT_ROWS)
                held = pa.concat_batches([held, part]) if held is not None else part
                if held.num_rows > _SORT_ROWS:  # all but the last group of equal anchors, of which more may follow
                    h = held.column("g").to_numpy()
                    cut = int(np.flatnonzero(h[1:] != h[:-1])[-1]) + 1 if h[0] != h[-1] else 0
                    if cut:
                        yield settle(held.slice(0, cut))
                        held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held)

    return run


def _window_keys(pdf: pd.DataFrame, length: int):
    """For each offset d: the rows that have a window starting d before the anchor, and its two 64-bit hashes."""
    before, after = pdf["before"].tolist(), pdf["after"].tolist()
    whole = Texts.of([a + b for a, b in zip(before, after, strict=True)])
    back = np.fromiter(map(len, before), np.int64)
    ahead = np.fromiter(map(len, after), np.int64)
    half = length // 2
    for d in range(length + 1):
        rows = np.flatnonzero((back >= d) & (ahead >= length - d))
        if len(rows):
            start = back[rows] - d
            one = whole.hashes(rows, start, length)
            two = whole.hashes(rows, start, half) * np.uint64(0xD6E8FEB86659FD93) ^ whole.hashes(rows, start + half, length - half)
            yield d, rows, one + np.uint64(d * 0x9E3779B97F4A7C15 & (1 << 64) - 1), two


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys (pairs of numbers), and how often each key in that order occurs."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    made = keys[order]
    run = np.cumsum(np.r_[True, (made[1:] != made[:-1]).any(axis=1)][:len(made)]) - 1
    return order, np.bincount(run)[run] if len(made) else np.zeros(0, np.int64)


def _publish(length: int):
    """Per block of a hot anchor's contexts: its distinct window keys, packed by bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [np.stack([one, two], axis=1) for _, _, one, two in _window_keys(pdf, length)]
        keys = np.concatenate(made) if made else np.zeros((0, 2), np.uint64)
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        keys = keys[np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][:len(keys)]]
        h, block, buckets = int(pdf["h"].iloc[0]), int(pdf["block"].iloc[0]), int(pdf["buckets"].iloc[0])
        bucket = (keys[:, 1] % np.uint64(buckets)).astype(int)
        order = np.argsort(bucket, kind="stable")
        parts = np.split(keys[order], np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])
        return pd.DataFrame([(h, block, b, x.tobytes()) for b, x in enumerate(parts) if len(x)], columns=["h", "block", "bucket", "keys"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket of a hot anchor: the keys that two blocks or more have, handed back to each."""
    keys = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in pdf["keys"]]
    whole = np.concatenate(keys)
    order, count = _repeats(whole)
    shared = np.zeros(len(whole), bool)
    shared[order] = count > 1
    parts = zip(pdf["block"].tolist(), keys, np.split(shared, np.cumsum([len(k) for k in keys])[:-1]), strict=True)
    h = int(pdf["h"].iloc[0])
    return pd.DataFrame([(h, block, own[hit].tobytes()) for block, own, hit in parts if hit.any()], columns=["h", "block", "keys"])


def _settle_hot(length: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["rid", "lo", "hi"])
        shared = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in right["keys"]]) if len(right) else np.zeros((0, 2), np.uint64)
        shared = shared[np.argsort(shared[:, 0])]
        high, low = np.full(len(left), -1), np.full(len(left), length + 1)
        alone = left["wanted"].to_numpy(bool)
        for d, rows, one, two in _window_keys(left, length):
            order, count = _repeats(np.stack([one, two], axis=1))
            twice = np.zeros(len(rows), bool)
            twice[order] = count > 1
            if len(shared):
                at = np.minimum(np.searchsorted(shared[:, 0], one), len(shared) - 1)
                twice |= (shared[at, 0] == one) & (shared[at, 1] == two)
            hit = rows[twice]
            high[hit] = d
            low[hit] = np.minimum(low[hit], d)
        found = (high >= 0) & alone
        out = _reached(left["rid"].to_numpy(), left["pos"].to_numpy(np.int64), np.where(found, high, 0), np.where(found, length - low, 0))
        return out.to_pandas()

    return run


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    removed, runs, at, kept = 0, 0, 0, []
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            runs += 1
            kept.append(data[at:lo])
            removed += hi - lo
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    kept.append(data[at:])
    return removed, runs, b"".join(kept)


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(lo, 64).to_pylist():
                    removed, runs, kept = cut_spans(r["text"].encode(), [(s["lo"], s["hi"]) for s in r["spans"]])
                    rows.append((r["digest"], removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                     names=["digest", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def suffix_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                 max_group: int = MAX_GROUP, with_text: bool = False, passage: int = 0) -> DataFrame:
    """Judge every byte of every whole text; one row per input row.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` digest and kept_text (what is
    left where something was removed, else null; characters cut in two are dropped from it), with ``passage``
    shares_passage (whether some ``passage`` consecutive words occur in another row's text too, whatever the white space between them,
    and however few bytes they have). A byte goes if a string of ``length`` bytes over it starts anywhere else too. Steps:

    1. Each text marks its anchors, positions whose ``gram`` bytes hash least in some window of
       ``length`` bytes: equal windows have equal anchors.
    2. Anchors that occur once are dropped (a count per hash). Contexts of an anchor are of one kind if 128 bits
       of BLAKE2 agree.
    3. One context of each kind, and a second one of kinds that occur again, are dealt by anchor with their
       bytes, suffix-sorted both ways by prefix hashes, matched with their neighbours and verified. A kind
       that occurs again must match itself whole (else the job fails: a digest has collided); then its span counts at
       all its places. The union of matches over all anchors is exactly the repeated strings' bytes.
    4. Different contexts of anchors with over ``max_group`` kinds are dealt in blocks, which exchange window hashes
       of 128 bits instead of bytes: no task holds a group.

    Passages have anchors of their own, places whose ``WORD_GRAM`` words hash least in a window of ``passage`` words. Texts that share
    an anchor and the window around it are settled by two 64-bit hashes; where a text is not, all windows over the anchors it shares
    are compared by 128 bits of BLAKE2, its own and those of the texts it shares them with.

    Of rows with equal text the first is judged and cut, and the others share its outcome.
    Null texts count as empty. Texts shorter than ``length`` lose nothing. Repeated rows, or two rows
    with equal text, lose everything from ``length`` bytes on. Null keys are kept. An empty table gives an
    empty result. Other columns are not read.
    """
    with working(docs.sparkSession) as keep:
        rows, outcome = map(keep, _settle(docs, key, text, length, gram, max_group, with_text, passage))
    return rows.join(outcome, "digest").select(F.nullif(F.col("did"), F.lit(_NO_KEY)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                                               *(["digest", "kept_text"] if with_text else []), *(["shares_passage"] if passage else []))


def _settle(docs: DataFrame, key: str, text: str, length: int, gram: int, max_group: int, with_text: bool, passage: int) -> tuple[DataFrame, DataFrame]:
    """Staged tables of ``suffix_dedup``: a row for each input row, and what becomes of each text."""
    back = length - gram
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(_NO_KEY)).alias("did"), "text", F.sha2("text", 256).alias("digest"))
    found = stage(read.mapInArrow(_anchors(length, gram, passage), _FOUND), "anchors")
    texts = stage(found.groupBy("digest").agg(F.min("rid").alias("rid"), F.count("*").alias("rows"), F.min("n_words").alias("n_words")), "texts")

    spots = found.select("rid", F.col("n_bytes").cast("int").alias("size"), F.explode(F.arrays_zip("pos", "h", "c", "d")).alias("x")).select(
        "rid", "size", "x.pos", "x.h", "x.c", "x.d")
    twice = spots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = stage(spots.join(twice, "h"), "shared")
    place = F.struct("rid", "pos")
    every = shared.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.min(place).alias("rep"), F.max(place).alias("other"))
    every = stage(every, "every")
    sizes = every.groupBy("h").agg(F.count("*").alias("kinds"))
    kinds = stage(every.join(sizes, "h").where("n > 1 OR kinds > 1"), "kinds")
    hot = stage(kinds.where(F.col("kinds") > max_group).select("h", "kinds").distinct(), "hot")

    # one context of each kind is sorted, and a second one of kinds that occur again: the first must find it
    again = F.col("n") > 1
    alone = F.when(F.col("kinds") > max_group, F.xxhash64("h", "c", "d")).otherwise(F.col("h"))  # kinds of hot anchors are verified by themselves
    spot = lambda g, at, wanted, several: F.struct(g.alias("g"), "h", F.col(at)["pos"].alias("pos"), F.lit(wanted).alias("wanted"), F.lit(several).alias("several"))
    single = kinds.where(~again & (F.col("kinds") <= max_group)).select("rep.rid", spot(F.col("h"), "rep", True, False).alias("spot"))
    first = kinds.where(again).select("rep.rid", spot(alone, "rep", True, True).alias("spot"))
    second = kinds.where(again).select("other.rid", spot(alone, "other", False, True).alias("spot"))
    asked = single.unionByName(first).unionByName(second)
    any_hot = bool(hot.limit(1).count())
    if any_hot:
        crowded = kinds.where(F.col("kinds") > max_group)
        hot_asked = crowded.select("rep.rid", F.struct(F.col("h").alias("g"), "h", "rep.pos", (~again).alias("wanted"), again.alias("several")).alias("spot"))
    per_text = lambda x: x.groupBy("rid").agg(F.collect_list("spot").alias("spots"))
    # texts that are compared, and of equal texts the first, which is cut for all of them
    asked_ids = kinds.select("rep.rid").unionByName(kinds.where(again).select("other.rid")).distinct().withColumn("asked", F.lit(True))
    involved = shared.select("rid").distinct()
    if passage:
        sure, unsure = _common_grams(found, texts)
        involved = involved.unionByName(unsure.select("rid")).distinct()
    places = found.select("rid", "did", "digest").join(involved, "rid").join(texts.select("digest", F.col("rid").alias("low")), "digest")
    places = places.select("rid", "did", "digest", (F.col("rid") == F.col("low")).alias("low"))
    places = places.join(asked_ids, "rid", "left").where(F.col("low") | F.col("asked"))
    sources = stage(read.join(places.drop("asked"), ["did", "digest"]).dropDuplicates(["rid"]).select("rid", "low", "digest", "text"), "sources")

    def contexts(of: DataFrame) -> DataFrame:
        return sources.select("rid", "text").join(per_text(of), "rid").select("rid", "text", "spots").mapInArrow(_contexts(length, gram), _CONTEXT)

    matched = stage(contexts(asked).repartition("g").sortWithinPartitions("g").mapInArrow(_match(length), _MATCHED), "matched")
    verified = matched.where("several").select("h", "rid", "pos").join(every.where("n > 1").select("h", "c", "d", "rep.rid", "rep.pos"), ["h", "rid", "pos"]).select("h", "c", "d")
    whole_span = (F.greatest(F.col("pos") - back, F.lit(0)).alias("lo"), F.least(F.col("pos") + length, F.col("size")).alias("hi"))
    equal = shared.join(verified, ["h", "c", "d"]).select("rid", *whole_span)
    own = found.select("rid", F.explode("own").alias("x")).select("rid", "x.*").join(verified, ["h", "c", "d"]).select("rid", "lo", "hi")
    spans = matched.where("NOT several").select("rid", "lo", "hi").unionByName(equal).unionByName(own)
    if any_hot:
        blocks = hot.select("h", F.ceil(F.col("kinds") / F.lit(max(2, max_group // 2))).alias("blocks"),
                            F.greatest(F.lit(BUCKETS), F.ceil(F.col("kinds") / F.lit(BUCKET_KINDS))).alias("buckets"))
        crowd = stage(contexts(hot_asked).join(blocks, "h").withColumn("block", F.pmod(F.xxhash64("rid", "pos"), F.col("blocks"))).drop("blocks"), "crowd")
        published = crowd.groupBy("h", "block").applyInPandas(_publish(length), "h long, block long, bucket long, keys binary")
        common = published.groupBy("h", "bucket").applyInPandas(_shared, "h long, block long, keys binary")
        spans = spans.unionByName(crowd.groupBy("h", "block").cogroup(common.groupBy("h", "block")).applyInPandas(_settle_hot(length), _SPAN))
    gathered = spans.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    done = sources.where("low").select("rid", "digest", "text").join(gathered, "rid").mapInArrow(
        _cut(with_text), "digest string, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    outcome = texts.join(done, "digest", "left").select(
        "digest", "rid", "rows", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"), "kept_text")
    if passage:
        windows = stage(sources.select("rid", "text").join(unsure, "rid").mapInArrow(_passages(passage), "rid long, k binary"), "windows")
        common = windows.groupBy("k").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a <> b").select("k")
        sharing = sure.unionByName(windows.join(common, "k").select("rid")).distinct().withColumn("found", F.lit(True))
        outcome = outcome.join(sharing, "rid", "left").withColumn(
            "shares_passage", F.coalesce("found", (F.col("rows") > 1) & (F.col("n_words") >= passage))).drop("found")
    outcome = outcome.drop("rid", "rows", "n_words")
    return stage(found.select("did", "digest", "n_bytes"), "rows"), stage(outcome, "outcome")


def _common_grams(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that share a word anchor and the window around it with another text; and, where one that does not shares anchors, all texts with these."""
    grams = found.select("rid", "grams").join(texts.select("rid"), "rid", "left_semi").select("rid", F.explode("grams").alias("x")).select("rid", "x.w", "x.v")
    several = lambda x, *by: x.groupBy(*by).agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a <> b").select(*by)
    common = stage(grams.join(several(grams, "w"), "w"), "common")
    sure = stage(common.join(several(common, "w", "v"), ["w", "v"]).select("rid").distinct(), "sure")
    unsettled = common.join(sure, "rid", "left_anti").select("w").distinct()
    unsure = common.join(unsettled, "w", "left_semi").groupBy("rid").agg(F.collect_set("w").alias("asked"))
    return sure, stage(unsure, "unsure")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes; passages of 50 words that other documents share are told too, as fewer bytes may hold them."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE_WORDS)
