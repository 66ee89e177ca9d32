"""Spelling variants: words one edit apart, found in a trie of letter-group counts, and the forms that they lead to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.common import stage, working

#: Groups of letters, and so levels of the trie.
GROUPS = 12
#: Letters ranked by frequency; all others go to a group by code point.
RANKED = 200
#: Words of a shard, at least, and shards at most: their table goes to every task.
SHARD = 4_000
SHARDS = 100_000
#: A node of so many words is compared word by word; words up to so many characters as rows of a table.
BUCKET = 32
WIDE = 64
#: Pairs that are compared at once, and counted words that are held, inside a task.
AT_ONCE = 1 << 17
HELD = 300_000
_RUN = re.compile(rb"[a-z]+(?:(?:\xc3[\x80-\xbf])+[a-z]*)*|(?:(?:\xc3[\x80-\xbf])+[a-z]*)+")


def corpus_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 6, damage: int | None = None) -> DataFrame:
    """How often each word stands in all texts: ``word``, ``n``.

    Words are runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``least`` letters, A-Z lower-cased. With
    ``damage``, a word of a document loses the letter number h modulo its length where ``damage`` divides h, the crc32
    of ``<key>:<word>`` (a null key reads null), before its length counts. Null and empty texts have no words; repeated
    rows count each; an empty table gives an empty result; other columns are not read. Counts are summed inside tasks first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            long = [w for w in held if len(w) - w.count(b"\xc3") >= least]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in long], pa.string()), pa.array([held[w] for w in long], pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(_RUN.findall(x.encode("utf-8", "surrogatepass").lower()))
                if damage:
                    before = zlib.crc32(f"{'null' if k is None else k}:".encode())
                    for w in [w for w in found if zlib.crc32(w, before) % damage == 0]:
                        letters = w.decode()
                        at = zlib.crc32(w, before) % len(letters)
                        cut = (letters[:at] + letters[at + 1:]).encode()
                        held[cut] = held.get(cut, 0) + found.pop(w)
                for w, n in found.items():
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("x"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(letters: list[str], groups: int = GROUPS) -> dict[int, int]:
    """Group of each letter's code point: letters by falling frequency, dealt to and fro so that groups weigh alike."""
    back = 2 * groups
    return {ord(c): min(k % back, back - 1 - k % back) for k, c in enumerate(letters)}


def count_vectors(words: list[str], group_of: dict[int, int], groups: int = GROUPS) -> np.ndarray:
    """For each word, how many of its letters lie in each group."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    kinds, at = np.unique(points, return_inverse=True)
    group = np.array([group_of.get(int(p), int(p) % groups) for p in kinds], np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * groups + (group[at] if len(points) else 0), minlength=len(words) * groups).reshape(-1, groups).astype(np.int32)


def paths(node, v: tuple[int, ...], level: int = 0, surplus: int = 0, deficit: int = 0) -> Iterator[int]:
    """Shards under ``node`` whose counts are the vector's but for one less, then perhaps one more: a search in depth.

    ``node`` maps counts to further nodes, and to a number where a shard begins. A leaf never has more letters of a
    group before it had fewer of another, so of two words only one finds the other (the longer, or the one with more
    letters of the first group in which they differ); words with equal counts share a leaf.
    """
    if not isinstance(node, dict):
        yield node
        return
    for spent in (0, -1, 1):
        if (spent < 0 and deficit) or (spent > 0 and (surplus or not deficit)):
            continue
        child = node.get(v[level] + spent)
        if child is not None:
            yield from paths(child, v, level + 1, surplus + (spent > 0), deficit + (spent < 0))


class Letters:
    """Words as rows of code points from the left and from the right, for comparing many pairs at once."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        short = [w if len(w) <= WIDE else "" for w in words]
        wide = max(map(len, short), default=0)
        self.left = np.zeros((len(words), wide), np.uint32)
        self.right = np.zeros((len(words), wide), np.uint32)
        size = np.array([len(w) for w in short], np.int64)
        points = np.frombuffer("".join(short).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        self.left[row, at] = points
        self.right[row, np.repeat(size, size) - 1 - at] = points

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of different words differ by one inserted, deleted or replaced letter."""
        low, high = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        out = high - low <= 1
        wide = high > WIDE
        for k in np.flatnonzero(out & wide):
            out[k] = one_edit(self.words[a[k]], self.words[b[k]])
        at = np.flatnonzero(out & ~wide)
        for s in range(0, len(at), AT_ONCE):
            k = at[s:s + AT_ONCE]
            same = [_same(x[a[k]], x[b[k]]) for x in (self.left, self.right)]
            out[k] = np.minimum(same[0], low[k]) + np.minimum(same[1], low[k]) >= high[k] - 1
        return out


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many columns from the left are equal."""
    other = x != y
    return np.where(other.any(1), other.argmax(1), x.shape[1])


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    low, high = min(len(a), len(b)), max(len(a), len(b))
    p = next((i for i in range(low) if a[i] != b[i]), low)
    s = next((i for i in range(low) if a[-1 - i] != b[-1 - i]), low)
    return p + s >= high - 1


def near_pairs(queries: list[str], leaves: list[str], group_of: dict[int, int], groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, leaf) one edit apart, each pair of words from one side only: see ``paths``.

    Leaves stand in the order of their counts, so a node of the trie is a range of them. The search goes down in depth with all
    queries that still have budget; nodes of few words are compared whole, and leaves of many equal counts by halves.
    """
    vq, vl = count_vectors(queries, group_of, groups), count_vectors(leaves, group_of, groups)
    order = np.lexsort([vl[:, k] for k in reversed(range(groups))])
    vl = vl[order]
    both = Letters(queries + leaves)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(q: np.ndarray, w: np.ndarray) -> None:
        """Keep the pairs whose counts allow one edit from the right side, and that are one edit apart."""
        for s in range(0, len(q), AT_ONCE):
            a, b = q[s:s + AT_ONCE], w[s:s + AT_ONCE]
            d = vl[b] - vq[a]
            ok = (np.maximum(d, 0).sum(1) <= 1) & (np.minimum(d, 0).sum(1) >= -1)
            a, b, d = a[ok], b[ok], d[ok]
            first = np.take_along_axis(d, (d != 0).argmax(1)[:, None], 1)[:, 0]
            leaf = order[b]
            own = np.array([queries[x] < leaves[y] for x, y in zip(a[first == 0], leaf[first == 0], strict=True)], bool)
            ok = first < 0
            ok[first == 0] = own
            a, leaf = a[ok], leaf[ok]
            ok = both.near(a, leaf + len(queries))
            if ok.any():
                found.append((a[ok], leaf[ok]))

    def search(lo: int, hi: int, level: int, q: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        if level == groups and hi - lo > BUCKET:
            settle(*_by_halves(queries, q, [leaves[k] for k in order[lo:hi]], lo))
            return
        if level == groups or hi - lo <= BUCKET:
            step = max(1, AT_ONCE // (hi - lo))
            for s in range(0, len(q), step):
                part = q[s:s + step]
                settle(np.repeat(part, hi - lo), np.tile(np.arange(lo, hi), len(part)))
            return
        column = vl[lo:hi, level]
        cuts = np.flatnonzero(np.diff(column)) + 1 + lo
        for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
            d = vl[a, level] - vq[q, level]
            ok = (d == 0) | ((d == -1) & (deficit == 0)) | ((d == 1) & (surplus == 0) & (deficit == 1))
            if ok.any():
                search(a, b, level + 1, q[ok], surplus[ok] + (d[ok] == 1), deficit[ok] + (d[ok] == -1))

    if queries and leaves:
        none = np.zeros(len(queries), np.int8)
        search(0, len(leaves), 0, np.arange(len(queries)), none, none)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _by_halves(queries: list[str], q: np.ndarray, leaves: list[str], lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries and leaves of one length that share the first or the second half: one edit leaves one of them as it is."""
    a, b = [], []
    for size in {len(queries[k]) for k in q}:
        half = size // 2
        start: dict[str, list[int]] = {}
        end: dict[str, list[int]] = {}
        for k, w in enumerate(leaves):
            start.setdefault(w[:half], []).append(k)
            end.setdefault(w[max(0, len(w) - (size - half)):], []).append(k)
        for k in q:
            if len(queries[k]) == size:
                fits = sorted({*start.get(queries[k][:half], ()), *end.get(queries[k][half:], ())})
                a += [k] * len(fits)
                b += fits
    return np.array(a, np.int64), np.array(b, np.int64) + lo


def _shards(vectors: DataFrame, words: int, groups: int, shard: int) -> tuple[dict, dict[int, int]]:
    """The upper trie down to shards of few words, and the parts of shards that are single leaves with more.

    ``vectors`` holds each vector ``v`` and its words ``m``. Nodes with more than ``shard`` words are opened; there are at most
    ``groups * words / shard`` of them, and ``shard`` grows until the shards number at most ``SHARDS``.
    """
    prefix = vectors.select(F.explode(F.sequence(F.lit(1), F.lit(groups))).alias("d"), "v", "m")
    sizes = stage(prefix.groupBy(F.slice("v", F.lit(1), F.col("d")).alias("p")).agg(F.sum("m").alias("m")), "prefixes")
    shard = max(shard, -(-words // (SHARDS // 10)))
    while True:
        full = sizes.where(F.col("m") > shard)
        open_ = full.where(F.size("p") < groups).select(F.col("p").alias("up"))
        parent = F.slice("p", F.lit(1), F.size("p") - 1)
        tops = sizes.where((F.col("m") <= shard) | (F.size("p") == groups))
        inner = tops.where("size(p) > 1").withColumn("up", parent).join(open_, "up", "left_semi").select("p", "m")
        ends = stage(tops.where("size(p) = 1").select("p", "m").unionByName(inner), "shards")
        if ends.count() <= SHARDS:
            break
        shard *= 2
    trie: dict = {}
    parts: dict[int, int] = {}
    for k, row in enumerate(sorted(ends.collect(), key=lambda r: r.p)):  # at most SHARDS rows
        node = trie
        for c in row.p[:-1]:
            node = node.setdefault(c, {})
        node[row.p[-1]] = k
        if row.m > shard:
            parts[k] = -(-row.m // shard)
    return trie, parts


def spelling_variants(words: DataFrame, *, word: str = "word", n: str = "n", ratio: int = 5, groups: int = GROUPS, shard: int = SHARD) -> DataFrame:
    """Near words of every word, the form it may be misspelt from, and the root that forms lead to.

    ``words`` holds words and their counts; rows of one word are summed, null words are left out, a null count is 0. Words are
    near if they differ by one inserted, deleted or replaced code point. Returns ``word``, ``n``, ``n_near`` (near words), ``form``
    (the near word of largest n, of equal ones the first in code-point order, if its n is at least ``ratio`` times the
    word's, and more; else null), ``form_n`` and ``root`` (the last word that forms lead to; without a form the word itself). An
    empty table gives an empty result; words of any length are compared whole. The trie is cut into shards of about
    ``shard`` words by its upper levels; a word goes to the shards where its search leads, and leaves of more words than that
    are dealt to several tasks. Memory follows the shard, never a letter or a length.
    """
    spark = words.sparkSession
    with working(spark) as keep:
        own = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"))
        own = stage(own, "words")
        rank = own.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count()
        letters = [r.c for r in rank.orderBy(F.desc("count"), "c").limit(RANKED).collect()]
        group_of = letter_groups(letters, groups)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = count_vectors(b.column(0).to_pylist(), group_of, groups)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v.tolist(), pa.list_(pa.int32()))], ["word", "n", "v"])

        vectors = stage(own.mapInArrow(measured, "word string, n long, v array<int>"), "vectors")
        trie, parts = _shards(vectors.groupBy("v").agg(F.count("*").alias("m")), own.count(), groups, shard)
        held = spark.sparkContext.broadcast((trie, parts))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, parts = held.value
            known: dict[tuple, tuple] = {}
            for b in batches:
                rows = []
                for w, m, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    v = tuple(v)
                    if v not in known:
                        if len(known) > HELD:
                            known.clear()
                        node = trie
                        for c in v:
                            node = node[c]
                            if not isinstance(node, dict):
                                break
                        known[v] = node, tuple(paths(trie, v))
                    home, visits = known[v]
                    rows.append((home, zlib.crc32(w.encode()) % parts.get(home, 1), True, w, m))
                    rows += [(s, p, False, w, m) for s in visits for p in range(parts.get(s, 1))]
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "part", "leaf", "word", "n"])

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            leaf = rows.leaf.to_numpy(bool)
            names, counts = rows.word.to_numpy(object), rows.n.to_numpy(np.int64)
            names = np.concatenate([names[~leaf], names[leaf]])
            counts = np.concatenate([counts[~leaf], counts[leaf]])
            split = int((~leaf).sum())
            a, b = near_pairs(names[:split].tolist(), names[split:].tolist(), group_of, groups)
            b = b + split
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            place = np.empty(len(names), np.int64)
            place[np.argsort(names, kind="stable")] = np.arange(len(names))
            order = np.lexsort([place[b], -counts[b], a])
            a, b = a[order], b[order]
            first = np.flatnonzero(np.diff(a, prepend=-1))
            near = np.diff(np.append(first, len(a)))
            return pd.DataFrame({"word": names[a[first]], "near": near.astype(np.int64), "m": counts[b[first]], "other": names[b[first]]})

        visits = vectors.mapInArrow(dealt, "shard int, part int, leaf boolean, word string, n long")
        near = visits.groupBy("shard", "part").applyInPandas(found, "word string, near long, m long, other string")
        near = near.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
        good = (-F.col("best.m") >= ratio * F.col("n")) & (-F.col("best.m") > F.col("n"))  # so chains of forms end
        named = own.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
                                                      F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
        named = keep(stage(named, "named"))
        roots = keep(stage(_roots(named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), "roots"))
    return named.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame) -> DataFrame:
    """The ends of chains of (word, root) links, their lengths doubling each round; a link's count grows ``ratio`` times, so chains are short."""
    links = stage(links, "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = stage(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 6 letters and 5 occurrences in all documents, one letter lost where 199 divides the word's hash."""
    words = corpus_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=199)
    return spelling_variants(words.where("n >= 5")).select("word", "form", "root", "n", "n_near", "form_n")


#: Words are counted with the hash rule, near words come from equal rests after one letter goes or is masked, roots by recursion.
OP12_SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), once AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY 1, 2
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || w, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h FROM once, crc_table
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), places AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words
), masks AS MATERIALIZED (SELECT word, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS m FROM places
), rests AS MATERIALIZED (SELECT DISTINCT p.word AS longer, w.word AS shorter FROM places p JOIN words w ON w.word = substr(p.word, 1, k - 1) || substr(p.word, k + 1)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM masks a JOIN masks b ON a.m = b.m AND a.word <> b.word
  UNION SELECT longer, shorter FROM rests UNION SELECT shorter, longer FROM rests
), best AS (
  SELECT near.word, count(*) AS n_near, min((-n, other)) AS b FROM near JOIN words ON words.word = other GROUP BY 1
), named AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * n THEN -b[1] END AS form_n
  FROM words LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS root, form AS next FROM named
  UNION ALL SELECT c.word, c.next, n.form FROM chains c JOIN named n ON n.word = c.next
)
SELECT word, form, root, n, n_near, form_n FROM named JOIN (SELECT word, root FROM chains WHERE next IS NULL) USING (word)
"""
