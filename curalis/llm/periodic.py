"""Periodic runs of words: exact extensions of candidates on a harmonic grid, answered by a recompression grammar."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.functions.identity import let

#: Bytes of texts that share one grammar (a longer text has its own), and candidates that are compared at once, inside a task.
BYTES = 1_500_000
AT_ONCE = 1 << 20
#: Odd multipliers, one for each pair level in turn: the top bit of the product is a symbol's side.
SIDES = np.random.default_rng(20240607).integers(1 << 62, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: The grammar ends where no text has more symbols than this; they are compared one by one.
TOP = 4


class Grammar:
    """A run-length grammar of several texts by recompression, for longest common extensions.

    ``symbols`` holds all texts with a different number below 0 before each and after the last. Levels take turns: one turns
    each maximal block of equal symbols into one symbol, the next each pair of a left and a right symbol, the sides being dealt by a
    hash of the symbol. So equal stretches are parsed alike but for a few symbols at their ends. Level k has ``of[k]`` (symbols),
    ``up[k]`` (place of the parent in level k + 1), ``first[k + 1]`` (place of the first child; one more at the end).
    """

    def __init__(self, symbols: np.ndarray):
        self.of = [symbols]
        self.up: list[np.ndarray] = []
        self.first: list[np.ndarray] = [np.arange(len(symbols) + 1)]
        fresh = int(symbols.max(initial=0)) + 1
        marks = np.flatnonzero(symbols < 0)
        level = 0
        while np.diff(marks).max(initial=1) - 1 > TOP:
            s = self.of[-1]
            if level % 2 == 0:
                starts = np.ones(len(s), bool)
                starts[1:] = s[1:] != s[:-1]
            else:
                right = (s.astype(np.uint64) * SIDES[level // 2 % 64]) >> np.uint64(63) == 1
                starts = np.ones(len(s), bool)
                starts[1:] = ~(~right[:-1] & right[1:] & (s[:-1] >= 0) & (s[1:] >= 0))
            first = np.flatnonzero(starts)
            size = np.diff(first, append=len(s))
            new = s[first]
            many = np.flatnonzero(size > 1)
            if len(many):
                other = size[many] if level % 2 == 0 else s[first[many] + 1]
                codes, kinds = pd.factorize(new[many] * np.int64(max(fresh, len(s) + 1)) + other)
                new[many] = fresh + codes
                fresh += len(kinds)
            self.up.append(np.cumsum(starts) - 1)
            self.first.append(np.append(first, len(s)))
            self.of.append(new)
            marks = np.flatnonzero(new < 0)
            level += 1

    def _reach(self, level: int, at: np.ndarray, step: int) -> np.ndarray:
        """Symbols from each place to the end of its parent, in the direction of ``step``."""
        p, first = self.up[level][at], self.first[level + 1]
        return first[p + 1] - at if step > 0 else at - first[p] + 1

    def extensions(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """For each pair of places, how many symbols from them on agree: to the right, or to the left with ``step`` -1.

        Where both places are at a parent's edge the search goes up, so that it skips ever longer equal stretches; where symbols
        differ it goes down. In either direction at most one symbol or block agrees on each level.
        """
        a, b = i.copy(), j.copy()
        height = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for level in range(len(self.of)):
            s = self.of[level]
            if level == len(self.up):  # the top: few symbols a text
                while len(live):
                    live = live[s[a[live]] == s[b[live]]]
                    a[live] += step
                    b[live] += step
                break
            live = live[s[a[live]] == s[b[live]]]
            if not len(live):
                break
            x, y = a[live], b[live]
            rx, ry = self._reach(level, x, step), self._reach(level, y, step)
            first, up = self.first[level + 1], self.up[level]
            whole_x, whole_y = first[up[x] + 1] - first[up[x]], first[up[y] + 1] - first[up[y]]
            inside = (rx != whole_x) | (ry != whole_y)
            ahead = np.where(inside, np.minimum(rx, ry) if level % 2 == 0 else 1, 0)
            x, y = x + step * ahead, y + step * ahead
            a[live], b[live] = x, y
            on = ~inside | (s[x] == s[y])
            # what has gone on is at an edge of both parents
            live, x, y = live[on], x[on], y[on]
            a[live], b[live] = up[x], up[y]
            height[live] = level + 1
        for level in range(int(height.max(initial=0)), 0, -1):
            at = np.flatnonzero(height >= level)
            s, first = self.of[level - 1], self.first[level]
            x, y = (first[a[at]], first[b[at]]) if step > 0 else (first[a[at] + 1] - 1, first[b[at] + 1] - 1)
            same = s[x] == s[y]
            ahead = np.minimum(self._reach(level - 1, x, step), self._reach(level - 1, y, step)) if (level - 1) % 2 == 0 else 1
            a[at], b[at] = x + step * same * ahead, y + step * same * ahead
        return np.abs(a - i)


def candidates(start: np.ndarray, size: np.ndarray, least: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q such that each run of period q covers i and i + q for one of them.

    A run has at least max(least, repeats * q) symbols, so a step of that less q misses none: about n/q places for a
    period, and a harmonic sum for all.
    """
    periods = size // repeats
    periods[size < least] = 0
    text = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, repeats * q) - q
    many = -(-(size[text] - q) // step)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        n = many[lo:hi]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        qs = np.repeat(q[lo:hi], n)
        yield np.repeat(start[text[lo:hi]], n) + k * np.repeat(step[lo:hi], n), qs
        lo = hi


def runs_of(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """All runs of several texts in one array: rows (start, length, period), by start, then period.

    ``symbols`` is as for ``Grammar``. Of runs over the same stretch the smallest period stays; the others are its multiples.
    """
    grammar, found = None, []
    for i, q in candidates(start, size, least, repeats):
        same = symbols[i] == symbols[i + q]
        i, q = i[same], q[same]
        if not len(i):
            continue
        grammar = grammar or Grammar(symbols)
        right, left = grammar.extensions(i, i + q), grammar.extensions(i - 1, i + q - 1, -1)
        length = left + right + q
        ok = length >= np.maximum(least, repeats * q)
        rows = np.stack([i[ok] - left[ok], length[ok], q[ok]], 1)
        found.append(rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))])
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _some(texts: list[bytes | None], least: int, repeats: int) -> tuple[pa.Array, list[int], list[str]]:
    """Runs, numbers of words and collapsed texts of a few texts."""
    words = [(x or b"").split() for x in texts]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size + 1) - size  # a mark before each text and after the last
    symbols = np.empty(int(size.sum()) + len(words) + 1, np.int64)
    symbols[np.append(start - 1, len(symbols) - 1)] = -1 - np.arange(len(words) + 1)
    symbols[symbols >= 0] = 0
    for w, s, n in zip(words, start, size, strict=True):
        symbols[s:s + n] = np.fromiter(map(number.__getitem__, w), np.int64, n)
    rows = runs_of(symbols, start, size, least, repeats)
    text = np.searchsorted(start, rows[:, 0], "right") - 1
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
    np.add.at(cover, rows[:, 0] + rows[:, 1], -1)
    gone = np.cumsum(cover) > 0
    for k in np.unique(text):
        words[k] = [w for w, x in zip(words[k], gone[start[k]:start[k] + size[k]].tolist(), strict=True) if not x]
    fields = [pa.array(rows[:, 0] - start[text], pa.int64()), pa.array(rows[:, 1], pa.int64()), pa.array(rows[:, 2], pa.int64())]
    offsets = np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return runs, size.tolist(), [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]


def periodic_runs(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 6, repeats: int = 4) -> DataFrame:
    """Runs of repeating words in every text: ``keep`` columns, ``n_words``, ``runs`` and ``collapsed``.

    Words are parts between ASCII white space. A run is a stretch of at least ``least`` words and ``repeats`` (2 or more) times its smallest
    period that neither neighbour extends; ``runs`` holds (start, length, period) by start, then period, in words from 0.
    ``collapsed`` has the text's words, joined by blanks, without those that a run contains after its first period. Null and empty
    texts have no words; repeated rows are judged each; an empty table gives an empty result; other columns are not read. No shuffle:
    a text is read whole in one task, in memory in proportion to its length (n log n candidates are compared in parts).
    """
    if repeats < 2:
        raise ValueError("a run repeats its period at least once")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, "right")))
                part = texts.slice(lo, hi - lo).to_pylist()
                runs, sizes, collapsed = _some(part, least, repeats)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), pa.array(sizes, pa.int64()), runs, pa.array(collapsed, pa.string())],
                                                 [*(f"k{k}" for k in range(len(keep))), "n_words", "runs", "collapsed"])
                lo = hi

    rows = docs.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)], F.col(text).alias("x"))
    schema = ", ".join([*(f"k{k} {rows.schema[f'k{k}'].dataType.simpleString()}" for k in range(len(keep))),
                        "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    found = rows.mapInArrow(find, schema)
    return found.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "n_words", "runs", "collapsed")


def with_repeats(text: Column, key: Column) -> Column:
    """The text, whose words from number a on repeat with period p where 10 divides the crc32 of the key: h = crc32, g = h / 10, a = g mod n, p = 1 + (n - a) / (3 + g mod 8)."""
    g = F.floor(F.crc32(key.cast("string")) / 10)

    def repeated(v: Column) -> Column:
        def cut(p: Column) -> Column:
            at = lambda i: F.get(p["w"], (p["a"] + (i - p["a"]) % p["p"]).cast("int"))
            return F.array_join(F.transform(p["w"], lambda w, i: F.when(i < p["a"], w).otherwise(at(i))), " ")

        n, a = F.size(v["w"]), v["g"] % F.size(v["w"])
        whole = F.struct(v["w"].alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + v["g"] % 8))).alias("p"))
        return F.when(n > 0, let(whole, cut))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(F.crc32(key.cast("string")) % 10 == 0, F.coalesce(let(F.struct(words.alias("w"), g.alias("g")), repeated), text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
                       F.col("best.period").alias("period"), F.floor(-F.col("best.less") * 1000 / F.col("best.period")).alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Equal words at a distance of q are joined; stretches of such places without a gap are runs.
OP11_SQL = """
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, len(w) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h, h // 10 AS g
  FROM documents, crc_table
), plan AS (
  SELECT rid, w, n, h % 10 = 0 AND n > 0 AS again, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM docs
), words AS MATERIALIZED (
  SELECT rid, n, i, CASE WHEN again AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM plan)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT rid, q, min(i) AS start, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island
), runs AS MATERIALIZED (
  SELECT rid, start, m + q AS length, min(q) AS period FROM stretches WHERE m + q >= greatest(6, 4 * q) GROUP BY ALL
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
), told AS (
  SELECT rid, count(*) AS n_runs, min((-length, start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b[2] AS start, -b[1] AS length, b[3] AS period, (-b[1] * 1000) // b[3] AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
