"""Secret scans in SQL functions only: fixed patterns, then sliding-window entropy per character class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.functions.identity import let

#: Patterns of the base kinds. Letters of key words are spelled out in both cases, so that all regular-expression
#: libraries read them alike.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Shorter matches of these two fail, and hold no longer one: their least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Order of kinds that start together.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")
#: Character classes of the entropy scan: kind, candidate strings, window in characters, least bits a character.
CLASSES = (("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 3.0), ("entropy_text", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0))
#: High-entropy strings of the last class also mix lower and upper case and digits.
MIXED = (r"[a-z]", r"[A-Z]", r"[0-9]")
#: Candidates with one of these are no secrets: dummies, alphabets and counts in order, universally unique ids, paths of words.
ALLOW = (r"[Ee]xample|EXAMPLE|[Ss]ample|SAMPLE|[Pp]laceholder|[Dd]ummy|[Cc]hange_?[Mm]e|[Yy]our_", r"abcdefghij|ABCDEFGHIJ|0123456789",
         r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", r"[a-z]{3,}[-_/][a-z]{3,}[-_/][a-z]{3,}")
#: Parts of a bit that logarithms are rounded to, so that sums do not depend on their order.
SCALE = 1_000_000


def weights(window: int) -> list[int]:
    """c * log2(c) for counts 0 to ``window``, in parts of ``SCALE``."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def most_weight(window: int, bits: float) -> int:
    """The largest sum of weights at which a window has the given entropy."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def prefix_sums(x: Column) -> Column:
    """Running sums of an array in as many passes as its length has binary digits."""

    def sums(v: Column) -> Column:
        shifts = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(v))
        return F.aggregate(shifts, v, lambda acc, s: F.transform(acc, lambda e, i: e + F.coalesce(F.get(acc, i - s), F.lit(0))))

    return let(x, sums)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: struct of ``found`` (before, value, start, end) and the ``tail`` after the last.

    ``before`` is the text since the match before. Positions are code points, the end exclusive.
    """
    kind = "struct<found: array<struct<before: string, value: string, start: int, end: int>>, tail: string>"

    def placed(p: Column) -> Column:
        pieces, found = p["pieces"], p["found"]
        steps = F.transform(found, lambda m, k: F.length(F.get(pieces, k)) + F.coalesce(F.length(F.get(found, k - 1)), F.lit(0)))
        rows = let(prefix_sums(steps), lambda starts: F.transform(found, lambda m, k: F.struct(
            F.get(pieces, k).alias("before"), m.alias("value"), F.get(starts, k).alias("start"), (F.get(starts, k) + F.length(m)).alias("end"))))
        return F.struct(rows.alias("found"), F.element_at(pieces, -1).alias("tail"))

    def cut(p: Column) -> Column:
        none = F.struct(F.array().alias("found"), p["x"].alias("tail")).cast(kind)
        some = F.struct(F.split(p["x"], pattern, -1).alias("pieces"), p["found"].alias("found"))
        return F.when(F.size(p["found"]) == 0, none).otherwise(let(some, placed).cast(kind))

    return let(let(text, lambda x: F.struct(x.alias("x"), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("found"))), cut)


def blanked(m: Column, keep=lambda value: F.lit(True)) -> Column:
    """The text of ``matches`` with blanks in place of the matches that pass ``keep``."""
    parts = F.transform(m["found"], lambda f: F.concat(f["before"], F.when(keep(f["value"]), F.repeat(F.lit(" "), f["end"] - f["start"])).otherwise(f["value"])))
    return F.when(F.size(m["found"]) == 0, m["tail"]).otherwise(F.concat(F.array_join(parts, ""), m["tail"]))


def hot_spans(candidate: Column, window: int, bits: float) -> Column:
    """Joined windows of at least so many bits a character: array of (s, e) inside the candidate.

    One pass with a count for each character of the candidate: a step adds the character that comes in, takes
    off the one that leaves, and corrects the sum of c * log2(c) by these two counts alone.
    """
    table, most = F.array(*[F.lit(w) for w in weights(window)]), most_weight(window, bits)
    w = lambda c: F.get(table, c)

    def scan(p: Column) -> Column:
        chars, letters = p["chars"], p["letters"]

        def step(acc: Column, at: Column) -> Column:
            places = F.struct(F.array_position(letters, F.get(chars, at)).cast("int").alias("new"),
                              F.coalesce(F.array_position(letters, F.get(chars, at - window)), F.lit(0)).cast("int").alias("old"))

            def counted(q: Column) -> Column:
                new, old = F.get(acc["counts"], q["new"] - 1), F.get(acc["counts"], q["old"] - 1)
                change = F.when(q["new"] == q["old"], F.lit(0)).otherwise(w(new + 1) - w(new) + F.coalesce(w(old - 1) - w(old), F.lit(0)))
                counts = F.when(q["new"] == q["old"], acc["counts"]).otherwise(F.transform(
                    acc["counts"], lambda c, i: c + F.when(i == q["new"] - 1, 1).when(i == q["old"] - 1, -1).otherwise(0)))
                return F.struct(counts.alias("counts"), (acc["sum"] + change).alias("sum"))

            def joined(q: Column) -> Column:
                hot = (at >= window - 1) & (q["sum"] <= most)
                apart = hot & (at - (window - 1) > acc["e"])  # also for the first, as e starts below 0
                closed = F.when(apart & (acc["e"] > 0), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])
                return F.struct(q["counts"].alias("counts"), q["sum"].alias("sum"), F.when(apart, at - (window - 1)).otherwise(acc["s"]).alias("s"),
                                F.when(hot, at + 1).otherwise(acc["e"]).alias("e"), closed.alias("out"))

            return let(let(places, counted), joined)

        start = F.struct(F.transform(letters, lambda x: F.lit(0)).alias("counts"), F.lit(0).alias("sum"), F.lit(-1).alias("s"), F.lit(-1).alias("e"),
                         F.array().cast("array<struct<s: int, e: int>>").alias("out"))
        end = lambda acc: F.when(acc["e"] > 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, end)

    return let(let(F.split(candidate, ""), lambda c: F.struct(c.alias("chars"), F.array_distinct(c).alias("letters"))), scan)


_SPANS = "array<struct<start: int, rank: int, end: int, kind: string>>"


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: _span(kind, m["start"], m["end"]))


def _entropy_spans(text: Column, allow: tuple[str, ...], kind: str, pattern: str, window: int, bits: float) -> Column:
    def inside(m: Column) -> Column:
        hot = hot_spans(m["value"], window, bits)
        if kind == CLASSES[-1][0]:
            hot = F.filter(hot, lambda h: _mixed(F.substring(m["value"], h["s"] + 1, h["e"] - h["s"])))
        return F.transform(hot, lambda h: _span(kind, m["start"] + h["s"], m["start"] + h["e"]))

    found = matches(text, pattern)["found"]
    if allow:
        found = F.filter(found, lambda m: ~m["value"].rlike("|".join(f"(?:{a})" for a in allow)))
    return F.flatten(F.transform(found, inside))


def _long_value(value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 2)) >= LEAST_VALUE


def secret_scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Where secrets stand in every text: ``keep`` columns and ``spans``, an array of (start, rank, end, kind) in order.

    Kinds ``assign``, ``access`` and ``hex`` are those of the patterns. Kinds ``entropy_hex`` and ``entropy_text`` are joined
    windows of high entropy in strings of one character class, searched where assigned values, then hexadecimal strings,
    then access keys are blanked; ``allow`` suppresses a string that holds one of its patterns, and text strings need
    lower case, upper case and digits. Positions are code points, the end exclusive. Null and empty texts have no spans;
    repeated rows are judged each, an empty table gives an empty result, and columns of the input that are not in
    ``keep`` are not read, so clashing names do no harm. Work and memory grow with a text's length, not its square; no shuffle.
    """
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    rows = rows.withColumn("assign", matches(F.col("x"), ASSIGN)).withColumn("hex", matches(F.col("x"), HEX)).withColumn("access", matches(F.col("x"), ACCESS))
    rest = blanked(F.col("assign"), _long_value)
    rest = F.when(F.size("hex.found") == 0, rest).otherwise(blanked(matches(rest, HEX)))
    rest = F.when(F.size("access.found") == 0, rest).otherwise(blanked(matches(rest, ACCESS)))
    rows = rows.withColumn("rest", rest)
    kinds = [_spans("assign", F.filter("assign.found", lambda m: _long_value(m["value"]))), _spans("access", F.col("access.found")), _spans("hex", F.col("hex.found"))]
    kinds += [_entropy_spans(F.col("rest"), allow, *c) for c in CLASSES]
    spans = F.array_sort(F.concat(*[k.cast(_SPANS) for k in kinds]))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], spans.alias("spans"))


def _mixed(value: Column) -> Column:
    found = value.rlike(MIXED[0])
    for p in MIXED[1:]:
        found &= value.rlike(p)
    return found


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for every document."""
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["rank"] < 3), line), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", line), ",").alias("spans"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_matches(name: str, source: str, column: str, pattern: str) -> str:
    """A table of the matches of a pattern: rid, start, stop, value."""
    p = _sql_text(pattern)
    return f"""{name}_l AS (SELECT rid, regexp_extract_all({column}, {p}) AS f, string_split_regex({column}, {p}) AS g FROM {source}),
{name}_k AS (SELECT rid, f, g, unnest(range(1, len(f) + 1)) AS k FROM {name}_l),
{name} AS (SELECT rid, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start,
  f[k] AS value, start + length(f[k]) AS stop FROM {name}_k)"""


def _sql_blank(name: str, source: str, column: str, pattern: str, keep: str = "true") -> str:
    p = _sql_text(pattern)
    return f"""{name}_l AS (SELECT rid, regexp_extract_all({column}, {p}) AS f, string_split_regex({column}, {p}) AS g FROM {source}),
{name} AS (SELECT rid, array_to_string(list_transform(range(1, len(g) + 1), lambda k: g[k] || coalesce(CASE WHEN {keep.format(v="f[k]")} THEN repeat(' ', length(f[k])) ELSE f[k] END, '')), '') AS x FROM {name}_l)"""


def _sql_class(kind: str, pattern: str, window: int, bits: float) -> str:
    allow = _sql_text("|".join(f"(?:{a})" for a in ALLOW))
    sub = f"substr(value, i + 1, {window})"
    weight = f"list_sum(list_transform(list_distinct(string_split({sub}, '')), lambda c: ({weights(window)})[{window} - length(replace({sub}, c, '')) + 1]))"
    mixed = " AND ".join(f"regexp_matches(substr(value, s + 1, e - s), '{m}')" for m in MIXED) if kind == CLASSES[-1][0] else "true"
    return f"""{_sql_matches(kind, 'rest', 'x', pattern)},
{kind}_w AS (SELECT rid, start, value, unnest(range(0, length(value) - {window} + 1)) AS i FROM {kind} WHERE NOT regexp_matches(value, {allow})),
{kind}_h AS (SELECT *, i - lag(i) OVER (PARTITION BY rid, start ORDER BY i) > {window} AS apart FROM {kind}_w WHERE {weight} <= {most_weight(window, bits)}),
{kind}_i AS (SELECT *, sum(coalesce(apart, false)::INTEGER) OVER (PARTITION BY rid, start ORDER BY i) AS island FROM {kind}_h),
{kind}_s AS (SELECT rid, start, value, min(i) AS s, max(i) + {window} AS e FROM {kind}_i GROUP BY rid, start, value, island),
{kind}_o AS (SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS rank, start + s AS start, start + e AS stop FROM {kind}_s WHERE {mixed})"""


_LONG = f"length(regexp_extract({{v}}, {_sql_text(ASSIGN)}, 2)) >= {LEAST_VALUE}"
OP13_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
{_sql_matches("assign", "t", "x", ASSIGN)},
{_sql_matches("access", "t", "x", ACCESS)},
{_sql_matches("hex", "t", "x", HEX)},
{_sql_blank("rest1", "t", "x", ASSIGN, _LONG)},
{_sql_blank("rest2", "rest1", "x", HEX)},
{_sql_blank("rest", "rest2", "x", ACCESS)},
{", ".join(_sql_class(*c) for c in CLASSES)},
spans AS (
  SELECT rid, 'assign' AS kind, 0 AS rank, start, stop FROM assign WHERE {_LONG.format(v="value")}
  UNION ALL SELECT rid, 'access', 1, start, stop FROM access
  UNION ALL SELECT rid, 'hex', 2, start, stop FROM hex
  {" ".join(f"UNION ALL SELECT * FROM {c[0]}_o" for c in CLASSES)}),
o AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN o USING (rid)
"""
