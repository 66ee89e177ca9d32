"""Stable ranks, digests, fingerprints and signatures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


def let(c: Column, use) -> Column:
    """``use(c)`` with ``c`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def text_of(part) -> Column:
    """A part of an identity as text; null is the word None."""
    c = part if isinstance(part, Column) else F.lit(part)
    return F.coalesce(c.cast("string"), F.lit("None"))


def stable_rank(seed: int, *parts) -> Column:
    """Hexadecimal priority of a row from a seed and its identity, whatever the order of arrival."""
    return F.sha2(F.concat_ws(NUL, F.lit(str(seed)), *[text_of(p) for p in parts]), 256)


def hex_number(digest: Column, digits: int = 13) -> Column:
    """The first hex digits of a digest as a long; 13 digits are exact as doubles too."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from a digest's first 52 bits."""
    return (hex_number(digest).cast("double") + 1) / (2.0**52 + 1)


def logical_id(*parts) -> Column:
    """Digest of a row's place: repository, revision and path, for instance."""
    return F.sha2(F.concat_ws(NUL, *[text_of(p) for p in parts]), 256)


def canonical_text(c: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))


def content_digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def fingerprint(df: DataFrame, *keys: str, value: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Digest of a set of ids, per group ``by``: ids are hashed per bucket in order, then the buckets' digests.

    No list holds more than a bucket's ids. There are 64 buckets, and more (up to 65,536, a power of two) for tables of over 640,000
    rows, so that a bucket has some 10,000 ids.
    """
    by = by or []
    if buckets is None:
        buckets = max(64, min(1 << 16, 1 << (df.count() // 10_000).bit_length()))
    ids = df.select(*by, F.col(value).cast("string").alias("_id"))
    bucket = F.conv(F.substring(F.sha2("_id", 256), 1, 4), 16, 10).cast("int") % buckets
    first = ids.groupBy(*by, bucket.alias("_bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_id")), "\n"), 256).alias("_digest"))
    return first.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))), lambda x: x["_digest"]), "\n"), 256).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of equal length, eight digits at a time; null for unequal lengths."""
    words = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / 8).cast("int") - 1, F.lit(0))),
                                  lambda i: F.conv(F.substr(c, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    bits = F.aggregate(F.zip_with(words(a), words(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), bits)


def bits_to_hex(bits: Column, n: int) -> Column:
    """Hex digits of an array of ``n`` booleans, first bit highest."""
    digit = lambda b, i: F.aggregate(F.slice(b, i * 4 + 1, 4), F.lit(0), lambda s, x: s * 2 + x.cast("int"))
    return let(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n // 4 - 1)), lambda i: F.lower(F.hex(digit(b, i)))), ""))


def difference_signature(v: Column, n: int) -> Column:
    """Whether each element of a vector of ``n + 1`` or more is smaller than the next, as hex."""
    return bits_to_hex(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(v, i + 1) > F.element_at(v, i)), n)


def cosine_matrix(side: int) -> list[list[float]]:
    """Rows of the orthonormal cosine transform (type II)."""
    return [[math.sqrt((1 if u == 0 else 2) / side) * math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(side)]


def matrix_column(matrix: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])


def sandwich(left: list[list[float]], grid: Column, right: list[list[float]], side: int) -> Column:
    """``left`` times the row-major square grid times the transpose of ``right``, row-major; terms are added in the grid's order."""
    places = F.sequence(F.lit(0), F.lit(side * side - 1))
    one = lambda g, a, b: F.aggregate(places, F.lit(0.0), lambda s, i: s + F.element_at(g, i + 1) * F.element_at(a, (F.floor(i / side) + 1).cast("int")) * F.element_at(b, i % side + 1))
    cells = F.transform(grid, lambda x: x.cast("double"))
    return let(F.struct(cells.alias("g"), matrix_column(left).alias("l"), matrix_column(right).alias("r")),
               lambda x: F.flatten(F.transform(x["l"], lambda a: F.transform(x["r"], lambda b: one(x["g"], a, b)))))


def separable(left: list[list[float]], grid: Column, right: list[list[float]], side: int) -> Column:
    """``sandwich`` in two steps, rows first: fewer products for matrices of many rows, sums in another order."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    columns = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.get(grid, i * side + j).cast("double")))
    half = let(F.struct(columns.alias("c"), matrix_column(left).alias("l")), lambda x: F.transform(x["l"], lambda a: F.transform(x["c"], lambda c: dot(a, c))))
    return let(F.struct(half.alias("h"), matrix_column(right).alias("r")), lambda x: F.flatten(F.transform(x["h"], lambda h: F.transform(x["r"], lambda b: dot(h, b)))))


def cosine_signature(grid: Column, side: int = 8) -> Column:
    """Which coefficients of a grid's two-dimensional cosine transform exceed their lower median, as hex."""
    c = cosine_matrix(side)
    coefficients = F.transform(sandwich(c, grid, c, side), lambda x: F.round(x, 6))
    pair = lambda c: F.struct(c.alias("c"), F.element_at(F.array_sort(c), side * side // 2).alias("m"))
    return bits_to_hex(let(let(coefficients, pair), lambda p: F.transform(p["c"], lambda x: x > p["m"])), side * side)


def stretched(side: int, out: int) -> list[list[float]]:
    """Matrix that resamples ``side`` values at ``out`` places by linear interpolation, ends held."""
    rows = []
    for k in range(out):
        at = min(max((k + 0.5) * side / out - 0.5, 0.0), side - 1.0)
        low = min(int(at), side - 2)
        rows.append([1 - (at - low) if j == low else at - low if j == low + 1 else 0.0 for j in range(side)])
    return rows


def low_frequencies(side: int, low: int = 16) -> list[list[float]]:
    """Matrix from ``side`` values to the ``low`` first coefficients of their cosine transform at four times as many places."""
    wide = stretched(side, 4 * low)
    return [[round(sum(c * w[j] for c, w in zip(row, wide, strict=True)), 12) for j in range(side)] for row in cosine_matrix(4 * low)[:low]]


def cosine_signature_256(grid: Column, side: int = 8) -> Column:
    """64 hex digits: which of the 16 by 16 lowest coefficients of the stretched grid's cosine transform exceed their lower median."""
    m = low_frequencies(side)
    coefficients = F.transform(separable(m, grid, m, side), lambda x: F.round(x, 6))
    pair = lambda c: F.struct(c.alias("c"), F.element_at(F.array_sort(c), 128).alias("m"))
    return bits_to_hex(let(let(coefficients, pair), lambda p: F.transform(p["c"], lambda x: x > p["m"])), 256)


def difference_signature_256(grid: Column, side: int = 8) -> Column:
    """64 hex digits: which of 16 by 17 cells of the stretched grid are smaller than the next one in their row."""
    cells = F.transform(separable(stretched(side, 16), grid, stretched(side, 17), side), lambda x: F.round(x, 6))
    return let(cells, lambda v: bits_to_hex(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.element_at(v, (i + F.floor(i / 16) + 2).cast("int")) > F.element_at(v, (i + F.floor(i / 16) + 1).cast("int"))), 256))


def segment_bits(df: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit signatures of the sentences of every text: ``key``, ``segments`` (hex strings, each once).

    Bit k is set where most of a sentence's words have it set in the first half of their MD5. Each distinct sentence is
    worked out once. Texts without a sentence are left out.
    """
    parts = F.array_distinct(F.filter(F.transform(F.split(canonical_text(F.col(text)), r"[.!?]+ *"), lambda s: F.trim(s)), lambda s: s != ""))
    own = df.select(key, F.explode(parts).alias("_s"))
    words = own.select("_s").distinct().select("_s", F.explode(F.split("_s", " ")).alias("_w"))
    half = lambda k: F.conv(F.substring(F.md5("_w"), 1 + 8 * k, 8), 16, 10).cast("long")
    words = words.select("_s", half(0).alias("_h0"), half(1).alias("_h1"))
    votes = [F.sum(F.shiftright(f"_h{k // 32}", 31 - k % 32).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{k}") for k in range(64)]
    signed = words.groupBy("_s").agg(*votes).select("_s", bits_to_hex(F.array(*[F.col(f"_b{k}") > 0 for k in range(64)]), 64).alias("_x"))
    return own.join(signed, "_s").groupBy(key).agg(F.collect_set("_x").alias("segments"))


def segment_signatures(text: Column) -> Column:
    """Digests of a text's sentences, normalised; empty sentences are left out."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+[ \t\n]*"), canonical_text), lambda s: s != "")
    return F.transform(parts, lambda s: F.sha2(s, 256))


def token_signature(df: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit signature of each text's distinct tokens: bit k is set where most tokens' hashes have it set."""
    words = df.select(key, F.explode(F.array_distinct(F.split(canonical_text(F.col(text)), " "))).alias("_w")).withColumn("_h", F.xxhash64("_w"))
    votes = [F.sum(F.shiftright("_h", k).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{k}") for k in range(64)]
    summed = words.groupBy(key).agg(*votes)
    return summed.select(key, bits_to_hex(F.array(*[F.col(f"_b{k}") > 0 for k in range(64)]), 64).alias("signature"))
