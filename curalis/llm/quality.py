"""Quality rules: base rules on words and lines, then tokeniser fertility inside bands per language or script."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm import tokens
from curalis.llm.common import stage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
#: A limit lies so many quartile distances from the group's median as one normal value in 10,000 goes beyond.
SPREADS = 3.719 / 0.6745
LEAST_SPREAD = {"chars_per_token": 0.02, "fallback_share": 0.005, "entropy_ratio": 0.003}
#: Token entropy depends on length, so bands are per language and half octave of the token count. Groups of
#: fewer texts use the language's (or script's) band of all lengths, languages of fewer texts that of all
#: texts; such a band is wider by this, over the root of the token count.
#: The quartile distances of each side come from a line (medians of slopes and heights) through their logarithms over
#: all half octaves of the language, so that junk in one of them does not widen its own band; with under ``LEAST_FIT``
#: of them they are its own. They are widened by two standard errors, about 4 over the root of the number of texts.
LEAST_GROUP = 50
LEAST_FIT = 3
ANY_LENGTH = {"chars_per_token": 6.0, "fallback_share": 0.5, "entropy_ratio": 1.0}

_LONGS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_DOUBLES = ("chars_per_token", "fallback_share", "entropy_ratio")
FEATURES = ", ".join([*(f"{c} long" for c in _LONGS), *(f"{c} double" for c in _DOUBLES), "band string"])
_ARROW = pa.schema([*((c, pa.int64()) for c in _LONGS), *((c, pa.float64()) for c in _DOUBLES), ("band", pa.string())])


class WordTable:
    """Words seen by one Python worker: index, characters and, per vocabulary, the pieces of `` word``."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        self.encoding, _ = tokens.byte_bpe(byte_vocabulary)
        self.pieces, self.is_byte = tokens.piece_bpe(piece_vocabulary)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.stats = np.zeros((3, 1024), np.int64)  # tokens, pieces, byte pieces
        self.held = 0

    def learn(self, words: set[bytes]) -> None:
        words.difference_update(self.index)
        if not words:
            return
        new = sorted(words)
        texts = [w.decode() for w in new]
        at = len(self.ids)
        while self.stats.shape[1] < at + len(new):
            self.stats = np.concatenate([self.stats, np.zeros_like(self.stats)], axis=1)
        for i, (text, pieces) in enumerate(zip(texts, self.pieces.encode(texts, num_threads=1), strict=True), at):
            ids = self.encoding.encode_ordinary(" " + text)
            self.ids.append(np.array(ids, "<u2").tobytes())
            self.stats[:, i] = len(ids), len(pieces), sum(3 <= p <= 258 and bool(self.is_byte[p]) for p in pieces)
            self.held += 2 * len(ids)
        self.held += sum(map(len, new))
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def full(self) -> bool:
        return len(self.ids) > tokens.CACHE_WORDS or self.held > tokens.CACHE_BYTES


@functools.cache
def word_table(byte_vocabulary: str, piece_vocabulary: str) -> WordTable:
    return WordTable(byte_vocabulary, piece_vocabulary)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more; ``ids`` numbers equal words alike."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64) + np.uint64(1)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code += wide[k:k + n] * _MIX[k % 5] * np.uint64(2 * (k // 5) + 1)
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    windows = ids[at[:, None] + np.arange(width)]  # equal codes are checked on the words themselves
    _, group, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[group.ravel()] > 1]
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int]:
    """Characters in words, symbols and repeated lines of a text."""
    chars = len(text) - sum(text.count(x) for x in _SPACE)
    symbols = sum(text.count(x) for x in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return chars, symbols, len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script most letters of the text are in, by code point ranges of the large scripts."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cuts = np.array([0x41, 0x370, 0x400, 0x590, 0x600, 0x900, 0xE00, 0x3040, 0x3400, 0xAC00, 0xD7B0])
    names = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "other", "kana", "han", "hangul", "other")
    found = np.bincount(np.searchsorted(cuts, points, side="right"), minlength=12)
    found[0] = 0
    return names[int(found.argmax())] if found.any() else "none"


def _measure(byte_vocabulary: str, piece_vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(byte_vocabulary, piece_vocabulary)
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                keys, texts, langs = (c.to_pylist() for c in cut.columns)
                split = [x.encode().split() if x else [] for x in texts]
                if table.full():
                    table.clear()
                table.learn(set().union(*split))
                get = table.index.__getitem__
                for key, text, lang, words in zip(keys, texts, langs, split, strict=True):
                    n = len(words)
                    band = f"lang:{lang}" if lang else f"script:{script_of(text or '')}"
                    if not n:
                        rows.append((key, 0, 0, 0, 0, 0, 0, None, None, None, band))
                        continue
                    chars, symbols, dup_lines = base_counts(text, words)
                    ids = np.fromiter(map(get, words), np.int64, n)
                    n_tokens, n_pieces, n_bytes = table.stats[:, ids].sum(axis=1).tolist()
                    count = np.bincount(np.frombuffer(b"".join([table.ids[i] for i in ids.tolist()]), "<u2"))
                    share = count[count > 0] / n_tokens
                    entropy = float(-(share * np.log2(share)).sum())
                    rows.append((key, n, chars, symbols, dup_lines, repeated_words(ids), n_tokens, chars / n_tokens,
                                 n_bytes / n_pieces, entropy / np.log2(n_tokens) if n_tokens > 1 else 1.0, band))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows \
                else pa.RecordBatch.from_pylist([], schema=_ARROW)

    return run


def quality_features(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
                     byte_vocabulary: str = "byte_bpe_50k.tiktoken", piece_vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Base counts and fertility of every whole text (null: no words).

    Fertility is measured on the words, each with the space mark before it: characters per token
    of a byte-level vocabulary, entropy of its token ids over log2 of their number, and the share
    of byte-fallback pieces of a piece vocabulary. A text without words has null fertility. A row
    without language is in the band of its main script. Other columns are not read.
    """
    read = docs.select(F.col(key).cast("long"), F.col(text), F.col(lang))
    return read.mapInArrow(_measure(byte_vocabulary, piece_vocabulary), FEATURES)


def _octave() -> F.Column:
    return F.floor(2 * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def fertility_bands(features: DataFrame) -> DataFrame:
    """Lower and upper limit of each measure, from all rows that the base rules keep.

    Per ``band`` (language or script) and ``octave`` of the token count; per band with null
    octave; and one row with both null, from all rows.
    """
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(c) for c in _DOUBLES]
    good = features.where("NOT base_failed").withColumn("octave", _octave())
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    measured = lambda *by: good.groupBy(*by).agg(F.count("*").alias("texts"), *quartiles)
    out = measured("band", "octave").unionByName(
        measured("band").select("band", none("octave", "int"), "texts", *_DOUBLES)).unionByName(
        measured().select(none("band", "string"), none("octave", "int"), "texts", *_DOUBLES))
    sides = [(c, side) for c in _DOUBLES for side in ("low", "high")]
    for c, side in sides:
        wide = F.col(c)[1] - F.col(c)[0] if side == "low" else F.col(c)[2] - F.col(c)[1]
        out = out.withColumn(f"{c}_{side}_spread", F.greatest(wide, F.lit(LEAST_SPREAD[c])))
    out = stage(out, "quartiles")
    lines = out.where((F.col("texts") >= LEAST_GROUP) & F.col("octave").isNotNull()).select(
        "band", "octave", "texts", F.explode(F.array(*[F.struct(F.lit(f"{c}_{side}").alias("name"), F.log(f"{c}_{side}_spread").alias("y")) for c, side in sides])).alias("p"))
    lines = lines.select("band", "octave", "texts", "p.name", "p.y")  # a row for each language, half octave and limit
    left, right = lines.select("band", "name", F.col("octave").alias("o"), F.col("y").alias("z")), lines.select("band", "name", "octave", "y")
    slopes = left.join(right, ["band", "name"]).where("o < octave").groupBy("band", "name").agg(F.median((F.col("y") - F.col("z")) / (F.col("octave") - F.col("o"))).alias("slope"))
    fits = lines.join(slopes, ["band", "name"]).groupBy("band", "name").agg(
        F.count("*").alias("groups"), F.sum("texts").alias("n"), F.first("slope").alias("slope"), F.median(F.col("y") - F.col("slope") * F.col("octave")).alias("base"))
    fits = fits.where(F.col("groups") >= LEAST_FIT).groupBy("band").agg(F.max("n").alias("fitted"), *[
        F.max(F.when(F.col("name") == f"{c}_{side}", F.col(x))).alias(f"{c}_{side}_{x}") for c, side in sides for x in ("slope", "base")])
    out = out.join(fits, "band", "left")
    of = F.coalesce(F.when(F.col("octave").isNotNull(), F.col("fitted")), "texts")
    for c, side in sides:
        fit = F.when(F.col("octave").isNotNull(), F.exp(F.col(f"{c}_{side}_base") + F.col(f"{c}_{side}_slope") * F.col("octave")))
        spread = F.greatest(F.coalesce(fit, f"{c}_{side}_spread"), F.lit(LEAST_SPREAD[c])) * (1 + 4 / F.sqrt(F.greatest(of, F.lit(1))))
        out = out.withColumn(f"{c}_{side}", F.col(c)[1] + F.lit(-SPREADS if side == "low" else SPREADS) * spread)
    return out.select("band", "octave", "texts", *[f"{c}_{side}" for c, side in sides])


def quality_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **vocabularies) -> DataFrame:
    """Features of every document, ``base_failed`` and ``kept``.

    A document fails the base rules with under ``MIN_WORDS`` words or over ``MAX_REPEAT_PERCENT``
    percent of words in repeated five-word windows. The method rejects a document whose characters
    per token, byte-fallback share or token entropy lie outside the band of its language (or script)
    and length. Null or empty texts fail the base rules; repeated rows are judged alike; an empty
    table gives an empty result; the three measures of a text without words are null.
    """
    base = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    found = stage(quality_features(docs, key=key, text=text, lang=lang, **vocabularies).withColumn("base_failed", base), "quality")
    bands = stage(fertility_bands(found), "bands")
    values = [c for c in bands.columns if c not in ("band", "octave", "texts")]
    own = bands.where((F.col("texts") >= LEAST_GROUP) & F.col("octave").isNotNull()).select("band", "octave", *[F.col(c).alias(f"own_{c}") for c in values])
    any_ = bands.where((F.col("texts") >= LEAST_GROUP) & F.col("octave").isNull() & F.col("band").isNotNull()).select("band", *[F.col(c).alias(f"any_{c}") for c in values])
    whole = bands.where("band IS NULL").first()  # one row
    judged = found.withColumn("octave", _octave()).join(own, ["band", "octave"], "left").join(any_, "band", "left")
    outside = F.lit(False)
    for c in _DOUBLES:
        pick = lambda x, c=c: F.coalesce(f"own_{c}_{x}", f"any_{c}_{x}", F.lit(whole[f"{c}_{x}"]).cast("double"))
        slack = F.when(F.col(f"own_{c}_low").isNull(), F.lit(ANY_LENGTH[c]) / F.sqrt(F.greatest("n_tokens", F.lit(1)))).otherwise(F.lit(0.0))
        outside |= F.coalesce((F.col(c) < pick("low") - slack) | (F.col(c) > pick("high") + slack), F.lit(False))
    return judged.select(
        F.col("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outside).alias("kept"), "n_tokens", *_DOUBLES, "band")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
