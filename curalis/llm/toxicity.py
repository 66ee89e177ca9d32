"""Toxicity by noisy-channel deobfuscation: disguised words are decoded under a character model, then texts are scored."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm.common import slots, stage, working
from curalis.llm.language import training_rows

#: What a sign may stand for in a disguised word.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
#: Signs that may stand between the letters of a spaced-out word.
GAPS = " .-_*~'·,"
#: Channel costs, natural logarithms.
AS_LEET, AS_ANY, DROP_GAP, DROP_REPEAT, DROP_DOUBLE, DROP_OTHER = -0.5, -2.0, -0.1, -0.4, -4.0, -9.0
#: A gap that ends a word: of one character, and of more.
BREAK, WIDE_BREAK = -1.0, -0.2
#: Signs that may also be marks before or after a word.
MARKS = "!|+(*#%"
#: Readings of tokens of up to so many characters are kept by each worker, so many of them; others are decoded each time.
KEPT = 100
KEPT_TOKENS = 300_000

#: The word weights and the final scale are learnt on at most so many texts of each label, those with the least hashes.
SAMPLE = 2500
LEAST_TEXTS = 3

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
_CODE = {c: k + 1 for k, c in enumerate(_LETTERS)}
_OTHER = len(_LETTERS) + 1
_SIZE = _OTHER + 1  # 0: outside words
_TABLE = np.zeros(0x250, np.uint8)
for _c in map(chr, range(0x250)):
    if _c.isalpha():
        _TABLE[ord(_c)] = _CODE.get(_c.lower(), _OTHER) if len(_c.lower()) == 1 else _OTHER


def letter_codes(text: str) -> np.ndarray:
    """Code of each character: 0 outside words, a letter's number, or one number for all other letters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], _OTHER).astype(np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                c = np.concatenate([[0, 0], letter_codes(text), [0]])
                counts += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3) if len(c) > 20_000 else 0
                if len(c) <= 20_000:
                    np.add.at(counts, (c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])


class CharModel:
    """Interpolated trigram model over letter codes; ``log[a, b, c]`` is the log probability of c after a, b."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * _SIZE)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        self.log = np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20))
        self.rows = self.log.tolist()
        self.tails: dict[tuple, str] = {}


def character_model(docs: DataFrame, text: str = "text") -> CharModel:
    """From the trigrams of all whole texts: a count per partition and trigram, summed by Spark; the table's size is fixed."""
    made = docs.select(text).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SIZE**3, np.int64)
    counts[made["gram"].to_numpy()] = made["n"].to_numpy()
    return CharModel(counts)


def decode(span: str, model: CharModel, *, breaks: bool = False, doubles: bool = True) -> str:
    """The likeliest words behind a disguised span: Viterbi over its character lattice, left to right.

    A letter stands for itself, a run of one for one or two of it; a sign stands for the letters of
    ``LEET``, or at a price for nothing; gaps stand for nothing or, with ``breaks``, for the end of a
    word. Without ``doubles`` no sign stands for nothing. States are the last two letters written, all
    of them go on at each place, with back pointers, so spans may be of any length.

    Single letters at the start leave one state; what follows depends on the last two of them alone,
    so readings of short rests are kept.
    """
    low = span.lower()
    runs = [(c, len(list(g))) for c, g in itertools.groupby(low)]
    doubled = len(runs) > 2 and all(n > 1 for _, n in runs)
    plain = 0
    while plain < len(runs) and runs[plain][1] == 1 and runs[plain][0].isalpha() and runs[plain][0] not in LEET:
        plain += 1
    if plain == len(runs):
        return low
    start = (_CODE.get(low[plain - 2], _OTHER) if plain > 1 else 0, _CODE.get(low[plain - 1], _OTHER) if plain else 0)
    rest = low[plain:]
    key = (start, rest, breaks, doubles, doubled)
    found = model.tails.get(key)
    if found is None:
        found = viterbi(lattice(runs[plain:], breaks, doubles, doubled), start, model)
        if len(rest) <= KEPT:
            if len(model.tails) > KEPT_TOKENS:
                model.tails = {}
            model.tails[key] = found
    return low[:plain] + found


def lattice(runs: list[tuple[str, int]], breaks: bool, doubles: bool, doubled: bool) -> list[list[tuple[str, float]]]:
    """For each place of a span, given as runs of equal characters: what may be written there, and its cost."""
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(runs):
        c, n = runs[at]
        at += 1
        if c in LEET:
            cost = AS_ANY if len(LEET[c]) > 2 else AS_LEET
            write = [(x, cost) for x in LEET[c]]
            if breaks and not c.isalnum():
                write.append((" ", BREAK))
            again = DROP_REPEAT if n > 2 or doubled else DROP_DOUBLE
            for k in range(n):
                places.append([*write, ("", DROP_GAP if c in GAPS else again if k else DROP_OTHER)] if doubles else write)
        elif c in GAPS or c.isspace():
            while at < len(runs) and (runs[at][0] in GAPS and runs[at][0] not in LEET or runs[at][0].isspace()):
                n += runs[at][1]
                at += 1
            places.append([("", DROP_GAP), (" ", BREAK if n == 1 else WIDE_BREAK)] if breaks else [("", DROP_GAP)])
        elif not c.isalpha():
            places.append([("", DROP_OTHER)])
        elif n == 1:
            places.append([(c, 0.0)])
        else:
            places.append([(c, DROP_REPEAT if n > 2 or doubled else DROP_DOUBLE), (c + c, DROP_DOUBLE if doubled and n == 2 else 0.0)])
    return places


def viterbi(places: list[list[tuple[str, float]]], start: tuple[int, int], model: CharModel) -> str:
    """What is likeliest written over the lattice's places after the two letters ``start``, up to a word's end."""
    rows = model.rows
    states: dict[tuple[int, int], float] = {start: 0.0}
    trail: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for choices in places:
        coded = [(x, tuple(0 if y == " " else _CODE.get(y, _OTHER) for y in x), cost) for x, cost in choices]
        following: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in states.items():
            for x, codes, cost in coded:
                (i, j), total = state, score + cost
                if codes == (0,) and not j:  # a word ends once
                    codes = ()
                for k in codes:
                    total += rows[i][j][k]
                    i, j = j, k
                if (i, j) not in following or total > following[i, j]:
                    following[i, j], came[i, j] = total, (state, x)
        states = following
        trail.append(came)
    state = max(states, key=lambda s: states[s] + (rows[s[0]][s[1]][0] if s[1] else 0.0))
    out = []
    for came in reversed(trail):
        state, x = came[state]
        out.append(x)
    return "".join(reversed(out))


_SIGNS = regex.escape("".join(LEET), special_only=False)
_GAPS = regex.escape(GAPS, special_only=False)
_SINGLE = rf"[\p{{L}}{regex.escape(''.join(c for c in LEET if c not in GAPS), special_only=False)}]"
#: Letters and signs written together; single letters (or signs) with gaps of any width between them.
_SPAN = regex.compile(rf"[\p{{L}}{_SIGNS}]+")
_SPACED = regex.compile(rf"(?<!{_SINGLE}|\p{{N}}){_SINGLE}(?:[{_GAPS}\s]++{_SINGLE}(?!{_SINGLE}|\p{{N}})){{2,}}+")
#: Characters that ``_SPACED`` takes for a letter or that may not stand beside one.
_BESIDE = np.array([c.isalpha() or c.isnumeric() or c in LEET and c not in GAPS for c in map(chr, range(0x10000))])
_FIRST, _LAST = regex.compile(rf"^.[{_GAPS}\s]+"), regex.compile(rf"(?<![{_GAPS}\s])[{_GAPS}\s]+.$")
_WORD = regex.compile(r"\p{L}+")
_LETTER = regex.compile(r"\p{L}")
_DISGUISED = regex.compile(rf"[{_SIGNS}]|(\p{{L}})\1")
_TWO_SIGNS = regex.compile(rf"([{_SIGNS}])(?<!\1\1)\1(?!\1)")
_DOUBLE = regex.compile(r"(\p{L})\1")
_ANY_DOUBLE = re.compile(r"(.)\1")
#: Doubles beside each other, or longer runs.
_CROWDED = regex.compile(r"(\p{L})\1(?:\1|(\p{L})\2)")
_ENDS = ".,;:!?\"'()"


def single(word: str, model: CharModel) -> str:
    """``decode`` of a word of letters: doubles that stand apart are decided one by one, as no other choice meets them."""
    if _ANY_DOUBLE.search(word) is None:
        return word
    if _CROWDED.search(word) is not None:
        return decode(word, model)
    code, rows = _CODE.get, model.rows
    out, done = [], 0
    for m in _DOUBLE.finditer(word):
        at = m.start()
        a, x, b = (code(word[at - 1], _OTHER) if at else 0), code(m[1], _OTHER), (code(word[at + 2], _OTHER) if at + 2 < len(word) else 0)
        if DROP_DOUBLE + rows[a][x][b] > rows[a][x][x] + rows[x][x][b]:
            out.append(word[done:at + 1])
            done = at + 2
    return "".join(out) + word[done:]


def may_be_spaced(text: str) -> bool:
    """Whether three letters in a row stand alone, as ``_SPACED`` needs; a quick look before its search."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points) or points.max() > 0xFFFF:
        return True
    edges = np.flatnonzero(np.diff(_BESIDE[points], prepend=False, append=False))
    alone = edges[1::2] - edges[::2] == 1
    return bool((alone[:-2] & alone[1:-1] & alone[2:]).any())


class Restorer:
    """Words of a text and of the readings of its disguised spans; readings of short tokens are kept per worker."""

    def __init__(self, model: CharModel):
        self.model = model
        self.seen: dict[str, tuple[str, ...]] = {}

    def readings(self, span: str) -> set[str]:
        """Readings of letters and signs written together: marks at either end are signs for letters or mere marks."""
        out = set()
        for cut in {span, span.lstrip(MARKS), span.rstrip(MARKS), span.strip(MARKS)}:
            if _LETTER.search(cut) is None:
                continue
            if cut.isalpha():
                out.add(single(cut, self.model))
                continue
            out.add(decode(cut, self.model))
            if _TWO_SIGNS.search(cut) is not None:
                out.add(decode(cut, self.model, doubles=False))
        return out

    def read(self, token: str) -> set[str]:
        """Words of a token without white space: itself without sentence marks, its runs of letters, its readings."""
        words = {token.strip(_ENDS)}
        if (core := token.strip(".,;:?\"')")).isalpha():
            words.add(single(core, self.model))
        else:
            words.update(_WORD.findall(token))
            for span in _SPAN.findall(token):
                if _DISGUISED.search(span) is not None:
                    words.update(self.readings(span))
        words.discard("")
        return words

    def token(self, token: str) -> tuple[str, ...]:
        """``read``, kept for short tokens."""
        found = self.seen.get(token)
        if found is None:
            found = tuple(self.read(token))
            if len(token) <= KEPT:
                if len(self.seen) > KEPT_TOKENS:
                    self.seen = {}
                self.seen[token] = found
        return found

    def words(self, text: str | None) -> set[str]:
        """Distinct lower-case words of the text and of the readings of its disguised spans."""
        if not text:
            return set()
        plain = text.lower()
        words = set().union(*[self.seen.get(t) or self.token(t) for t in set(plain.split())])
        words |= self.spaced(plain)
        words.discard("")
        return words

    def spaced(self, plain: str) -> set[str]:
        """Words of the readings of spaced-out letters in a lower-case text."""
        words: set[str] = set()
        for span in _SPACED.findall(plain) if may_be_spaced(plain) else ():
            if _LETTER.search(span) is not None:
                words.add(decode(span, self.model))
                # the first or last letter may be a word by itself: 'a s c u m'
                for part in (span, _FIRST.sub("", span), _LAST.sub("", span)):
                    words.update(decode(part, self.model, breaks=True).split())
        words.discard("")
        return words


class KnownFeatures(Restorer):
    """Those features of a text that have a weight; of a token that has been read before only these are kept."""

    def __init__(self, model: CharModel, known: dict[str, float]):
        super().__init__(model)
        self.known = known
        self.held: dict[str, tuple[str, ...]] = {}

    def _of(self, words) -> tuple[str, ...]:
        return tuple(f for f in features(set(words)) if f in self.known)

    def of(self, text: str | None) -> set[str]:
        found: set[str] = set()
        if not text:
            return found
        plain = text.lower()
        held = self.held
        if len(held) > KEPT_TOKENS:
            held.clear()
        for token in set(plain.split()):
            some = held.get(token)
            if some is None:
                some = self._of(self.read(token))
                if len(token) <= KEPT:
                    held[token] = some
            if some:
                found.update(some)
        found.update(self._of(self.spaced(plain)))
        return found


def features(words: set[str]) -> set[str]:
    return words | {f"{w[:4]}-" for w in words if len(w) > 4} | {f"{w[:5]}-" for w in words if len(w) > 5}


def weigh(counts: pa.Table, texts: dict[tuple[int, int], int], folds: tuple[int, ...]) -> dict[str, float]:
    """Log ratio of a feature's share among toxic texts (a cautious one) to that among the others, in some folds.

    ``counts`` has a row for each feature with the number of texts of fold f and label y in column
    ``n<f><y>``; ``texts`` has their totals by (f, y).
    """
    total = lambda y: sum(texts.get((f, y), 0) for f in folds) or 1
    of = lambda y: sum(counts[f"n{f}{y}"].to_numpy() for f in folds)
    yes, no = of(1), of(0)
    weight = np.log(np.maximum(yes - 1.3 * np.sqrt(yes), 0.2) / total(1)) - np.log((no + 0.7) / total(0))
    good = (yes >= LEAST_TEXTS) & (weight > 1)
    return dict(zip(counts["feature"].filter(pa.array(good)).to_pylist(), weight[good].tolist(), strict=True))


class Scorer:
    """Word weights and a logistic scale on (largest weight, sum of weights of the weightiest words)."""

    def __init__(self, weights: dict[str, float], signals: np.ndarray, label: np.ndarray):
        self.weights = weights
        self.scale = self._fit(signals, label.astype(float))

    def signals(self, found) -> tuple[float, float]:
        return strongest(self.weights, found)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
        """Ridge logistic regression with intercept, by Newton steps."""
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        w = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            r = penalty * np.array([1, 1, 0.01])
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(r) + 1e-6 * np.eye(3), x.T @ (y - p) - r * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        return w

    def score(self, found: set[str]) -> float:
        a, b = self.signals(found)
        return float(1 / (1 + np.exp(-np.clip(self.scale @ (a, b, 1.0), -30, 30))))


def strongest(weights: dict[str, float], found) -> tuple[float, float]:
    top = sorted((weights[f] for f in found if f in weights), reverse=True)[:6]
    return (top[0], sum(top)) if top else (0.0, 0.0)


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                cut = batch.slice(lo, 64)
                found = [sorted(features(restorer.words(t))) for t in cut.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column("fold"), cut.column("y"), pa.array(found, pa.list_(pa.string()))], names=["fold", "y", "features"])

    return run


def _signals(weights):
    """Signals of each fold's texts under the weights learnt from the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = weights.value
        for batch in batches:
            made = [strongest(other[f], found) for f, found in zip(batch.column("fold").to_pylist(), batch.column("features").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([a for a, _ in made], pa.float64()), pa.array([b for _, b in made], pa.float64())],
                                             names=["y", "top", "sum"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, scorer = model.value
        reader = KnownFeatures(chars, scorer.weights)
        for batch in batches:
            scores = [scorer.score(reader.of(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return run


def _digest() -> F.Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")


def train(taught: DataFrame, rows: DataFrame, chars: CharModel, sample: int) -> Scorer:
    """Word weights from labelled texts: equal texts once, at most ``sample`` of each label, at the labels' true shares.

    ``taught`` (doc_id, digest, toxic) has no texts; those of the chosen rows alone are looked up in ``rows``.
    Words are read and counted in tasks; the driver gets the words that enough toxic texts have, and two numbers for each text.
    """
    distinct = taught.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in distinct.groupBy("toxic").count().collect()}
    chosen = training_rows(distinct.withColumn("text", F.col("digest")), "toxic", sample, "toxicity").select("digest", "doc_id", F.col("toxic").alias("y"))
    full = rows.select("doc_id", "text", _digest()).join(F.broadcast(chosen), ["digest", "doc_id"])  # at most 2 * sample rows
    spark = rows.sparkSession
    texts = full.dropDuplicates(["digest"]).select((F.pmod(F.xxhash64("digest"), F.lit(2))).cast("int").alias("fold"), "y", "text").repartition(slots(spark))
    found = stage(texts.mapInArrow(_features(spark.sparkContext.broadcast(chars)), "fold int, y int, features array<string>"), "features")
    cells = [(f, y) for f in (0, 1) for y in (0, 1)]
    counts = found.select("fold", "y", F.explode("features").alias("feature")).groupBy("feature").agg(
        *[F.count_if((F.col("fold") == f) & (F.col("y") == y)).alias(f"n{f}{y}") for f, y in cells]).where(
        F.col("n01") + F.col("n11") >= LEAST_TEXTS).orderBy("feature").toArrow()  # words of at least so many of the chosen texts
    number = {(r.fold, r.y): r["count"] for r in found.groupBy("fold", "y").count().collect()}
    halves = spark.sparkContext.broadcast({0: weigh(counts, number, (1,)), 1: weigh(counts, number, (0,))})
    made = found.mapInArrow(_signals(halves), "y int, top double, sum double").orderBy("y", "top", "sum").toArrow()
    label = made["y"].to_numpy()
    scorer = Scorer(weigh(counts, number, (0, 1)), np.stack([made["top"].to_numpy(), made["sum"].to_numpy()], axis=1).reshape(-1, 2), label)
    yes, no = int(label.sum()), int((label == 0).sum())
    if yes and no:  # labels may have been drawn at different rates
        scorer.scale[2] += math.log(totals.get(1, yes) / yes) - math.log(totals.get(0, no) / no)
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Labels are learnt from rows whose crc32 of the key as text, modulo 5, is not 0. A character model is
    counted over all texts; spans of any length that may be disguised words (signs for letters, doubled
    or repeated letters, letters spaced apart) are decoded under it; a text is scored by its plain and
    restored words. Rows of ``labels`` without a label or key are not
    used; of several labels for one text toxic wins. Null and empty texts have no words and get the
    score of a text without any weighty word. Without labels, scores are the fit's 0.5 and below.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "held_out", F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    chars = character_model(rows)
    open_ = rows.where("NOT held_out")
    with working(docs.sparkSession):
        taught = stage(open_.select("doc_id", _digest()).join(known, "doc_id"), "taught")
        scorer = train(taught, open_, chars, sample)
    model = docs.sparkSession.sparkContext.broadcast((chars, scorer))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, labels of ``labels.toxic``."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
