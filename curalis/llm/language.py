"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy, labels every position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalis.llm.common import DEFAULT_SEED

HIDDEN = 8
#: Texts are read in windows of so many bytes, each from the states that the network is in after so many bytes beside it.
WINDOW = 256
BESIDE = 32
#: Training reads one window of each of at most so many texts a language; texts and the windows' places go by hashes.
SAMPLE = 600
EPOCHS = 14
BATCH = 96
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Two gated recurrent layers, one from each side, and a softmax over both states at every byte.

    Weights of a direction: ``w`` (256, 3H) by byte, ``u`` (H, 3H), ``b`` (3H); gates in the order
    reset, update, candidate; the candidate reads ``r * (h @ u)``.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = DEFAULT_SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p["w" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.p["c" + d] = np.zeros(3 * hidden)
        self.p["v"] = rng.normal(0, 0.3, (2 * hidden, classes))
        self.p["o"] = np.zeros(classes)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _forward(self, x: np.ndarray, mask: np.ndarray, d: str):
        """States (T, B, H) of one direction over bytes ``x`` (T, B), and what the backward pass needs."""
        n, u, h_ = self.hidden, self.p["u" + d], np.zeros((x.shape[1], self.hidden), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        states, kept = np.zeros((*x.shape, n), np.float32), {}
        for t in steps:
            g = self.p["w" + d][x[t]] + self.p["c" + d]
            a = h_ @ u
            r, z = _sigmoid(g[:, :n] + a[:, :n]), _sigmoid(g[:, n:2 * n] + a[:, n:2 * n])
            c = np.tanh(g[:, 2 * n:] + r * a[:, 2 * n:])
            new = np.where(mask[t][:, None], z * h_ + (1 - z) * c, h_)
            kept[t] = (h_, a, r, z, c)
            states[t] = h_ = new
        return states, kept, list(steps)

    def _backward(self, x, mask, d, grad, kept, steps, out):
        """Back-propagation through time of one direction; ``grad`` (T, B, H) is the loss at its states."""
        n, u = self.hidden, self.p["u" + d]
        gw, gu, gc = np.zeros_like(self.p["w" + d]), np.zeros_like(u), np.zeros_like(self.p["c" + d])
        carry = np.zeros((x.shape[1], n), np.float32)
        for t in reversed(steps):
            h_, a, r, z, c = kept[t]
            m = mask[t][:, None]
            total = grad[t] + carry
            new = np.where(m, total, 0)
            gz = new * (h_ - c) * z * (1 - z)
            gn = new * (1 - z) * (1 - c * c)
            gr = gn * a[:, 2 * n:] * r * (1 - r)
            gate = np.concatenate([gr, gz, gn], axis=1)
            inner = np.concatenate([gr, gz, gn * r], axis=1)
            np.add.at(gw, x[t], gate)
            gc += gate.sum(axis=0)
            gu += h_.T @ inner
            carry = np.where(m, new * z + inner @ u.T, total)
        out["w" + d], out["u" + d], out["c" + d] = gw, gu, gc

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all bytes (T, B) under each column's label, and its gradient."""
        f, kf, sf = self._forward(x, mask, "f")
        b, kb, sb = self._forward(x, mask, "b")
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.p["v"] + self.p["o"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        count = max(1, int(mask.sum()))
        at = np.arange(x.shape[1])
        loss = -(np.log(prob[:, at, label] + 1e-12) * mask).sum() / count
        g = prob
        g[:, at, label] -= 1
        g *= mask[:, :, None] / np.float32(count)
        out = {"v": np.einsum("tbh,tbk->hk", both, g), "o": g.sum(axis=(0, 1))}
        back = g @ self.p["v"].T
        self._backward(x, mask, "f", back[:, :, :self.hidden], kf, sf, out)
        self._backward(x, mask, "b", back[:, :, self.hidden:], kb, sb, out)
        return float(loss), out

    def fit(self, texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = DEFAULT_SEED) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(x) for k, x in self.p.items()}
        second = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(texts), batch):
                chosen = order[lo:lo + batch]
                x, mask = columns([texts[k] for k in chosen])
                _, grad = self.gradients(x, mask, label[chosen])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                scale = min(1.0, 1.0 / (norm + 1e-9))
                step += 1
                for k, g in grad.items():
                    g = g * scale
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    pace = rate * (1 - 0.9 * step / steps)
                    self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label_windows(self, x: np.ndarray, real: np.ndarray, beside: int = 0) -> np.ndarray:
        """Class probabilities (K, T - 2 * beside, B) at the bytes of windows ``x`` (T, B), without ``beside`` bytes at either end.

        The same network as in training, laid out so that gates are contiguous rows. Where bytes are
        not ``real`` (T, B), before a text's start or after its end, states are zero.
        """
        n, (length, size) = self.hidden, x.shape
        half = np.ones(3 * n, np.float32)
        half[:2 * n] = 0.5  # sigmoid by tanh of half the argument
        states = np.empty((length - 2 * beside, 2 * n, size), np.float32)
        gate, a = np.empty((3 * n, size), np.float32), np.empty((3 * n, size), np.float32)
        padded = ~real.all(axis=1)
        for d, lo, steps in (("f", 0, range(length - beside)), ("b", n, range(length - 1, beside - 1, -1))):
            w = np.ascontiguousarray(((self.p["w" + d] + self.p["c" + d]) * half).T)
            u = np.ascontiguousarray((self.p["u" + d] * half).T)
            h = np.zeros((n, size), np.float32)
            for t in steps:
                np.take(w, x[t], axis=1, out=gate, mode="clip")
                np.matmul(u, h, out=a)
                gate[:2 * n] += a[:2 * n]
                rz = np.tanh(gate[:2 * n], out=gate[:2 * n])
                rz *= 0.5
                rz += 0.5
                a[2 * n:] *= rz[:n]
                a[2 * n:] += gate[2 * n:]
                c = np.tanh(a[2 * n:], out=a[2 * n:])
                h -= c
                h *= rz[n:]
                h += c
                if padded[t]:
                    h *= real[t]
                if 0 <= t - beside < len(states):
                    states[t - beside, lo:lo + n] = h
        logits = np.einsum("hk,thb->ktb", self.p["v"], states, optimize=True) + self.p["o"][:, None, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits


def columns(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as columns (T, B), padded at the end, and where they are real."""
    length = max(1, max(map(len, texts)))
    x = np.zeros((len(texts), length), np.uint8)
    for k, t in enumerate(texts):
        x[k, :len(t)] = np.frombuffer(t, np.uint8)
    size = np.array([len(t) for t in texts])
    return np.ascontiguousarray(x.T), np.arange(length)[:, None] < size[None, :]


def pooled(model: ByteGru, texts: list[bytes], window: int, beside: int = BESIDE, most: int = 2048) -> np.ndarray:
    """Mean class probabilities over all bytes of each text, read in windows of ``window`` bytes and ``beside`` at either side."""
    count = np.array([-(-len(t) // window) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    size = np.array([len(t) for t in texts], np.int64)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * window
    raw = np.zeros((len(owner), window + 2 * beside), np.uint8)
    at = 0
    for t, k in zip(texts, count.tolist(), strict=True):
        flat = np.zeros(k * window + 2 * beside, np.uint8)
        flat[beside:beside + len(t)] = np.frombuffer(t, np.uint8)
        raw[at:at + k] = np.lib.stride_tricks.sliding_window_view(flat, window + 2 * beside)[::window]
        at += k
    own = np.minimum(window, size[owner] - start)
    out = np.zeros((len(texts), model.p["o"].shape[0]))
    order = np.argsort(-own, kind="stable")
    for lo in range(0, len(order), most):
        chosen = order[lo:lo + most]
        length = int(own[chosen[0]])
        place = start[chosen] - beside + np.arange(length + 2 * beside)[:, None]
        real = (place >= 0) & (place < size[owner[chosen]])
        prob = model.label_windows(np.ascontiguousarray(raw[chosen, :length + 2 * beside].T), real, beside)
        prob *= np.arange(length)[:, None] < own[chosen][None, :]
        np.add.at(out, owner[chosen], prob.sum(axis=1).T)
    return out / np.maximum(1, size)[:, None]


def _predict(model, names: list[str], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            lo = 0
            texts = batch.column("text").to_pylist()
            while lo < len(texts):  # by bytes, so that a very long text stands alone
                hi, held = lo, 0
                while hi < len(texts) and held < 1 << 20:
                    held += len(texts[hi] or "")
                    hi += 1
                some = [bool(t) and _LETTER.search(t) is not None for t in texts[lo:hi]]
                use = [t.encode() for t, s in zip(texts[lo:hi], some, strict=True) if s]
                prob = pooled(net, use, window) if use else np.zeros((0, len(names)))
                best = iter(zip(prob.argmax(axis=1).tolist(), prob.max(axis=1).tolist(), strict=True))
                found = [next(best) if s else None for s in some]
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("held_out"), pa.array([UNKNOWN if f is None else names[f[0]] for f in found], pa.string()),
                     pa.array([0.0 if f is None else min(1.0, f[1]) for f in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])
                lo = hi

    return run


def training_rows(rows: DataFrame, label: str, most: int, salt: str) -> DataFrame:
    """At most ``most`` rows of each label, those with the least hashes; other rows are dropped before the ranking."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each label
    share = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(min(1.0, 1.5 * most / n + 50 / n))) for k, n in counts.items()], F.lit(0.0)) if counts else F.lit(0.0)
    h = F.xxhash64(F.lit(salt), "doc_id")
    near = rows.withColumn("_h", h).where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "text"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_h")


def train(docs: DataFrame, *, sample: int = SAMPLE, hidden: int = HIDDEN, seed: int = DEFAULT_SEED, epochs: int = EPOCHS, window: int = WINDOW) -> tuple[ByteGru, list[str]]:
    """The network and its class names, from rows (doc_id, text, lang): many texts, a window of each for back-propagation."""
    chosen = training_rows(docs.where("lang IS NOT NULL AND length(text) > 0"), "lang", sample, "language")
    data = F.encode("text", "UTF-8")
    start = F.pmod(F.xxhash64(F.lit("window"), "doc_id", "text"), F.greatest(F.lit(1), F.octet_length("text") - window + 1)).cast("int")
    rows = chosen.select("doc_id", "lang", F.substr(data, start + 1, F.lit(window)).alias("part")).orderBy("lang", "doc_id", "part").toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    if not names:
        return ByteGru(1, 1), [UNKNOWN]
    net = ByteGru(len(names), hidden, seed)
    net.fit(rows["part"].to_pylist(), np.array([names.index(x) for x in rows["lang"].to_pylist()]), epochs=epochs, seed=seed)
    return net, names


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: F.Column | None = None,
             window: int = WINDOW, **training) -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred, score (mean probability over its bytes).

    Learns from rows with a language that are not ``held_out`` (default: crc32 of the key as text,
    modulo 4, is 2): a window of each of at most ``SAMPLE`` texts a language. Every byte of
    a text gets class probabilities from the network run from both sides over its window of ``window``
    bytes and ``BESIDE`` bytes before and after; the text's are their mean. Null texts and texts without a letter are ``und`` with score 0; without any
    labelled row every text is. Null keys are not held out; repeated rows are judged alike; an empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = held_out if held_out is not None else F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = rows.withColumn("held_out", out)
    net, names = train(rows.where("NOT held_out").drop("held_out"), **training)
    model = docs.sparkSession.sparkContext.broadcast(net)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model, names, window), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
