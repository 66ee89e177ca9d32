"""Token counts per section: whole documents are encoded once, token spans are joined to section spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm import tokens

RULES = ("first", "last", "most")
COUNTS = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in COUNTS.split(", ")])


def line_spans(text: str) -> np.ndarray:
    """Sections of a text: its lines, each with its line feed; ``[start, end)`` in characters, without gaps."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    cuts = np.concatenate([[0], ends, [len(text)]])
    return np.unique(cuts)


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> np.ndarray:
    """Character ``[start, end)`` of each id of a byte-level vocabulary.

    Token byte lengths add up to the text's bytes, so spans are running sums. A token that ends
    inside a character's bytes is given that character whole.
    """
    ends = np.cumsum(lengths[np.asarray(ids, np.int64)])
    starts = ends - lengths[np.asarray(ids, np.int64)]
    if text.isascii():
        return np.stack([starts, ends])
    raw = np.frombuffer(text.encode(), np.uint8)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    begun = (raw & 0xC0) != 0x80
    from_ = first[starts] - np.where(begun[np.minimum(starts, len(raw) - 1)], 0, 1)
    return np.stack([from_, first[ends]])


def attribute(spans: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and which tokens cross a boundary. ``cuts``: section starts and the last end.

    ``first``/``last``: the section of the token's first or last character. ``most``: the section
    with most of its characters, the earlier one on a tie.
    """
    first = np.searchsorted(cuts, spans[0], side="right") - 1
    last = np.searchsorted(cuts, spans[1] - 1, side="right") - 1
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for i in np.flatnonzero(crossing):  # few: one at most for each boundary
        a, b = spans[:, i]
        sections = np.arange(first[i], last[i] + 1)
        held = np.minimum(cuts[sections + 1], b) - np.maximum(cuts[sections], a)
        out[i] = sections[held.argmax()]
    return out, crossing


def _count(rule: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = tokens.byte_bpe(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                made = []
                cut = batch.slice(lo, 512)
                for key, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    keys = np.ma.masked_all(1, np.int64) if key is None else np.array([key])
                    if not text:
                        made.append((keys, *np.zeros((6, 1), np.int64)))
                        continue
                    ids = encoding.encode_ordinary(text)
                    cuts = line_spans(text)
                    n = len(cuts) - 1
                    section, crossing = attribute(token_spans(text, ids, lengths), cuts, rule)
                    made.append((np.ma.repeat(keys, n) if key is None else np.repeat(keys, n), np.arange(n), cuts[:-1], cuts[1:],
                                 np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n), np.full(n, len(ids))))
                if made:
                    columns = list(zip(*made, strict=True))
                    ids_ = np.ma.concatenate(columns[0])
                    arrays = [pa.array(np.ma.getdata(ids_), pa.int64(), mask=np.ma.getmaskarray(ids_))]
                    arrays += [pa.array(np.concatenate(c), pa.int64()) for c in columns[1:]]
                    yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    return run


def section_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: str = "most",
                   vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Tokens of every line of every whole text, each token counted in exactly one line.

    One row per line: doc_id, section (from 0), start_char, end_char (its line feed included),
    n_tokens, n_crossing (of these, tokens that reach into another line), doc_tokens. A token that
    crosses boundaries is allocated by ``rule``: see ``attribute``. A null or empty text has one
    empty section. Null keys stay null; repeated rows are counted each; an empty table has no
    sections; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    read = docs.select(F.col(key).cast("long"), F.col(text))
    return read.mapInArrow(_count(rule, vocabulary), COUNTS)


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents; a crossing token goes where most of it lies."""
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
