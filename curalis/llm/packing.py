"""Bounded-space online packing: best fit into a fixed number of open windows, leftovers merged in rounds."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm import tokens
from curalis.llm.common import stage

WINDOW = 4096
OPEN_WINDOWS = 64
END_ID = 2
#: A merging round takes the leftovers of this many partitions, and closes windows filled to this share.
FAN_IN = 64
FULL_ENOUGH = 0.985

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long, part long, closed boolean")
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")]
                   + [("closed", pa.bool_())])


class OpenWindows:
    """At most ``limit`` open windows; a piece goes where least room is left, else the fullest is emitted."""

    def __init__(self, first_id: int, window: int, limit: int):
        self.window, self.limit, self.next_id = window, limit, first_id
        self.room: list[tuple[int, int]] = []  # (free, id), ascending
        self.pieces: dict[int, list] = {}

    def fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int, piece) -> list[tuple[int, list]]:
        """Places a piece of at most a window; returns the windows that this closes."""
        closed = []
        at = bisect.bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, i = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                _, full = self.room.pop(0)
                closed.append((full, self.pieces.pop(full)))
            free, i = self.window, self.fresh()
            self.pieces[i] = []
        self.pieces[i].append((self.window - free, piece))
        if free == length:
            closed.append((i, self.pieces.pop(i)))
        else:
            bisect.insort(self.room, (free - length, i))
        return closed


def _pack(window: int, limit: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = tokens.word_end_bpe(tokenizer)
        open_ = OpenWindows(part << 32, window, limit)
        end = END_ID.to_bytes(4, "little")
        rows: list[tuple] = []

        def emit(closed, done=True):
            for i, pieces in closed:
                rows.extend((*p, i, offset, part, done) for offset, p in pieces)

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                for doc, ids in zip(cut.column(0).to_pylist(), encoder.encode(cut.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        part_ids = ids[4 * start:4 * (start + window)]
                        length = len(part_ids) // 4
                        piece = (doc, start, length, zlib.crc32(part_ids), n)
                        if length == window:
                            emit([(open_.fresh(), [(0, piece)])])
                        else:
                            emit(open_.place(length, piece))
                if len(rows) > 20_000:
                    yield flush()
        emit(open_.pieces.items(), done=False)
        if rows:
            yield flush()

    return run


def _merge(round_: int, window: int, limit: int, last: bool):
    """Re-packs the leftovers of a bounded number of partitions by decreasing length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32", "part"], ascending=[False, True, True, True, True], kind="stable")
        group = int(pdf["group"].iloc[0])
        open_ = OpenWindows((round_ << 56) | (group << 32), window, len(pdf) + 1)
        done: list[tuple[int, list]] = []
        values = list(zip(*(pdf[c].tolist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), strict=True))
        for piece in values:
            done += open_.place(piece[2], piece)
        rest = [i for _, i in open_.room]  # fullest first
        if last:
            keep: list[int] = []
        else:
            keep = [i for free, i in open_.room if free > (1 - FULL_ENOUGH) * window][-limit:]
        kept = set(keep)
        rows = [(*p, i, offset, group, True) for i, pieces in done for offset, p in pieces]
        for i in rest:
            rows += [(*p, i, offset, group, i not in kept) for offset, p in open_.pieces[i]]
        out = pd.DataFrame(rows, columns=_ARROW.names)
        return out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Pack every row's token ids (with the end id) into sequences of at most ``window`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    document's full windows stand alone; the rest of it is placed whole, best fit, into one of
    the partition's ``open_windows``, of which the fullest is emitted when none fits. What a
    partition leaves open is re-packed with that of ``FAN_IN`` - 1 others, round after round;
    a round hands on at most ``open_windows`` windows. A null or empty text has only the end
    id; null keys are kept; repeated rows are packed each; an empty table has no pieces; other
    columns are not read. The pieces' table is staged, so each document is encoded once.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = stage(read.mapInArrow(_pack(window, open_windows, tokenizer), PIECE), "pieces")
    out = [made.where("closed")]
    left = made.where("NOT closed")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    round_ = 1
    while True:
        last = parts <= FAN_IN
        groups = -(-parts // FAN_IN)
        dealt = left.withColumn("group", F.expr(f"part div {FAN_IN}")).repartition(groups, "group")
        merged = stage(dealt.groupBy("group").applyInPandas(_merge(round_, window, open_windows, last), PIECE), f"merged{round_}")
        out.append(merged.where("closed"))
        if last:
            break
        left, parts, round_ = merged.where("NOT closed"), groups, round_ + 1
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.drop("part", "closed")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
