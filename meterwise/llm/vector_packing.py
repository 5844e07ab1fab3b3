"""Packing examples into training sequences by vector bin packing.

An example has a demand in three dimensions: tokens, segments (one) and
loss-bearing tokens. A sequence is filled by the dot-product heuristic: of the
examples that still fit in every dimension, the one whose demand points most
along what is left of the capacities is placed next, until none fits. Examples
with equal demands are interchangeable, so a step chooses among demands, of
which there are at most as many as the capacities allow, not among examples;
its cost grows with the number of different counts of tokens without loss.

Documents are tokenised whole and cut every ``tokens`` ids; a piece of full
length is a sequence of its own. Pieces are dealt to packing tasks of bounded
size; each leaves at most a few sequences partly filled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut, with_fields
from meterwise.llm.tokens import encoder, groups

TOKENS = 2048
SEGMENTS = 256
LOSS_TOKENS = 2048
TASK_PIECES = 50_000  # pieces that one packing task gets, on average
END_ID = 1


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each example; every example must fit in an empty sequence.

    Demands are weighted by the inverse of the capacities. Ties go to the
    larger demand in tokens, then in loss tokens; equal examples are placed in
    the order given. The segment term is the same for all candidates. Among
    examples of the same tokens without loss, the dot product grows with their
    tokens, so only the longest one that fits of each such kind is weighed; it is found by
    bisection in the lengths still left.
    """
    cap_t, cap_s, cap_l = limits
    gap = tokens - loss
    order = np.lexsort((np.arange(len(tokens)), tokens, gap))
    kinds = []  # (tokens without loss, lengths left in ascending order, the examples of each length)
    for part in np.split(order, np.flatnonzero(np.diff(gap[order])) + 1) if len(order) else []:
        cuts = np.flatnonzero(np.diff(tokens[part])) + 1
        examples = [x.tolist()[::-1] for x in np.split(part, cuts)]
        kinds.append((int(gap[part[0]]), [int(tokens[x[0]]) for x in examples], examples))
    sequence, offset = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
    number, placed, at = 0, 0, 0
    room_t, room_s, room_l = limits
    weight_t, weight_l = cap_l * cap_l, cap_t * cap_t  # both inverse squares times (cap_t * cap_l) ** 2: whole numbers
    while placed < len(tokens):
        best = None
        for kind in kinds if room_s else ():
            i = bisect_right(kind[1], min(room_t, room_l + kind[0])) - 1
            if i >= 0:
                n = kind[1][i]
                m = n - kind[0]
                rank = (n * room_t * weight_t + m * room_l * weight_l, n, m)
                if best is None or rank > best[0]:
                    best = rank, kind, i
        if best is None:
            number, at = number + 1, 0
            room_t, room_s, room_l = limits
            continue
        (_, n, m), (_, lengths, examples), i = best
        example = examples[i].pop()
        if not examples[i]:
            del lengths[i], examples[i]
        sequence[example], offset[example] = number, at
        placed += 1
        at += n
        room_t, room_s, room_l = room_t - n, room_s - 1, room_l - m
    return sequence, offset


def document_pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): ids of each whole text and END_ID, cut every ``tokens`` ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            row, out = [], [[], [], [], []]
            texts = b.column(1)
            for lo, hi in groups([n or 0 for n in pc.binary_length(texts).to_pylist()]):
                for i, ids in enumerate(encode(texts[lo:hi].to_pylist()), lo):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, tokens):
                        part = ids[4 * start:4 * (start + tokens)]
                        row.append(i)
                        for column, value in zip(out, (start, len(part) // 4, zlib.crc32(part), n)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in out]],
                                             names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack_pieces(pieces: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS_TOKENS),
                length: str = "length", loss: str = "loss") -> DataFrame:
    """``pieces`` (a written table) with sequence_id (gapless from 0) and offset (gapless from 0 in its sequence).

    ``length`` is at least 1 and at most limits[0], ``loss`` at most limits[2];
    a piece beyond that raises an error.
    """
    tasks = max(1, -(-pieces.count() // TASK_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        batch = pa.Table.from_batches(rows)
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (length, loss))
        if n.min() < 1 or n.max() > limits[0] or m.min() < 0 or m.max() > limits[2]:
            raise ValueError("a piece does not fit in an empty sequence")
        sequence, offset = pack(n, m, limits)
        task = TaskContext.get().partitionId()
        for name, values in (("_task", np.full(len(n), task, np.int32)), ("_local", sequence), ("offset", offset)):
            batch = batch.append_column(name, pa.array(values))
        yield from batch.to_batches(max_chunksize=10_000)

    packed = cut(pieces.repartition(tasks).mapInArrow(run, with_fields(pieces.schema, "_task int, _local bigint, offset bigint")))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per packing task
    first = (packed.groupBy(F.col("_task").alias("_t")).agg((F.max("_local") + 1).alias("_n"))
             .withColumnRenamed("_t", "_task").withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .select(F.col("_task").alias("_t"), "_first"))
    return (packed.join(F.broadcast(first), packed["_task"] == first["_t"])
            .withColumn("sequence_id", F.col("_first") + F.col("_local")).drop("_task", "_t", "_local", "_first"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one END_ID. All of a document's ids bear loss but
    the very first, which nothing predicts. Repeated rows are packed each on
    its own; an empty table gives an empty result.
    """
    pieces = cut(document_pieces(docs, tokenizer, TOKENS, id_col, text_col).withColumn(
        "loss", F.col("length") - (F.col("start") == 0).cast("int")))
    return pack_pieces(pieces).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                                      "sequence_id", "offset")
