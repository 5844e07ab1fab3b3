"""Token ids in adaptively coded, independently readable blocks.

A block holds up to ``BLOCK`` consecutive ids. Each id is coded as four
16-way decisions, from the highest four bits down. Three models predict every
decision: the bits so far alone (order 0), with the id before (order 1) and
with the two ids before (order 2). Each keeps symbol counts for its context;
the counts are mixed, those of higher orders weighing more, a context without
evidence weighing nothing, and the mixture drives a carry-less range coder. All
three models then adapt. Models start anew with every block, so a block can be
read alone, and its crc32 is checked on reading. Counts and sums are whole
numbers that single precision holds exactly, so any machine decodes what
another has encoded.

Many blocks are coded side by side: numpy steps through them in lockstep, one
lane per block, so the loop runs over positions and not over ids.

A file is a written table of blocks in ascending id order. Block header
(little-endian): magic, version, number of ids, number of documents, crc32 of
the ids, first id's place in the file; then for each document its row number
in the file, its ids in this block, its id and whether that is null; then the
code.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut
from meterwise.llm.tokens import encoder, groups

BLOCK = 8192         # ids in a block: long enough for orders 1 and 2 to learn
LANES = 384
NIBBLES = 4
ROWS = 13            # log2 of the contexts that a model's table holds
STEP = 6             # what a symbol's count grows by; a row that would pass 255 is halved
ORDER_WEIGHTS = (2, 3, 4)
TOP, BOTTOM = np.uint32(1 << 24), np.uint32(1 << 16)
END_ID = 2
MAGIC, VERSION = b"TIDB", 2
HEADER = struct.Struct("<4sHIIIQ")
DOC = struct.Struct("<QIq?")


# Counts of the three models, mixed and summed up: column i is the weight of the symbols below i.
_MIX = np.array([[w * (symbol < i) for i in range(17)] for w in ORDER_WEIGHTS for symbol in range(16)], np.float32)
_ONE_EACH = np.arange(17, dtype=np.float32)


class _Models:
    """Symbol counts of all lanes: a row of 16 for each lane, order and hashed context."""

    def __init__(self, lanes: int) -> None:
        self.rows = np.zeros((3 * lanes << ROWS, 16), np.uint8)
        self.cells = self.rows.reshape(-1)
        self.base = (np.arange(3 * lanes, dtype=np.int64) << ROWS).reshape(lanes, 3)
        self.context = np.zeros((lanes, 3), np.uint32)

    def begin(self, before: np.ndarray, earlier: np.ndarray) -> None:
        """Contexts of the next id; only as many lanes as there are ids before are still in use."""
        n = self.n = len(before)
        one = before.astype(np.uint32) + np.uint32(1)
        self.context[:n, 1] = one * np.uint32(0x85EBCA6B)
        self.context[:n, 2] = one * np.uint32(0xC2B2AE35) + (earlier.astype(np.uint32) + np.uint32(7)) * np.uint32(0x27D4EB2F)

    def sums(self, node: np.ndarray) -> np.ndarray:
        """(lanes, 17): mixed weight of all symbols below each; every symbol weighs at least one."""
        n = self.n
        key = (self.context[:n] + node[:, None]) * np.uint32(0x9E3779B1)
        self.at = self.base[:n] + (key >> np.uint32(32 - ROWS))
        seen = self.rows.take(self.at.reshape(-1), axis=0).reshape(n, 48)
        return (seen.astype(np.float32) @ _MIX + _ONE_EACH).astype(np.uint32)

    def learn(self, symbol: np.ndarray) -> None:
        cell = ((self.at << 4) + symbol[:, None]).reshape(-1)
        more = self.cells.take(cell).astype(np.int16) + STEP
        full = np.flatnonzero(more > 255)
        self.cells[cell] = np.minimum(more, 255)
        if len(full):
            rows = self.at.reshape(-1)[full]
            self.rows[rows] = self.rows[rows] >> 1


def _stretch(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lanes whose first byte is settled; a range too small to go on is cut so that it is."""
    settled = (low ^ (low + size)) < TOP
    small = ~settled & (size < BOTTOM)
    if small.any():
        np.copyto(size, (np.uint32(0) - low) & (BOTTOM - np.uint32(1)), where=small)
        settled |= small
    return np.flatnonzero(settled)


def _alive(sizes: np.ndarray, t: int) -> int:
    return int(np.searchsorted(-sizes, -t, side="left"))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids below 2**16; blocks sorted by falling length, none empty."""
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    ids = np.zeros((sizes[0], lanes), np.int64)
    for i, b in enumerate(blocks):
        ids[:len(b), i] = b
    if ids.max() >= 1 << 4 * NIBBLES:
        raise ValueError("ids must be below 65536")
    models, low, size = _Models(lanes), np.zeros(lanes, np.uint32), np.full(lanes, 0xFFFFFFFF, np.uint32)
    out, used, none = np.zeros((lanes, 64), np.uint8), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    lane = np.arange(lanes)
    for t in range(sizes[0]):
        n = _alive(sizes, t)
        models.begin(ids[t - 1, :n] if t else none[:n], ids[t - 2, :n] if t > 1 else none[:n])
        node, a, r = np.ones(n, np.uint32), low[:n], size[:n]
        if int(used.max()) + 8 * NIBBLES > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], axis=1)
        for shift in range(4 * NIBBLES - 4, -1, -4):
            symbol = ids[t, :n] >> shift & 15
            sums = models.sums(node)
            models.learn(symbol)
            below = sums[lane[:n], symbol]
            unit = r // sums[:, 16]
            a += below * unit
            r[:] = (sums[lane[:n], symbol + 1] - below) * unit
            node = node << np.uint32(4) | symbol.astype(np.uint32)
            ready = _stretch(a, r)
            while len(ready):
                out[ready, used[ready]] = a[ready] >> np.uint32(24)
                used[ready] += 1
                a[ready] <<= np.uint32(8)
                r[ready] <<= np.uint32(8)
                ready = _stretch(a, r)
    return [out[i, :used[i]].tobytes() + int(low[i]).to_bytes(4, "big") for i in range(lanes)]


def decode_blocks(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each code; sizes (ids in each) fall from block to block."""
    lanes, lengths = len(codes), np.array(sizes)
    code = np.zeros((lanes, max(map(len, codes)) + 8), np.uint8)
    for i, c in enumerate(codes):
        code[i, :len(c)] = np.frombuffer(c, np.uint8)
    ids = np.zeros((lengths[0], lanes), np.int64)
    models, low, size = _Models(lanes), np.zeros(lanes, np.uint32), np.full(lanes, 0xFFFFFFFF, np.uint32)
    value = code[:, :4].astype(">u1").copy().view(">u4").reshape(-1).astype(np.uint32)
    used, last, none = np.full(lanes, 4, np.int64), code.shape[1] - 1, np.zeros(lanes, np.int64)
    lane = np.arange(lanes)
    for t in range(lengths[0]):
        n = _alive(lengths, t)
        models.begin(ids[t - 1, :n] if t else none[:n], ids[t - 2, :n] if t > 1 else none[:n])
        node, a, r, x = np.ones(n, np.uint32), low[:n], size[:n], value[:n]
        for _ in range(NIBBLES):
            sums = models.sums(node)
            unit = r // sums[:, 16]
            symbol = (sums[:, 1:16] <= ((x - a) // unit)[:, None]).sum(axis=1)
            models.learn(symbol)
            below = sums[lane[:n], symbol]
            a += below * unit
            r[:] = (sums[lane[:n], symbol + 1] - below) * unit
            node = node << np.uint32(4) | symbol.astype(np.uint32)
            ready = _stretch(a, r)
            while len(ready):
                a[ready] <<= np.uint32(8)
                r[ready] <<= np.uint32(8)
                x[ready] = x[ready] << np.uint32(8) | code[ready, np.minimum(used[ready], last)]
                used[ready] += 1
                ready = _stretch(a, r)
        ids[t, :n] = node & np.uint32(0xFFFF)
    return [ids[:s, i].astype("<u4") for i, s in enumerate(sizes)]


Documents = list[tuple[int, int, int, bool]]  # row in the file, ids in the block, id, whether it is null


def write_blocks(blocks: list[tuple[int, Documents, np.ndarray]]) -> list[bytes]:
    """Whole blocks, header included, in the order given: (first id's place, documents, ids)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i][2]))
    out: list[bytes] = [b""] * len(blocks)
    for i, code in zip(order, encode_blocks([blocks[i][2] for i in order])):
        first, documents, ids = blocks[i]
        head = HEADER.pack(MAGIC, VERSION, len(ids), len(documents), zlib.crc32(ids.astype("<u4").tobytes()), first)
        out[i] = head + b"".join(DOC.pack(*d) for d in documents) + code
    return out


def read_blocks(raw: list[bytes]) -> list[tuple[int, Documents, np.ndarray]]:
    """The reverse of write_blocks; a block that is damaged raises an error."""
    heads = []
    for block in raw:
        magic, version, n, documents, crc, first = HEADER.unpack_from(block)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of token ids")
        at = HEADER.size + documents * DOC.size
        heads.append((n, crc, first, list(DOC.iter_unpack(block[HEADER.size:at])), block[at:]))
    order = sorted(range(len(raw)), key=lambda i: -heads[i][0])
    out: list = [None] * len(raw)
    for i, ids in zip(order, decode_blocks([heads[i][4] for i in order], [heads[i][0] for i in order])):
        n, crc, first, documents, _ = heads[i]
        if zlib.crc32(ids.tobytes()) != crc or sum(d[1] for d in documents) != n:
            raise ValueError("a block of token ids is damaged")
        out[i] = first, documents, ids
    return out


class _Writer:
    """Cuts a file's documents into blocks and codes LANES of them at a time."""

    def __init__(self) -> None:
        self.done, self.row, self.place = [], 0, 0
        self.documents: Documents = []
        self.parts, self.filled = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(BLOCK - self.filled, len(ids) - at)
            self.documents.append((self.row, take, doc_id or 0, doc_id is None))
            self.parts.append(ids[at:at + take])
            self.filled += take
            at += take
            if self.filled == BLOCK:
                self.close()
        self.row += 1

    def close(self) -> None:
        if self.filled:
            self.done.append((self.place, self.documents, np.concatenate(self.parts)))
            self.place += self.filled
        self.documents, self.parts, self.filled = [], [], 0

    def flush(self, least: int) -> list[bytes]:
        out = []
        while len(self.done) >= least and self.done:
            out += write_blocks(self.done[:LANES])
            self.done = self.done[LANES:]
        return out


def write_token_file(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, block): the written file, parts in ascending id order, blocks in order within a part.

    Ids are coded in 16 bits: a vocabulary with ids of 65,536 or more raises.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, part = encoder(tokenizer).encode, _Writer(), TaskContext.get().partitionId()

        def out(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())],
                                                 names=["part", "block"])
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in groups([n or 0 for n in pc.binary_length(texts).to_pylist()]):
                for key, ids in zip(keys[lo:hi], encode(texts[lo:hi].to_pylist())):
                    writer.add(key, np.frombuffer(ids + end, "<u4"))
                yield from out(writer.flush(LANES))
        writer.close()
        yield from out(writer.flush(1))

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).orderBy("id")
    return cut(ordered.mapInArrow(run, "part int, block binary"))


def read_token_file(file: DataFrame) -> DataFrame:
    """(part, row, id, place, n, crc) of each document, from the decoded blocks; one row for each run of blocks read together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, bytes]] = []

        def out(some: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            rows = []
            for (part, _), (first, documents, ids) in zip(some, read_blocks([raw for _, raw in some])):
                at = 0
                for row, n, key, null in documents:
                    raw, place = ids[at:at + n].tobytes(), first + at
                    if rows and rows[-1][:2] == [part, row] and rows[-1][3] + rows[-1][4] == place:
                        rows[-1][4:] = rows[-1][4] + n, zlib.crc32(raw, rows[-1][5])  # goes on from the block before
                    else:
                        rows.append([part, row, None if null else key, place, n, zlib.crc32(raw)])
                    at += n
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["part", "row", "id", "place", "n", "crc"])
        for b in batches:
            kept += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            while len(kept) >= LANES:
                yield from out(kept[:LANES])
                kept = kept[LANES:]
        if kept:
            yield from out(kept)

    return file.mapInArrow(run, "part int, row bigint, id bigint, place bigint, n bigint, crc bigint")


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings on end, from their crc32s and the second's length.

    Appending zero bytes multiplies the first's remainder by a power of x; the
    factor is built by squaring in the field of the polynomial.
    """
    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):  # bit 31 is the coefficient of x**0
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    factor, square, n = 1 << 31, 1 << 30, length * 8
    while n:
        if n & 1:
            factor = times(factor, square)
        square = times(square, square)
        n >>= 1
    return times(first, factor) ^ second


def _joined(crcs, sizes) -> int:
    total = 0
    for crc, n in zip(crcs, sizes):
        total = crc32_join(total, crc, 4 * n)
    return total


def document_digests(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from read_token_file's rows."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "row": pdf["row"].iloc[:1], "id": pdf["id"].iloc[:1].astype("Int64"),
                             "place": pdf["place"].iloc[:1], "n": [int(pdf["n"].sum())],
                             "crc": [_joined(pdf["crc"].tolist(), pdf["n"].tolist())]})

    parts = cut(parts)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = (parts.groupBy("part").agg(F.sum("n").alias("total"))
              .withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0))).select(F.col("part").alias("p"), "first"))
    spread = parts.groupBy("part", "row").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"), F.min("place").alias("place"),
                                              F.sum("n").alias("n"), F.min("crc").alias("crc"))
    single = spread.where("k = 1").drop("k")
    several = (parts.join(spread.where("k > 1").select("part", "row"), ["part", "row"], "left_semi")
               .groupBy("part", "row").applyInPandas(join, parts.schema))
    return (single.unionByName(several).join(F.broadcast(starts), F.col("part") == F.col("p"))
            .select(F.col("id").alias(id_col), (F.col("first") + F.col("place")).alias("start"),
                    F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")))


def token_file_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to a token file, reads it back and digests what it holds.

    Documents stand in ascending id order, null ids first, rows of equal id in
    any order; null and empty texts are END_ID alone. An empty table gives an
    empty result. A very long text spans blocks, and its checksum is joined from
    theirs. Ids of 65,536 and more raise (see :func:`write_token_file`).
    """
    return document_digests(read_token_file(write_token_file(docs, tokenizer, id_col, text_col)), id_col)
