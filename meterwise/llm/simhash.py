"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from whole texts. Distinct fingerprints meet in buckets: the
64 bits form four 16-bit quarters, and two fingerprints at most two bits apart
agree on at least two of them, so six tables of 32-bit keys lose no pair.
Buckets are packed into blocks whose bits are stored vertically, one plane for
each bit position; carry-save counters add up the differing planes of many
pairs at once, and a block is abandoned as soon as all its pairs exceed the
radius. A bucket larger than a block is split into chunks, and each pair of
chunks is a task of its own. Tasks emit a spanning forest of their links, not
the links, and components of the forests are found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import cut
from meterwise.llm.graph import Forest, components

BLOCK = 4096        # fingerprints that a chunk of a large bucket holds, on average
SMALL = 512         # rows up to which small buckets share a block
QUERIES = 256       # fingerprints compared with a block at once
CHECK_PLANES = 8    # planes between two looks whether a block can be abandoned
PART_HASHES = 1 << 18
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, words_per_shingle: int) -> int:
    """64-bit SimHash of a whole UTF-8 text; 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = words_per_shingle
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else iter([words])
    n = max(1, len(words) - k + 1)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART_HASHES):
        part = np.fromiter(hashes, np.uint64, min(PART_HASHES, n - at))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):  # short sums fit in a byte
            ones += bits[lo:lo + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp bigint): one row per row; null text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = np.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return (docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("t"))
            .mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """(len(queries), n) booleans: Hamming distance to each of a block's n fingerprints <= radius.

    Counter planes hold each pair's count in binary; a plane of differences is
    added by rippling its carry. ``over`` keeps the pairs beyond the radius,
    those whose count overflowed included.
    """
    width = radius.bit_length()
    counters = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(width)]
    over = np.zeros((len(queries), planes.shape[1]), np.uint64)
    if n % 64:
        over[:, -1] = FULL << np.uint64(n % 64)
    flip = (np.uint64(0) - ((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)))
    for p in range(64):
        carry = planes[p][None, :] ^ flip[:, p:p + 1]
        for i in range(width):
            carry, counters[i] = counters[i] & carry, counters[i] ^ carry
        over |= carry
        if p % CHECK_PLANES == CHECK_PLANES - 1:
            over |= _greater(counters, radius)
            if (over == FULL).all():
                return np.zeros((len(queries), n), bool)
    over |= _greater(counters, radius)
    hit = ~over
    return np.unpackbits(hit.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _greater(counters: list[np.ndarray], radius: int) -> np.ndarray | np.uint64:
    """Bit-sliced comparison: pairs whose counter exceeds the radius."""
    more, equal = np.uint64(0), FULL
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            more, equal = more | (equal & counters[i]), equal & ~counters[i]
    return more


def block_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that span the links within ``left``, or between ``left`` and ``right``.

    Equal fingerprints link as well, so a row that stands in both is no harm.
    """
    nodes = left if right is None else np.concatenate([left, right])
    base = 0 if right is None else len(left)
    other = left if right is None else right
    planes, forest = planes_of(other), Forest(len(nodes))
    for at in range(0, len(left), QUERIES):
        hits = within(left[at:at + QUERIES], planes, len(other), radius)
        for q in np.flatnonzero(hits.sum(axis=1) > (right is None)):
            forest.link(at + q, base + np.flatnonzero(hits[q]))
    return [(int(nodes[i]), int(nodes[j])) for i, j in forest.edges]


def bucket_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges spanning all links between distinct fingerprints ``fp``."""
    if radius != 2:
        raise ValueError("the six quarter-pair tables are exact for a radius of 2")
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.lit(n) * F.lit(1 << 32) + quarter[i] * F.lit(1 << 16) + quarter[j]
            for n, (i, j) in enumerate(combinations(range(4), 2))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(sizes, F.col("key") == F.col("k")).select(
        "key", "fp", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (met.withColumn("c", chunk).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("key", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _linked(batches, radius)

    return (dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "c")
            .mapInArrow(run, "a bigint, b bigint"))


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Blocks from rows that are sorted by task: small tasks share a block, as whole tasks."""
    kept: np.ndarray | None = None

    def out(edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if edges:
            ab = np.array(edges, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        ends = np.r_[first[1:], len(rows)]
        fp = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        begin = None
        for s, e in zip(first, ends):
            if rows[s, 1] != rows[s, 2]:
                m = s + int((rows[s:e, 3] == rows[s, 1]).sum())
                yield from out(block_forest(fp[s:m], fp[m:e], radius))
                continue
            if begin is not None and (e - begin > SMALL or s != stop):
                yield from out(block_forest(np.unique(fp[begin:stop]), None, radius))
                begin = None
            begin, stop = (s if begin is None else begin), e
        if begin is not None:
            yield from out(block_forest(np.unique(fp[begin:stop]), None, radius))

    for b in batches:
        rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
        rows = rows if kept is None else np.concatenate([kept, rows])
        same = (rows[:, :3] == rows[-1, :3]).all(axis=1) if len(rows) else np.zeros(0, bool)
        whole = len(rows) - int(same.sum())  # the last task may go on in the next batch
        yield from work(rows[:whole])
        kept = rows[whole:]
    if kept is not None:
        yield from work(kept)


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row.

    ``shingle`` words make a shingle (a shorter text is one shingle; a text
    without words, or null, has fingerprint zero and links like any other).
    Links join fingerprints at ``radius`` or fewer differing bits, and
    component_id is the smallest id reachable, itself included. Rows of equal
    id are rows; a null id is never smallest unless a component has no other.
    An empty table gives an empty result. The key tables are made for a
    ``radius`` of 2; any other raises.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    found = components(bucket_links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, for each component.

    It is a row of the smallest id (a null id comes last); of several rows of
    that id the one whose text has the smaller hash stays, and of rows equal in
    id and text any one. So repeated rows are copies like any other.
    """
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    found = simhash_dedup(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), shingle, radius, "_key", "_text")
    stay = found.where(F.col("component_id").eqNullSafe(F.col("_key"))).select(F.col("_key").alias("_stay")).distinct()
    kept = docs.withColumn("_key", key).join(stay, F.col("_key").eqNullSafe(F.col("_stay")), "left_semi")
    return kept.dropDuplicates(["_key"]).drop("_key")
