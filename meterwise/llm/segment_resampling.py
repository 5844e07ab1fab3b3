"""Drawing documents that look like a target, with features counted once per distinct line.

Features are runs of one to ``SPAN`` consecutive words; each falls in one of
``BUCKETS`` buckets by its crc32. A document's weight is the sum of its features' gains:
how much more frequent their buckets are in the target than in the corpus. A
score adds Gumbel noise from the document's id, so that the highest scores are a
draw without replacement in proportion to exp(weight / 1000).

Line ends separate words, so they cut a text into lines whose inner features do
not depend on the text around them. Equal lines (as words) meet in one shuffle
with their number of occurrences; the features of each different line are
counted once and multiplied. Features that run across a line end are counted
apart, from the words around it. Checksums of longer runs come from those of
their words: appending bytes is linear over bits, so one table look-up per
byte of the checksum appends a whole word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut

BUCKETS = 10_000
SPAN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
KNOWN = 500_000   # different words that a worker remembers
GROUP = 4 << 20   # bytes of text taken at once
TABLED = 64       # shifts by fewer bytes have a table of their own

# Digits, lower-case letters and all bytes beyond ASCII stay; capitals become lower-case, others a space.
_WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))
_LINE_BYTES = bytes(0x0A if b == 0x0A else _WORD_BYTES[b] for b in range(256))


def _byte_tables(bits: np.ndarray) -> np.ndarray:
    """(4, 256) look-ups of a linear map that is given by the images of the 32 bits."""
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            has = (np.arange(256) >> bit & 1).astype(bool)
            out[place, has] ^= bits[8 * place + bit]
    return out


def _look_up(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Look-ups that append n zero bytes to a checksum: for each n below TABLED, and for each power of two."""
    one = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)], np.uint32)
    first = _byte_tables(one)
    small, bits = [], np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(TABLED):
        small.append(_byte_tables(bits))
        bits = _look_up(first, bits)
    powers, bits = [], one
    for _ in range(31):
        powers.append(_byte_tables(bits))
        bits = _look_up(powers[-1], bits)
    return np.stack(small), powers


_SMALL, _POWERS = _shift_tables()


def append(before: np.ndarray, checksum: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of A + B from those of A and of B and the number of bytes of B."""
    short = np.minimum(size, TABLED - 1)
    out = (_SMALL[short, 0, before & 255] ^ _SMALL[short, 1, before >> 8 & 255]
           ^ _SMALL[short, 2, before >> 16 & 255] ^ _SMALL[short, 3, before >> 24])
    long = np.flatnonzero(size >= TABLED)
    if len(long):
        rest, c = size[long], before[long]
        for k, tables in enumerate(_POWERS):
            has = (rest >> k & 1).astype(bool)
            c[has] = _look_up(tables, c[has])
        out[long] = c
    return out ^ checksum


class Words:
    """Checksums and sizes of words, remembered for up to KNOWN different ones."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 3), np.uint32)  # crc32 of the word, crc32 of a space and the word, size with it

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known, self.table = {}, self.table[:0]
        new = [w for w in set(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            more = [(zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1) for w in new]
            self.table = np.concatenate([self.table, np.array(more, np.uint32).reshape(-1, 3)])
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def features(rows: np.ndarray, place: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, last word, bucket) of all features, by length.

    ``rows`` are those of Words for some words, ``place`` their places in the
    texts and ``owner`` what a feature must not leave; words whose places do
    not follow each other have something between them.
    """
    checksum = rows[:, 0]
    for length in range(1, SPAN + 1):
        if len(rows) < length:
            return
        if length > 1:
            checksum = append(checksum[:-1], rows[length - 1:, 1], rows[length - 1:, 2].astype(np.int64))
        first = np.arange(len(checksum))
        last = first + length - 1
        whole = (owner[first] == owner[last]) & (place[last] - place[first] == length - 1)
        yield first[whole], last[whole], (checksum[whole] % BUCKETS).astype(np.int64)


class Segments:
    """The lines of some texts: each different one once, and the words around line ends."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lines: dict[bytes, int] = {}           # words joined by spaces -> number
        which, text, sizes, words = [], [], [], []
        for i, t in enumerate(texts):
            for part in t.translate(_LINE_BYTES).split(b"\n"):
                own = part.split()
                if own:
                    which.append(self.lines.setdefault(b" ".join(own), len(self.lines)))
                    text.append(i)
                    sizes.append(len(own))
                    words += own
        self.which, self.text = np.array(which, np.int64), np.array(text, np.int64)
        self.sizes = np.array(sizes, np.int64)
        # Words within SPAN - 1 of a line end that has a line of the same text on its other side.
        follows = np.zeros(len(which), bool)
        follows[1:] = self.text[1:] == self.text[:-1]
        goes_on = np.append(follows[1:], False)
        line = np.repeat(np.arange(len(which)), self.sizes)
        after = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        before = self.sizes[line] - 1 - after
        self.place = np.flatnonzero((follows[line] & (after < SPAN - 1)) | (goes_on[line] & (before < SPAN - 1)))
        self.near_ends = [words[i] for i in self.place]
        self.line = line[self.place]

    def occurrences(self) -> np.ndarray:
        return np.bincount(self.which, minlength=len(self.lines))

    def crossing(self, known: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of the features that run across a line end."""
        found = [(self.text[self.line[first]], bucket, self.line[first] != self.line[last])
                 for first, last, bucket in features(known.rows(self.near_ends), self.place, self.text[self.line])]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, bucket, over = (np.concatenate(x) for x in zip(*found))
        return text[over], bucket[over]


def inner(lines: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of the features inside lines, each of which is its words joined by spaces."""
    words = [line.split(b" ") for line in lines]
    owner = np.repeat(np.arange(len(lines)), np.fromiter(map(len, words), np.int64, len(words)))
    rows = known.rows([w for own in words for w in own])
    found = [(owner[first], bucket) for first, _, bucket in features(rows, np.arange(len(rows)), owner)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owners, buckets = (np.concatenate(x) for x in zip(*found))
    return owners, buckets


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first place, texts) of runs of binary texts of about GROUP bytes, one text at least; null is empty."""
    part, size, first = [], 0, 0
    for i, value in enumerate(column):
        part.append(value.as_py() or b"")
        size += len(part[-1])
        if size > GROUP:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def _counted(lines: list, buckets: list, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(buckets, pa.int32()), pa.array(n, pa.int64())],
                                      names=["line", "bucket", "n"])


def _by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different lines with their occurrences, and counts of the features across line ends by bucket."""
    known, across = Words(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, texts in _groups(b.column(0)):
            s = Segments(texts)
            across += np.bincount(s.crossing(known)[1], minlength=BUCKETS)
            yield _counted(list(s.lines), [None] * len(s.lines), s.occurrences())
    at = np.flatnonzero(across)
    yield _counted([None] * len(at), at.tolist(), across[at])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each line, times its occurrences, and those across line ends."""
    known, counts = Words(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        n, at = b.column(2).to_numpy(), 0
        over = b.column(1).is_valid().to_numpy(zero_copy_only=False)
        np.add.at(counts, b.column(1).drop_null().to_numpy(), n[over])
        n = n[~over]
        for _, lines in _groups(b.column(0).drop_null()):
            line, bucket = inner(lines, known)
            np.add.at(counts, bucket, n[at + line])
            at += len(lines)
    at = np.flatnonzero(counts)
    yield _counted([None] * len(at), at.tolist(), counts[at]).select(["bucket", "n"])


def _binary(text_col: str) -> Column:
    return F.encode(F.col(text_col), "UTF-8").alias("t")


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket. At most BUCKETS rows reach the driver."""
    lines = (texts.select(_binary(text_col)).mapInArrow(_by_line, "line binary, bucket int, n bigint")
             .groupBy("line", "bucket").agg(F.sum("n").alias("n")))
    counts = np.zeros(BUCKETS, np.int64)
    for row in lines.mapInArrow(_by_bucket, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed share in the target over that in the corpus, rounded down."""
    all_s, all_t = float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (all_s + BUCKETS) / ((corpus + 1.0) * (all_t + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the sum of the gains of each text's features."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = Words(), gains.astype(float)  # sums of whole numbers, exact below 2 ** 53
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for first, texts in _groups(b.column(1)):
                s, part = Segments(texts), out[:, first:first + len(texts)]
                line, bucket = inner(list(s.lines), known)
                weights = np.bincount(line, weights=value[bucket], minlength=len(s.lines))
                text, over = s.crossing(known)
                words = np.bincount(s.text, weights=s.sizes, minlength=len(texts)).astype(np.int64)
                part[0] = words
                part[1] = sum(np.maximum(words - k, 0) for k in range(SPAN))
                part[2] = (np.bincount(s.text, weights=weights[s.which], minlength=len(texts))
                           + np.bincount(text, weights=value[over], minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)],
                                             names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), _binary(text_col)).mapInArrow(
        run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise), from the first 32 bits of sha256("seed:id"); a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def with_rank(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (a written table of id, n_words, score) with rank from 1 for the drawn, null for the rest.

    Rows are dealt by ranges of their order and sorted there; a row's rank is
    its place in its range plus the sizes of the ranges before.
    """
    drawn = scored.where(F.col("n_words") >= LEAST_WORDS).count() * percent // 100
    order = [(F.col("n_words") >= LEAST_WORDS).desc(), F.col("score").desc(), F.col("id").asc()]
    placed = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_at", F.monotonically_increasing_id()))  # range number and, in 33 bits, place
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = (placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
              .select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (placed.join(F.broadcast(starts), part == F.col("_part"))
            .withColumn("rank", F.when(rank <= drawn, rank).cast("long")).drop("_at", "_part", "_start"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_features, weight, score, rank (null if not drawn).

    Of the N documents of at least LEAST_WORDS words, the floor(N * percent / 100)
    of the highest scores are drawn; ties go to the smaller id (null first), rows
    with equal ids and scores come in any order. Null and empty texts have no features and weight 0;
    repeated rows are documents of their own; an empty target makes all gains
    follow the corpus alone; empty docs give an empty result. Texts of any
    length are read whole.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = cut(weigh(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    return with_rank(scored, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
