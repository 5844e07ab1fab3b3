"""Grouping spelling variants: words that differ by one inserted, deleted or replaced code point.

Two words differ by a single edit exactly if they are different and their
common prefix and common suffix together reach the longer length minus one.
Words are compared as dense tiles: padded code-point matrices, one aligned at
the words' starts and one at their ends, whose columns are compared for all
pairs of a block with a block at once.

Not every block meets every other. With a longer length L, one of the two
common ends has at least half of L - 1 code points, so only words that share
that many at the start, or that many at the end, are laid in common tiles
(once for L = their own length, once for L = their length plus one). Crowded
keys are split into blocks of ``TILE`` words, and every pair of blocks is a
task's row of its own; pairs that both ends would find count at the start only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import cut

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
HELD = 200_000  # counted words that a task holds before it passes them on
LONG = 1 << 20  # characters from which a text's runs are counted one by one, not from a list
TILE = 512      # words of a block


def runs(text: str):
    """The text's runs of letters, only A-Z lower-cased."""
    text = text.encode().lower().decode()  # bytes are lower-cased in ASCII only
    return RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text))


def word_counts(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_count: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of the whole texts, each occurrence damaged if ``one_in`` divides its hash.

    The hash is the crc32 of "id:word"; a damaged occurrence loses the code
    point at hash modulo length. Words shorter than ``least_length`` after that,
    or rarer than ``least_count`` overall, are left out. A null id has the
    empty text as its id's text; null and empty texts have no words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                seed = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for word, n in Counter(runs(text.as_py() or "")).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield passed()
        yield passed()

    return (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
            .mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns from the start, columns from the end, lengths); padding is 0 and never meets padding in a test."""
    lengths = np.array([len(w) for w in words], np.int64)
    from_start = np.zeros((width, len(words)), np.uint32)
    from_end = np.zeros((width, len(words)), np.uint32)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    from_start[at, row] = points
    from_end[lengths[row] - 1 - at, row] = points
    return from_start, from_end, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common run from the first column on, for all pairs."""
    same = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.zeros(same.shape, np.int64)
    for x, y in zip(a, b):
        same &= (x[:, None] == y[None, :]) & (x != 0)[:, None]
        if not same.any():
            break
        out += same
    return out


def near_in_tile(a: list[str], b: list[str], longer: int, shared: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the single edits between words of two blocks whose longer word has length ``longer``.

    Pairs with ``shared`` code points in common at the start belong to side
    "p"; those that have them at the end only belong to side "s".
    """
    (ap, as_, an), (bp, bs, bn) = matrices(a, longer), matrices(b, longer)
    prefix = _common(ap, bp)
    most = np.maximum(an[:, None], bn[None, :])
    found = (most == longer) & (prefix < most) & (prefix + _common(as_, bs) >= longer - 1)
    found &= (prefix >= shared) if side == "p" else (prefix < shared)
    return np.nonzero(found)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every single edit among ``words`` (a written table of word, n).

    Words are distinct and not empty.
    """
    own = F.char_length("word")
    key = ["side", "longer", "part"]
    keyed = (words.select("word", "n", F.explode(F.array(own, own + 1)).alias("longer"))
             .withColumn("shared", F.floor(F.col("longer") / 2).cast("int"))  # half of longer - 1, rounded up
             .select("*", F.explode(F.array(F.lit("p"), F.lit("s"))).alias("side"))
             .withColumn("part", F.expr("CASE WHEN side = 'p' THEN left(word, shared) ELSE right(word, shared) END")))
    blocks = (keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max(F.char_length("word")).alias("most"))
              .where((F.col("rows") > 1) & (F.col("most") == F.col("longer")))
              .select(*key, F.ceil(F.col("rows") / TILE).cast("int").alias("blocks")))
    # Every block of a key meets itself and every other block once, as tile (i, j) with i <= j.
    tiles = (keyed.join(blocks, key)
             .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .groupBy(*key, "shared", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
             .agg(F.collect_list(F.struct("block", "word", "n")).alias("rows"))
             .select("side", "longer", "shared", "i", "j", "rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, longer, shared, i, j, rows in zip(*[batch.column(c) for c in range(6)]):
                rows = rows.values
                block = rows.field("block").to_numpy()
                word, n = np.array(rows.field("word").to_pylist(), object), rows.field("n").to_numpy()
                a, b = np.flatnonzero(block == i.as_py()), np.flatnonzero(block == j.as_py())
                x, y = near_in_tile(list(word[a]), list(word[b]), longer.as_py(), shared.as_py(), side.as_py())
                x, y = a[x], b[y]
                if i.as_py() != j.as_py():  # a block with itself finds both directions already
                    x, y = np.concatenate([x, y]), np.concatenate([y, x])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(word[x], pa.string()), pa.array(word[y], pa.string()),
                                                      pa.array(n[y], pa.int64())], names=["word", "near", "near_n"])

    return tiles.mapInArrow(run, "word string, near string, near_n bigint")


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (a written table with word, form) with root: the last word on the way over forms.

    A form has at least twice its word's count, so ways end, and their length is
    bounded by the logarithm of the largest count; each round doubles the steps.
    """
    ways = cut(forms.where(F.col("form").isNotNull()).select(F.col("word").alias("w"), F.col("form").alias("last")))
    while True:
        step = ways.select(F.col("w").alias("last"), F.col("last").alias("next"))
        if not ways.join(step, "last", "left_semi").limit(1).count():
            break
        ways = cut(ways.join(step, "last", "left").select("w", F.coalesce("next", "last").alias("last")))
    return (forms.join(ways, F.col("word") == F.col("w"), "left")
            .withColumn("root", F.coalesce("last", "word")).drop("w", "last"))


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a table of distinct words and their counts.

    A word's form is its near word of the largest count (ties: the smallest in
    code-point order) if that count is at least ``ratio`` (2 or more) times its
    own; else null. An empty table gives an empty result.
    """
    words = cut(words.select("word", "n"))
    best = (near_words(words).groupBy(F.col("word").alias("w"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")))
    taken = -F.col("b.m") >= ratio * F.col("n")
    forms = cut(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("b.near")).alias("form"), F.when(taken, -F.col("b.m")).cast("long").alias("form_n")))
    return with_roots(forms)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per counted word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null id counts as the empty text;
    repeated rows count each time; texts of any length are read whole; an empty
    table, or one without a counted word, gives an empty result.
    """
    return group_variants(word_counts(docs, id_col=id_col, text_col=text_col)).select(
        "word", "form", "root", "n", "n_near", "form_n")
