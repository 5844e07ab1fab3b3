"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with runs of white space as one space. An item
of m characters may differ in k = floor(RATE x m) edits; cut into k + 1 pieces,
at least one piece must stand unchanged wherever the item occurs within that
budget. An Aho-Corasick automaton finds all exact pieces in every whole text,
and each place where a piece puts an item is verified by Myers' bit-parallel
edit distance.

The benchmark is the query set, compared with all rows in blocks: items are
taken in id order, ``BLOCK_CHARS`` characters at a time, so what is sent to the
executors is bounded for a benchmark of any size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.06
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) for budget + 1 pieces of nearly equal length that make up the item."""
    n = budget + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): least edit distance of the pattern to a substring of text, and where that first ends."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    rises, falls, score, best, end = full, 0, m, m, 0  # vertical differences of +1 and -1
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | falls
        across = (((equal & rises) + rises) ^ rises) | equal
        more = falls | (full & ~(across | rises))
        less = rises & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 & full, less << 1 & full  # row 0 stays 0: a match may start anywhere
        rises = less | (full & ~(vertical | more))
        falls = more & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items (id, normal text) in normal texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, distance, end) for each item within its budget: least distance, first end."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, found) in self.automaton.iter(text):
            for n, offset in found:
                starts[n].add(last + 1 - size - offset)
        for n in sorted(starts):
            item_id, item, budget = self.items[n]
            best = (budget + 1, 0)
            for low, high in self._windows(sorted(starts[n]), len(item), budget):
                window = text[max(0, low):high]
                at = window.find(item)
                distance, end = (0, at + len(item)) if at >= 0 else myers(item, window)
                best = min(best, (distance, max(0, low) + end))
                if not best[0]:
                    break
            if best[0] <= budget:
                yield item_id, *best

    @staticmethod
    def _windows(starts: list[int], size: int, budget: int) -> Iterator[tuple[int, int]]:
        low = high = None
        for s in starts:
            if high is not None and s - budget <= high:
                high = s + size + budget
                continue
            if high is not None:
                yield low, high
            low, high = s - budget, s + size + budget
        yield low, high


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in id order, about BLOCK_CHARS characters at a time; one with no text matches nothing."""
    block, chars = [], 0
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"\S"))
    for row in items.distinct().orderBy("i", "t").toLocalIterator():
        text = normal(row["t"])
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        if text:
            block.append((row["i"], text))
            chars += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, distance, end): one row for each row of ``docs`` and item found in it.

    distance is the least number of edits, end where that match first ends in
    the normalised text (code points). Items that are null or only white space
    match nothing, null and empty texts hold nothing. Equal items under two
    ids are both reported, repeated rows as often as they stand there. An empty
    ``docs`` or ``benchmark`` gives an empty result. An item has no least length:
    one of a single letter is found in every text that holds the letter. A very
    long text is searched whole, in time that grows with its length.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = f"id {kind}, item_id {item_kind}, distance int, end bigint"
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def search(known):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(known.value, rate)
            for b in batches:
                rows = [], [], [], []
                texts = b.column(1)
                for i in range(len(texts)):
                    for item, distance, end in matcher.matches(normal(texts[i].as_py())):
                        for column, value in zip(rows, (i, item, distance, end)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], items_type),
                     pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["id", "item_id", "distance", "end"])
        return run

    items_type = to_arrow_type(benchmark.schema[item_col].dataType)
    found = [work.mapInArrow(search(spark.sparkContext.broadcast(block)), out)
             for block in item_blocks(benchmark, item_col, item_text)]
    if not found:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    return reduce(DataFrame.union, found).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found, ids and texts as they are.

    Each block of items marks the rows in one pass; rows go on, unmarked ones
    only, to the next block.
    """
    mark = "_llm_leak"
    schema = docs.schema
    for block in item_blocks(benchmark, "item_id", "text"):
        known = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(known.value, rate)
            for b in batches:
                texts = b.column(b.num_columns - 1)
                clean = [next(matcher.matches(normal(texts[i].as_py())), None) is None for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(clean, pa.bool_()))

        docs = docs.withColumn(mark, F.col(text_col)).mapInArrow(run, schema)
    return docs
