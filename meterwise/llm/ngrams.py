"""Hashed counts of byte trigrams of whole texts, and TF-IDF rows from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

DIMS = 4096
REPEATED = 0       # the term that stands for words equal to the word before
CHUNK = 1 << 20    # bytes hashed at once; chunks overlap, so no trigram is lost
ROWS = 256         # texts in one dense block


# ASCII letters and all bytes beyond ASCII stay, others become a space.
_LETTERS = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def trigram_counts(text: bytes, repeats: bool = False, letters_only: bool = False) -> np.ndarray:
    """Counts over DIMS hashed trigrams of the text with a space on both sides.

    ``repeats`` adds the bytes of words equal to the one before as counts of
    the term REPEATED; ``letters_only`` first makes each run of other ASCII
    characters one space.
    """
    counts = np.zeros(DIMS)
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    if letters_only:
        raw = _LETTERS[raw]
        raw = raw[np.r_[True, (raw[1:] != 0x20) | (raw[:-1] != 0x20)]]
    for at in range(0, len(raw) - 2, CHUNK):
        a = raw[at:at + CHUNK + 2].astype(np.uint32)
        h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(20), minlength=DIMS)
    if repeats:
        words = text.split()
        counts[REPEATED] += sum(len(x) for x, y in zip(words, words[1:]) if x == y)
    return counts


def blocks(texts: pa.Array, **how: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, counts) for runs of at most ROWS binary texts; null counts as empty."""
    for at in range(0, len(texts), ROWS):
        end = min(at + ROWS, len(texts))
        yield at, end, np.stack([trigram_counts(texts[i].as_py(), **how) if texts[i].is_valid
                                 and len(texts[i].as_py()) else np.zeros(DIMS) for i in range(at, end)])


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of square-root counts times idf, at length one; a zero row stays zero."""
    rows = np.sqrt(counts) * idf
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes(), counts[at].astype("<f4").tobytes()


def unpack_counts(at: list[bytes], values: list[bytes]) -> np.ndarray:
    out = np.zeros((len(at), DIMS), np.float32)
    for i, (a, v) in enumerate(zip(at, values)):
        out[i, np.frombuffer(a, "<u2")] = np.frombuffer(v, "<f4")
    return out


def counts_of(columns: int, **how: bool):
    """mapInArrow function: the first ``columns`` columns, then the binary text's counts (at, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack_counts(row) for _, _, block in blocks(b.column(columns), **how) for row in block]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:columns], pa.array([p[0] for p in packed], pa.binary()),
                 pa.array([p[1] for p in packed], pa.binary())], names=[*b.schema.names[:columns], "at", "n"])
    return run
