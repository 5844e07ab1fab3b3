"""Token counts of whole texts; huge texts are encoded in overlapping chunks.

A text longer than ``CHUNK`` characters is never encoded at once. Neighbouring
chunks overlap and are encoded with offsets. They are spliced at a boundary
that both encodings have and that no context can move: a space after a letter
or digit. That such a boundary is stable is proven from the vocabulary when
the tokenizer is loaded (no piece runs from a letter, digit or sign into a
space, so neither a split rule nor a merge crosses it); what lies before it
has the same ids whatever follows, and the other way round. The encodings must
also agree on all ids between the first and the last such boundary of the
overlap. Where there is no such boundary, or the encodings differ, the overlap
doubles, first to the left, then by a longer left chunk. Chunks are encoded
one after another, so memory is bounded by a chunk and not by the text, unless
a text has no stable boundary at all.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.tokens import encoder, groups

CHUNK = 1 << 15   # characters encoded at once
OVERLAP = 256     # characters that neighbouring chunks share at first
STABLE = re.compile(r"(?<=\w) ")
SPACE_MARKS = ("Ġ", "▁")  # a space inside a byte-level piece and inside a sentencepiece piece (fixed values)
_counters: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """count(texts): the number of ids of each text, without begin, end or added special tokens.

    ``path`` ends in .json (tokenizers) or .model (sentencepiece). Special
    strings inside a text are what the library makes of them by default.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.chunk, self.overlap = chunk, overlap
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.offsets, self.short = self._proto, self._pieces
            pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        else:
            from tokenizers import Tokenizer, pre_tokenizers
            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.offsets, self.short = self._encoding, self._batch
            if isinstance(self.model.pre_tokenizer, pre_tokenizers.ByteLevel) and self.model.normalizer is None:
                cached = encoder(path)  # the same ids, from a cache of encoded words
                self.short = lambda texts: [len(ids) // 4 for ids in cached.encode(texts)]
            pieces = self.model.get_vocab()
        crossing = [p for p in pieces if self._crosses(p)]
        if crossing:
            raise ValueError(f"no boundary is stable: the vocabulary has pieces such as {crossing[:3]}")

    @staticmethod
    def _crosses(piece: str) -> bool:
        """True if the piece runs from something other than white space into a space."""
        for mark in SPACE_MARKS:
            at = piece.find(mark, 1)
            while at > 0:
                before = piece[:at].replace(mark, " ")
                if mark == SPACE_MARKS[0]:
                    from tokenizers import decoders
                    before = decoders.ByteLevel().decode([piece[:at]])
                if not before[-1:].isspace():
                    return True
                at = piece.find(mark, at + 1)
        return False

    def count(self, texts: list[str | None]) -> list[int]:
        texts = [t or "" for t in texts]
        small = [t for t in texts if len(t) <= self.chunk]
        counts = iter(self.short(small))
        return [next(counts) if len(t) <= self.chunk else self.count_chunks(t) for t in texts]

    def count_chunks(self, text: str) -> int:
        """The number of ids of a text of any length, from overlapping chunks."""
        total, done = 0, 0                        # ids counted, and up to which character
        begin, end = 0, min(self.chunk, len(text))
        left = self._at(text, begin, end)
        overlap = self.overlap
        while end < len(text):
            if end - overlap <= done:             # the whole left chunk has no usable boundary: lengthen it
                end = min(len(text), end + max(self.chunk, end - begin))
                left, overlap = self._at(text, begin, end), self.overlap
                continue
            start = end - overlap
            cuts = [m.start() for m in STABLE.finditer(text, start + 1, end)]
            right, stop = None, min(len(text), start + max(self.chunk, 2 * overlap))
            if cuts:
                right = self._at(text, start, stop)
            if right is None or not self._agree(left, right, cuts[0], cuts[-1]):
                overlap *= 2
                continue
            cut = cuts[-1]
            total += int(((left[1] >= done) & (left[1] < cut)).sum())
            done, begin, end, left, overlap = cut, start, stop, right, self.overlap
        return total + int((left[1] >= done).sum())

    @staticmethod
    def _agree(left, right, first: int, last: int) -> bool:
        """Both encodings have boundaries at ``first`` and ``last`` and the same ids at the same places between."""
        between = []
        for ids, starts, ends in (left, right):
            if any(((starts < cut) & (ends > cut)).any() for cut in (first, last)):
                return False
            inside = (starts >= first) & (starts < last)
            between.append((ids[inside], starts[inside]))
        return all(np.array_equal(a, b) for a, b in zip(*between))

    def _at(self, text: str, begin: int, end: int):
        ids, starts, ends = self.offsets(text[begin:end])
        return ids, starts + begin, ends + begin

    def _encoding(self, text: str):
        e = self.model.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, np.int64), spans[:, 0], spans[:, 1]

    def _batch(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _proto(self, text: str):
        pieces = self.model.encode(text, return_type="proto").pieces
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
        spans = np.array([(p.begin, p.end) for p in pieces], np.int64).reshape(-1, 2)
        return np.array([p.id for p in pieces], np.int64), char[spans[:, 0]], char[spans[:, 1]]

    def _pieces(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


def counter(path: str) -> TokenCounter:
    """This worker's counter of a tokenizer file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids
    are rows like any other; an empty table gives an empty result; texts of any
    length are counted whole. No rows are shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for b in batches:
            texts, tokens = b.column(1), []
            sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
            for lo, hi in groups(sizes):
                tokens += count(texts[lo:hi].to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
