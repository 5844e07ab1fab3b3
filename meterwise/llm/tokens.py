"""Token ids of whole texts, with a bounded cache of encoded words.

The byte-level tokenizer first cuts a text into pieces, and no piece runs
across the start of a run of white space. So a text's ids are those of its
chunks (a run of white space and the run of other characters after it), in
order, and a single line end between other characters is a piece of its own.
Chunks repeat much more often than texts. Arrow splits texts at spaces and
numbers their different chunks, so a chunk is looked up once for many texts.
Each Python worker keeps the ids of those it has met, about ``CACHE_WORDS`` at
most, and lets go of those that have not come again for the longest time.
A new word of letters after a space is one piece, and the marks after it are
another, so the tokenizer's model gets such words cut already. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 1_000_000
LINES = 128  # new chunks that the tokenizer gets at once; many more take longer each
# The characters of Unicode's White_Space (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PAIR = re.compile(f"[{SPACE}][{SPACE}]")
_INNER = re.compile(f"[{SPACE}]")
_LETTERS = re.compile("[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+")
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """encode(texts): for each text the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}  # chunks as they are
        self.words: dict[str, bytes] = {}   # chunks after a line end, with it, and after a space, without it
        self.old: dict[str, bytes] = {}     # the words before there were half of CACHE_WORDS; they move back if they come again
        self.line_end = self._ids("\n")
        rule = self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = None  # encodes pieces of letters, if letters and marks are pieces
        if (isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex and self.tokenizer.normalizer is None
                and not any(_LETTERS.fullmatch(t.strip()) for t in added)):
            space, *letters = map(chr, [0x20, *range(0xC0, 0x100)])
            of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.bytes = {ord(c): of(c)[0][0] for c in (space, *letters)}
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(self.bytes[0x20], "merged_with_next")
            vocabulary = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
            self.begins[[i for token, i in vocabulary.items() if token.startswith(self.bytes[0x20])]] = True
        self.marks = "".join(set(string.punctuation).difference(*added))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if len(self.chunks) + len(self.words) > CACHE_WORDS // 2:
            self.chunks, self.words, self.old = {}, {}, self.words
        paired = [_PAIR.search(t) is not None for t in texts]
        plain = iter(self._encode_plain([t for t, pair in zip(texts, paired) if not pair]))
        return [b"".join(map(self._chunk, _CHUNK.findall(t))) if pair else next(plain) for t, pair in zip(texts, paired)]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts in which no white space meets white space."""
        # A line end before the text makes its first chunk one like those of other lines.
        parts = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        words = parts.flatten().dictionary_encode()
        ids = pa.array(self._word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        ids = ids.take(words.indices)
        _, offsets, data = ids.buffers()
        stops = np.frombuffer(offsets, np.int64)[parts.offsets.to_numpy()].tolist()
        raw, skip = memoryview(data or b""), len(self.line_end)
        return [bytes(raw[a + skip:b]) for a, b in zip(stops, stops[1:])]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of different keys of ``words``."""
        out = list(map(self.words.get, words))
        new = {w for w, ids in zip(words, out) if ids is None}
        if not new:
            return out
        again = new & self.old.keys()
        self.words.update((w, self.old[w]) for w in again)
        self._learn(new - again)
        return [self.words[w] if ids is None else ids for w, ids in zip(words, out)]

    def _chunk(self, chunk: str) -> bytes:
        if chunk not in self.chunks:
            self.chunks[chunk] = self._ids(chunk)
        return self.chunks[chunk]

    def _learn(self, new: set[str]) -> None:
        """New words; those of letters and marks are put together from both."""
        rest, letters, marked = new, set(), []
        if self.model is not None:
            rest = set()
            for w in new:
                stem = w.rstrip(self.marks)
                if not _LETTERS.fullmatch(stem):
                    rest.add(w)
                    continue
                if stem != w:
                    marked.append((w, stem))
                if stem not in self.words and stem not in self.old:
                    letters.add(stem)
        self._learn_letters(list(letters))
        for w, stem in marked:
            self.words[w] = (self.words.get(stem) or self.old[stem]) + self._chunk(w[len(stem):])
        self._learn_lines(rest)

    def _learn_letters(self, new: list[str]) -> None:
        """Words of letters: a piece each, with the space before it."""
        for at in range(0, len(new), LINES):
            some = new[at:at + LINES]
            text = " ".join(["", *some]).translate(self.bytes)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            if len(starts) != len(some):
                raise ValueError("the tokenizer joins spaces with letters before them")
            raw = ids.tobytes()
            self.words.update((w, raw[a:b]) for w, a, b in zip(some, starts, [*starts[1:], len(raw)]))

    def _learn_lines(self, new: set[str]) -> None:
        """New words are encoded as one text, a line each."""
        odd = [w for w in new if w in ("", "\n") or _INNER.search(w, w[0] == "\n")]
        plain = list(new.difference(odd))
        end = int(np.frombuffer(self.line_end, "<u4")[0])
        for at in range(0, len(plain), LINES):
            some = plain[at:at + LINES]
            text = "\n".join([w[1:] if w[0] == "\n" else " " + w for w in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.append(np.flatnonzero(ids == end), len(ids)) * 4).tolist()
            if len(stops) != len(some):
                raise ValueError("the tokenizer joins line ends with other characters")
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, stops):
                self.words[w] = self.line_end + raw[start:stop] if w[0] == "\n" else raw[start:stop]
                start = stop + 4
        for w in odd:
            self.words[w] = self.line_end + self._ids(w[1:]) if w[:1] == "\n" else self._ids(" " + w)


def encoder(path: str) -> TextEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def groups(sizes: list[int], limit: int = 4 << 20):
    """(start, end) of runs of texts with about ``limit`` bytes each, one text at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
