"""Segment resampling, spelling variants and token counts against brute force, and on awkward and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterwise.llm import queries, segment_resampling, spelling, token_counts
from meterwise.llm.queries import tokenizer_path
from tests.llm.data import documents, nothing


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Lines of every kind: empty, of one word, repeated, and words of many alphabets."""
    rng = random.Random(5)
    words = ["a", "Bc", "the", "THE", "été", "Ünder", "x1", "字字", "w" * 70, "z" * 200, "lorem", "ipsum"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    texts += ["\n\n\n", "a\nb\nc\nd", "a\n\n!\nb", None, "", "one", "\n" + lines[3] * 3 + "\r\n x"]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, weight string, rank long").repartition(4).cache()


# Segment resampling

def word_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def naive_resample(rows, targets):
    def buckets(features):
        return [zlib.crc32(f.encode()) % 10000 for f in features]
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(word_features(text)[1]))
    for text in targets:
        t.update(buckets(word_features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out, eligible = [], []
    for doc, text in rows:
        words, features = word_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
                     for b in buckets(features))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(features), weight, score, None])
        if len(words) >= 20:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(eligible[:5 * len(eligible) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


TARGETS = ["the thing was over there and here we are", "der die und das", "THE lorem\nipsum été", None, ""]


def drawn(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_resampling_is_brute_force(spark, request, name, monkeypatch):
    table = request.getfixturevalue(name)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGETS)], "item_id long, text string")
    want = naive_resample([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()], TARGETS)
    assert any(r[4] for r in want)
    assert drawn(segment_resampling.resample(table, target)) == want


def test_resampling_does_not_depend_on_groups(spark, odd_docs, monkeypatch):
    target = spark.createDataFrame([(1, "the lorem")], "item_id long, text string")
    a = drawn(segment_resampling.resample(odd_docs, target, percent=50))
    monkeypatch.setattr(segment_resampling, "GROUP", 50)
    monkeypatch.setattr(segment_resampling, "KNOWN", 5)
    assert drawn(segment_resampling.resample(odd_docs.repartition(1), target, percent=50)) == a
    assert len([r for r in a if r[4]]) > 5


def test_resampling_of_empty_tables(spark, docs):
    assert segment_resampling.resample(nothing(spark), nothing(spark)).collect() == []
    got = segment_resampling.resample(docs, nothing(spark)).collect()
    assert len(got) == docs.count()


@given(st.lists(st.binary(min_size=1, max_size=300), min_size=2, max_size=20))
def test_checksums_are_joined(parts):
    a = np.array([zlib.crc32(x) for x in parts[:-1]], np.uint32)
    b = np.array([zlib.crc32(x) for x in parts[1:]], np.uint32)
    n = np.array([len(x) for x in parts[1:]])
    assert segment_resampling.append(a, b, n).tolist() == [zlib.crc32(x + y) for x, y in zip(parts, parts[1:])]


def test_a_line_is_counted_once_per_task(monkeypatch):
    texts = [b"same line here\nother", b"same line here\nsame line here"]
    s = segment_resampling.Segments(texts)
    assert s.lines == {b"same line here": 0, b"other": 1} and s.occurrences().tolist() == [3, 1]


# Spelling variants

def edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def naive_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if edits_one(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)

    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return sorted((w, form, root(w), n, k, m) for w, (n, k, form, m) in out.items())


def naive_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def variants(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_variants_are_brute_force(docs, rows):
    want = naive_variants(naive_words(rows))
    assert len(want) > 20 and any(r[1] for r in want)
    assert variants(spelling.spelling_variants(docs)) == want


@pytest.mark.parametrize("tile", [3, 512])
def test_dense_neighbours_in_crowded_keys(spark, tile, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = random.Random(tile)
    counts = {}
    while len(counts) < 400:
        counts["".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))] = rng.choice([3, 4, 7, 20, 50, 1000])
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert variants(spelling.group_variants(table)) == naive_variants(counts)


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    words = ["abcdefghij"[:5 + i] for i in range(6)]
    counts = {w: 3 ** (i + 1) for i, w in enumerate(words)}
    got = variants(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == naive_variants(counts) and {r[2] for r in got} == {words[-1]}


@given(st.lists(st.text("abÿ\U0001f600", min_size=1, max_size=6), min_size=1, max_size=25, unique=True))
@settings(max_examples=80, deadline=None)
def test_tiles_find_single_edits_once(words):
    found = Counter()
    for longer in range(2, 8):
        tile = [w for w in words if len(w) in (longer - 1, longer)]
        for side in "ps":
            i, j = spelling.near_in_tile(tile, tile, longer, longer // 2, side)
            found.update((tile[a], tile[b]) for a, b in zip(i, j))
    assert found == Counter((a, b) for a in words for b in words if max(len(a), len(b)) > 1 and edits_one(a, b))


def test_variants_of_empty_tables(spark):
    assert spelling.spelling_variants(nothing(spark)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")).collect() == []


# Token counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
PARTS = ["a", "bc", " ", "  ", "\n", "\t", "'s", "12", "é", "é", "字", "\U0001d11e", "<|endoftext|>", "!!", " ",
         "　", " the", " quick", "\x1c", "​", "ﬁ", "Σ", "\r\n", "▁", "<s>", "İ"]


def library(path):
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.fixture(scope="module", params=FILES)
def chunked(request):
    import public_tokenizers
    path = public_tokenizers.path(request.param)
    return token_counts.TokenCounter(path, chunk=60, overlap=7), library(path)


@given(st.lists(st.sampled_from(PARTS), max_size=150))
@settings(max_examples=150, deadline=None)
def test_chunks_count_as_the_whole(chunked, parts):
    text = "".join(parts)
    assert chunked[0].count_chunks(text) == chunked[1](text) == chunked[0].count([text])[0]


def test_texts_without_a_stable_boundary(chunked):
    texts = ["x" * 3000, " " * 3000, "<|endoftext|>" * 200, "ab " * 1500, "ab  " * 900, "字" * 900, "\n" * 999, "! " * 999]
    assert chunked[0].count(texts) == [chunked[1](t) for t in texts]


def test_disagreeing_encodings_widen_the_overlap():
    import public_tokenizers
    counter = token_counts.TokenCounter(public_tokenizers.path(FILES[0]), chunk=60, overlap=7)
    asked, agree = [], counter._agree

    def refuse(left, right, first, last):
        asked.append(last - first)
        return len(asked) > 3 and agree(left, right, first, last)
    counter._agree = refuse
    text = "ab cd ef gh " * 30
    assert counter.count_chunks(text) == library(public_tokenizers.path(FILES[0]))(text)
    assert asked[0] < asked[1] < asked[2]


def test_token_counts(docs, rows):
    count = library(tokenizer_path())
    got = token_counts.token_counts(docs, tokenizer_path()).collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(n > token_counts.CHUNK for _, n, _, _ in want)


def test_token_counts_of_empty_tables(spark):
    assert token_counts.token_counts(nothing(spark), tokenizer_path()).collect() == []


# The SQL of the registered queries

@pytest.mark.parametrize("name,key", [("op11_segment_resampling", "doc_id"), ("op12_spelling_variants", "word")])
def test_queries_match_their_sql(spark, sf, name, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = ", ".join(df.columns)
    want = con.sql(f"SELECT {cols} FROM ({queries.ORACLE[name]}) ORDER BY {key}").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
