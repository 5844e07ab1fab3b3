"""Operators on documents against brute force, and on awkward and empty tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from meterwise.llm import decontaminate, language_id, lpt_sharding, pii, quality, range_coder, simhash, tokens, vector_packing
from meterwise.llm.queries import tokenizer_path
from tests.llm.data import LONG, documents, nothing, sentence


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


# Sharding

def naive_lpt(sizes, shards):
    loads, out = [0] * shards, []
    for s in sorted(sizes, reverse=True):
        i = loads.index(min(loads))
        loads[i] += s
        out.append((s, i))
    return loads, sorted(out)


@given(st.lists(st.integers(1, 9), min_size=1, max_size=400), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_schedule_is_the_greedy_one(sizes, shards):
    counts = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
    dealt = [(s, i) for s, low, high, i in lpt_sharding.lpt_schedule(counts, shards) for _ in range(high - low)]
    assert sorted(dealt) == naive_lpt(sizes, shards)[1]


def test_a_schedule_leaves_the_driver_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lpt_sharding, "SCHEDULE_ROWS", 3)
    for n in (0, 1, 3, 7):
        rows = [(10 - i, 0, 1, i % 2) for i in range(n)]
        assert sorted(map(tuple, lpt_sharding.written(spark, iter(rows)).collect())) == sorted(rows)


def test_shards(docs, rows):
    got = lpt_sharding.lpt_shards(docs, 4).toPandas()
    assert len(got) == len(rows)
    assert sorted(zip(got["size"], got["text_crc32"])) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    texts = got[got["size"] > 1].groupby(["size", "text_crc32"])["shard"].nunique()
    assert texts.max() == 1 and got["grown_shard"].isna().all()
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    assert sorted(got.groupby("shard")["size"].sum()) == sorted(x for x in naive_lpt(groups.values(), 4)[0] if x)


def test_ranks_do_not_need_one_task(spark, monkeypatch):
    from meterwise.llm import common
    monkeypatch.setattr(common, "RANK_ROWS", 10)
    df = spark.range(500).selectExpr("id % 3 = 0 AS g", "id").repartition(7)
    got = common.split_rank(df, ["g"], ["id"], "rank", 500).toPandas()
    for _, g in got.groupby("g"):
        assert sorted(g["rank"]) == list(range(len(g)))


# SimHash

def naive_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, linked):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least.setdefault(find(i), []).append(x)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash(spark, docs, rows):
    got = simhash.simhash_dedup(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [naive_fingerprint(t) for _, t in rows]
    want = naive_components([i for i, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(
        ((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want)), key=key)


def test_simhash_links_in_large_buckets(spark, monkeypatch):
    """Few bits differ, so buckets exceed a block, are split in chunks and still lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "SMALL", 16)
    rng = random.Random(3)
    fps = sorted({rng.getrandbits(9) << 20 | rng.choice([0, 0b111 << 50]) for _ in range(500)})
    edges = simhash.bucket_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    links = lambda pairs: naive_components(fps, lambda i, j: (fps[i], fps[j]) in pairs or (fps[j], fps[i]) in pairs)
    assert links({tuple(e) for e in edges}) == naive_components(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=130), st.integers(0, 7))
@settings(max_examples=40, deadline=None)
def test_bit_sliced_distances(fps, radius):
    fps = [*fps, *(f ^ 5 for f in fps), *(f ^ 1 << 63 for f in fps)]
    a = np.array(fps, np.uint64)
    got = simhash.within(a, simhash.planes_of(a), len(a), radius)
    assert (got == (np.bitwise_count(a[:, None] ^ a[None, :]) <= radius)).all()


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, ids with several texts and a group of copies of a third of all rows."""
    text = {c: sentence(random.Random(c), "en", 60) for c in range(8)}
    rows = [(i, text[0]) for i in range(100, 140)] + [(7, text[1])] * 30 + [(3, text[2]), (3, text[3]), (9, text[2]), (2, text[3])]
    rows += [(None, text[4]), (50, text[4]), (None, text[5]), (None, text[5])] + [(200 + c, text[c]) for c in (6, 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept if r["doc_id"] is not None) == sorted(
        [(text[0], 100), (text[1], 7), (text[2], 3), (text[3], 2), (text[4], 50), (text[6], 206), (text[7], 207)])
    assert [r["text"] for r in kept if r["doc_id"] is None] == [text[5]]


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and 1005 not in ids and ids.count(1007) == 1 and ids.count(1008) == 2 and 1000 in ids and 1001 not in ids


# Packing and token files

@given(st.lists(st.sampled_from(["a", "Bc", " ", "  ", "\n", "\t", "'s", "!", "é", "　", "\x1c", "<|endoftext|>", "12", "\x85"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_chunked_ids_are_whole_text_ids(parts):
    from tokenizers import Tokenizer
    e = tokens.encoder(tokenizer_path())
    text = "".join(parts)
    assert isinstance(e.tokenizer, Tokenizer)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    e = tokens.TextEncoder(tokenizer_path())
    texts = [sentence(random.Random(i), "en", 30) for i in range(5)]
    for t in texts:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_that_come_again_are_learnt_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    e, learnt = tokens.TextEncoder(tokenizer_path()), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda new, *more: (learnt.extend(new), learn(new, *more)))
    for i in range(40):
        text = f"the same word über, new{i} x{i}y and (more) über $$$"
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert learnt.count("same") == learnt.count("über,") == 1
    assert len(e.words) + len(e.old) <= 60


@given(st.lists(st.sampled_from(["über", "Ab", "c", "ÿÀ", "×", "9", ",", ".", "!?", "'s", "'", "$", "<|endoftext|>", " ", "\n", "ł", "日本", "\t"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_words_and_marks_are_pieces(parts):
    e = tokens.encoder(tokenizer_path())
    texts = ["".join(parts), " ".join(parts), "\n".join(parts), None]
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in e.encode(texts)] == want


@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 9)), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_bins_hold_their_limits(items):
    n, m = (np.array(x) for x in zip(*[(a, min(a, b)) for a, b in items]))
    seq, off = vector_packing.pack(n, m, (16, 5, 9))
    for s in range(seq.max() + 1):
        at = np.flatnonzero(seq == s)
        assert n[at].sum() <= 16 and len(at) <= 5 and m[at].sum() <= 9
        order = at[np.argsort(off[at])]
        assert off[order].tolist() == np.concatenate([[0], np.cumsum(n[order])[:-1]]).tolist()


def plain_pack(tokens, loss, limits):
    """The dot-product heuristic, in fractions, over all examples that are left."""
    left, out, number, at, room = list(range(len(tokens))), [None] * len(tokens), 0, 0, list(limits)
    while left:
        fit = [i for i in left if tokens[i] <= room[0] and room[1] >= 1 and loss[i] <= room[2]]
        if not fit:
            number, at, room = number + 1, 0, list(limits)
            continue
        i = max(fit, key=lambda i: (sum(Fraction(d * r, c * c) for d, r, c in zip((tokens[i], 1, loss[i]), room, limits)),
                                    tokens[i], loss[i], -i))
        out[i] = number, at
        at += tokens[i]
        room = [room[0] - tokens[i], room[1] - 1, room[2] - loss[i]]
        left.remove(i)
    return out


@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 9)), max_size=40), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_packing_follows_the_dot_product(items, segments):
    n, m = [a for a, _ in items], [b for _, b in items]
    seq, off = vector_packing.pack(np.array(n, np.int64), np.array(m, np.int64), (16, segments, 9))
    assert list(zip(seq.tolist(), off.tolist())) == plain_pack(n, m, (16, segments, 9))


def test_packed_documents(docs, rows, tokenizer):
    got = vector_packing.pack_documents(docs, tokenizer_path()).toPandas()
    ids = {(i, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    want = sorted((str(i), s, len(x[s:s + 2048]), zlib.crc32(np.array(x[s:s + 2048], "<u4").tobytes()), len(x))
                  for (i, t) in rows for x in [ids[i, t]] for s in range(0, len(x), 2048))
    text = lambda v: "None" if v != v or v is None else str(int(v))
    assert sorted((text(i), *r) for i, *r in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)) == want
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].max() + 1))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048


def test_checksums_of_blocks_read_apart(docs, rows, tokenizer):
    """Blocks in any order and task give the same digests."""
    file = range_coder.write_token_file(docs, tokenizer_path())
    digest = lambda f: sorted(map(str, range_coder.document_digests(range_coder.read_token_file(f)).collect()))
    assert digest(file.repartition(40)) == digest(file)


def test_token_files(docs, rows, tokenizer):
    got = [tuple(r) for r in range_coder.token_file_digests(docs, tokenizer_path()).orderBy("start").collect()]
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    want = sorted((str(i), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(i), n, c) for i, _, n, c in got) == want


@given(st.lists(st.lists(st.integers(0, 65535) | st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_blocks_come_back(blocks):
    raw = range_coder.write_blocks([(i, [(i, len(b), -i, i == 2)], np.array(b, "<u4")) for i, b in enumerate(blocks)])
    for i, (first, documents, ids) in enumerate(range_coder.read_blocks(raw)):
        assert (first, documents, ids.tolist()) == (i, [(i, len(blocks[i]), -i, i == 2)], blocks[i])


def test_blocks_compress_and_damage_is_seen():
    ids = np.tile(np.array([5, 6, 7, 50000], "<u4"), 500)
    raw = range_coder.write_blocks([(0, [(0, len(ids), 1, False)], ids)])[0]
    assert len(raw) < len(ids)
    with pytest.raises(ValueError):
        range_coder.read_blocks([raw[:-40] + bytes([raw[-40] ^ 255]) + raw[-39:]])
    with pytest.raises(ValueError):
        range_coder.read_blocks([b"XXXX" + raw[4:]])


@given(st.binary(max_size=40), st.binary(max_size=40))
def test_crc32_join(a, b):
    assert range_coder.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0,
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@given(st.lists(st.sampled_from(["a", "@", ".", "1", "25", "256", "+", " ", "-", "(", "%", "x@y.z", "1.2.3.4", "4111111111111111", "é", "+1 (234) 555-1234"]), max_size=14))
@settings(max_examples=500, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == naive_spans(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000) == pii.base_spans("9" * 300_000) == []
    assert pii.base_spans("@" * 100_000 + "+" * 100_000) == []


def test_disclosing_terms(spark):
    """A name that stands only by one address gives it away; words that stand everywhere do not."""
    rows = [(i, f"please write to Zanzibar at secret@mail.org about the weather {i}") for i in range(5)]
    rows += [(10 + i, f"please look about the weather number {i} to write at home") for i in range(40)]
    rows += [(60, None), (61, ""), (62, "call +1 234 567 8901 please")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.private_spans(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows[:5]:
        at, name = text.index("secret"), text.index("Zanzibar")
        assert got[i]["spans"] == f"remove:{name}:{name + 8},email:{at}:{at + 15}"
        assert got[i]["base_sha256"] == hashlib.sha256(f"email:{at}:{at + 15}".encode()).hexdigest()
    assert got[62]["spans"] == "phone:5:20" and got[62]["n_phone"] == 1
    assert got[60]["spans"] == got[10]["spans"] == "" and got[60]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "please write to  at [EMAIL] about the weather 0"
    assert clean[60] is None and clean[61] == "" and clean[10] == rows[5][1]


def test_terms_of_values_in_one_and_two_documents(spark):
    """One document generalises, two remove; a value in two notations is one; common words stay."""
    rows = [(0, "the office of Quokka is at 10.20.30.40 today"), (1, "ask Zanzibar on +1 234 567 8901 please"),
            (2, "ask Zanzibar on +1 (234) 567-8901 please")]
    rows += [(10 + i, "the office is open today so please ask on Monday") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "the office of [TERM] is at [IP] today"
    assert clean[1] == clean[2] == "ask  on [PHONE] please" and clean[10] == rows[3][1]
    assert {r["doc_id"]: r["n_terms"] for r in pii.private_spans(docs).collect() if r["n_terms"]} == {0: 1, 1: 1, 2: 1}


def test_terms_far_from_the_value(spark):
    """All mentions go in the documents that hold the value, however far off, and none elsewhere."""
    far = "the office is open today so please ask on Monday " * 40
    rows = [(i, f"Zanzibar wrote. {far}secret@mail.org by zanzibar here {far}and (Zanzibar)") for i in range(3)]
    rows += [(3, f"Quokka wrote. {far} at 10.20.30.40"), (4, "on Monday mail Quokka and Zanzibar")]
    rows += [(10 + i, "the office is open today so please ask and mail here by Monday as wrote") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i in range(3):
        assert clean[i] == f" wrote. {far}[EMAIL] by  here {far}and ()"
    assert clean[3] == f"[TERM] wrote. {far} at [IP]"
    assert clean[4] == rows[4][1] and clean[10] == rows[5][1]
    text = rows[0][1]
    got = {r["doc_id"]: r for r in pii.private_spans(docs).collect()}
    ends = [(m.start(), m.end()) for m in re.finditer("(?i)zanzibar", text)]
    assert got[0]["n_terms"] == 3 and [s for s in got[0]["spans"].split(",") if "remove" in s] == [f"remove:{a}:{b}" for a, b in ends]


def naive_added(rows):
    """(document, term) of all disclosing terms, from unpruned counts of every term with every value."""
    n, held, terms = len(rows), {}, {}
    for i, text in rows:
        spans = pii.base_spans(text)
        held[i] = {pii.entity_key(k, text[s:e]) for k, s, e in spans}
        terms[i] = {t for t, _, _ in pii.outside_terms(text, spans)}
    words = {i: set(re.findall(pii.TERM, text.lower())) for i, text in rows}
    count = lambda sets, x: sum(x in s for s in sets.values())
    out = set()
    for i, _ in rows:
        for e in held[i]:
            n_e = count(held, e)
            for t in terms[i]:
                n_t = max(count({j: terms[j] for j in terms if held[j]}, t), count(words, t))
                n_et = sum(e in held[j] and t in terms[j] for j, _ in rows)
                whole = math.log2(n / n_e)
                if whole > 0 and math.log2((n_et * n / n_e + pii.PRIOR) / (n_t + pii.PRIOR)) / whole >= pii.GENERALISE:
                    out.add((i, t))
    return out


def test_disclosure_is_the_unpruned_count(spark):
    rng = random.Random(11)
    names = [f"name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    values = [f"p{i}@mail.org" for i in range(40)] + ["10.0.0.1", "+49 170 555 1234"]
    rows = []
    for i in range(400):
        words = [rng.choice(names[:12]) for _ in range(6)]
        if i % 5 == 0:
            for v in rng.sample(range(len(values)), rng.choice([1, 1, 2, 4])):
                words += [values[v], names[12 + v] if rng.random() < 0.8 else rng.choice(names)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, got = dict(rows), set()
    for r in pii.private_spans(docs).collect():
        for kind, s, e in (x.split(":") for x in r["spans"].split(",") if x):
            if kind in ("term", "remove"):
                got.add((r["doc_id"], texts[r["doc_id"]][int(s):int(e)].lower()))
    want = naive_added(rows)
    assert got == want and len(want) > 20


def test_values_of_the_same_documents_are_one_entity(spark, monkeypatch):
    """One document with very many values and rare words makes a row per word, not one per word and value."""
    made = []
    real = pii.cut
    monkeypatch.setattr(pii, "cut", lambda df: made.append(real(df)) or made[-1])
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [f"zz{a}{b}{c}" for a in letters for b in letters for c in letters][:1500]
    big = " ".join(f"{w} q{i}@mail.org" for i, w in enumerate(rare))
    docs = spark.createDataFrame([(0, big)] + [(i, f"plain words stand here {i}") for i in range(1, 300)], "doc_id long, text string")
    got = pii.private_spans(docs).where("doc_id = 0").first()
    assert got["n_email"] == 1500 and got["n_terms"] >= 1500
    assert [df.count() for df in made if "term" in df.columns and "entity" in df.columns] == [got["n_terms"]]


@given(st.text("ab1. @+-", max_size=60))
@settings(max_examples=200, deadline=None)
def test_outside_terms(text):
    spans = pii.base_spans(text)
    assert list(pii.outside_terms(text, spans)) == [
        (m.group(), *m.span()) for m in re.finditer("[a-z]{3,}", text) if all(m.end() <= s or m.start() >= e for _, s, e in spans)]


def test_private_spans_on_awkward_rows(docs, rows):
    got = pii.private_spans(docs).toPandas()
    assert len(got) == len(rows) and (got["spans"] == "").all()
    same = pii.sanitise(docs)
    assert same.schema == docs.schema and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))


# Language

def test_the_sample_is_bounded_for_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    rows = [(5, sentence(random.Random(1), "en", 20), "en")] * 4000
    rows += [(i, sentence(random.Random(i), lang, 20), lang) for i in range(400) for lang in ("en", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sizes = {r["lang"]: r["count"] for r in language_id._sample(df, "doc_id", "text", "lang").groupBy("lang").count().collect()}
    assert sizes == {"en": 20, "de": 20}


def test_languages(docs, rows):
    got = language_id.language_id(docs)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows)
    for i, held, lang, score, rejected in found:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= score <= 1
        if i is not None and i < 60:
            assert lang == ("en" if i % 2 else "de") and not rejected
        if i in (1000, 1001, 1002, 1006):
            assert lang == "und" and score == 0 and rejected
    kept = language_id.keep_identified(docs)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} >= set(range(60))


def test_rejects_what_is_far_from_all(spark):
    rng = random.Random(1)
    known = spark.createDataFrame([(i, sentence(rng, "en", 60), "en") for i in range(60)], "doc_id long, text string, lang string")
    strange = spark.createDataFrame([(1, "жшщ ъыь эюя жшщъ")], "doc_id long, text string")
    assert language_id.identify(strange, language_id.fit(known)).first()["rejected"]


# Quality

def test_votes_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels)
    told = got.join(labels, "doc_id").where("held_out").selectExpr("avg(int(predicted = quality)) a", "count(*) n").first()
    assert told["n"] > 50 and told["a"] > 0.93
    assert got.where("score < 0 or score > 1 or predicted != int(score >= 0.3)").count() == 0


@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(2, 12))
@settings(max_examples=30, deadline=None)
def test_votes_are_those_of_the_nearest(seed, known, dims):
    """Against plain loops: all cosines, the nearest by full sorting, weights one by one."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    taught, asked = unit(rng.standard_normal((known, dims))), unit(rng.standard_normal((7, dims)))
    labels = rng.integers(0, 2, known).astype(np.float64)
    got = quality.votes(asked, taught, labels)
    for vector, score in zip(asked, got):
        cosines = sorted(((max(0.0, sum(a * b for a, b in zip(vector, t))), y) for t, y in zip(taught, labels)), reverse=True)
        near = [(c ** quality.SHARPNESS, y) for c, y in cosines[:quality.NEIGHBOURS]]
        total = sum(w for w, _ in near)
        if total > 1e-11:
            assert score == pytest.approx(sum(w * y for w, y in near) / total, abs=1e-6)
        elif total < 1e-13:
            assert score == pytest.approx(labels.mean())


def test_quality_on_awkward_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(1000, 1), (1007, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    none = quality.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all() and len(none) == len(rows)


# Decontamination

def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


@given(st.text("abc", min_size=1, max_size=40), st.text("abc", max_size=60))
@settings(max_examples=120, deadline=None)
def test_myers(pattern, text):
    assert decontaminate.myers(pattern, text) == edit_distance(pattern, text)


@given(st.lists(st.text("ab ", min_size=3, max_size=25), min_size=1, max_size=4), st.text("ab ", max_size=80))
@settings(max_examples=120, deadline=None)
def test_every_match_within_the_budget_is_found(items, text):
    items = [(i, t) for i, t in enumerate(map(decontaminate.normal, items)) if t]
    text = decontaminate.normal(text)
    got = {i: (d, e) for i, d, e in decontaminate.Matcher(items, 0.15).matches(text)} if items else {}
    want = {i: edit_distance(t, text) for i, t in items}
    assert got == {i: w for i, w in want.items() if w[0] <= int(0.15 * len(dict(items)[i]))}


def test_decontamination(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)  # several blocks of items
    plain = dict(rows)
    item = plain[7]
    edited = item[:50].upper() + "  " + item[50:90] + "x" + item[91:] + " tail"
    bench = spark.createDataFrame([(1, item), (2, plain[8]), (2, plain[8]), (3, None), (4, " "), (5, "nowhere to be found in any text")], "item_id long, text string")
    more = docs.union(docs.where("doc_id = 7").withColumn("doc_id", docs["doc_id"] + 900).withColumn("text", docs["text"].substr(1, 0)))
    more = more.unionByName(spark.createDataFrame([(2000, edited)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(more, bench).collect())
    assert got == [(7, 1), (8, 2), (2000, 1)]
    clean = decontaminate.keep_clean(more, bench)
    assert clean.schema.names == more.schema.names
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r["doc_id"]) for r in more.collect() if r["doc_id"] not in (7, 8, 2000))


# All of them on an empty table

def test_empty_tables(spark):
    none = nothing(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (lpt_sharding.lpt_shards(none), simhash.simhash_dedup(none), vector_packing.pack_documents(none, tokenizer_path()),
               range_coder.token_file_digests(none, tokenizer_path()), pii.private_spans(none), language_id.language_id(none),
               quality.quality_scores(none, labels), decontaminate.contaminated(none, bench)):
        assert df.count() == 0 and "doc_id" in df.columns
    for df in (simhash.keep_one(none), pii.sanitise(none), language_id.keep_identified(none), decontaminate.keep_clean(none, bench)):
        assert df.columns == none.columns and df.count() == 0


def test_long_texts_are_read_whole():
    assert simhash.fingerprint(LONG.encode(), 3) == naive_fingerprint(LONG)
    assert [i for i, _, _ in decontaminate.Matcher([(1, "at the very end of it all")], 0.06).matches(decontaminate.normal(LONG + " at the very end of it all"))] == [1]
