"""Personal data, and terms that give it away.

Base spans (email, ip, card, phone) are found by patterns in whole texts. Each
value found is a protected entity. The corpus then estimates how much a term
tells about an entity: with N documents, n_e that hold the entity, n_t that hold
the term and n_et that hold both, wherever they stand, the term discloses

    PMI(e, t) / IC(e) = log(P(e | t) N / n_e) / log(N / n_e),  P(e | t) = n_et / n_t

of the entity's information. Entities of any support count, so P(e | t) is also
smoothed by ``PRIOR`` documents that hold the term and hold the entity as often
as any document: (n_et + PRIOR n_e / N) / (n_t + PRIOR). Terms that disclose at
least ``GENERALISE`` by the smoothed share are replaced by a class label wherever
they stand in the documents that hold the entity. They are removed if the plain share is at least ``REMOVE`` and
more than one document holds both; one document alone can be a coincidence.
Counts cover all documents and all their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import cut, with_fields

GENERALISE = 0.8
REMOVE = 0.95
PRIOR = 2.0          # documents
# Kinds and patterns of base spans (fixed values); possessive forms of the same languages.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# A term: three or more letters, where every character beyond ASCII counts as a letter.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"
_TERM = re.compile(TERM)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: a match holds one @, so each @ is looked at once, both ways."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Of a run of dotted numbers, each four are a match; it counts if none is over 255."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _CHAIN.finditer(text):
        digits = _NOT_DIGIT.sub("", run.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", run.group())) <= 15:
            yield run.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entity_key(kind: str, value: str) -> str:
    """Cards and phones are their digits, however they are written."""
    return f"{kind}:{_NOT_DIGIT.sub('', value) if kind in ('card', 'phone') else value.lower()}"


def outside_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words of the text but those that touch a base span; spans by start."""
    at, done = 0, 0  # spans before ``at`` start left of the word's end, and reach to ``done``
    for w in _TERM.finditer(text):
        while at < len(spans) and spans[at][1] < w.end():
            done, at = max(done, spans[at][2]), at + 1
        if done <= w.start():
            yield w.group().lower(), w.start(), w.end()


def detect(docs: DataFrame, keep: list[str], text_col: str, prefix: str) -> DataFrame:
    """Columns ``keep`` with <prefix>spans (base), <prefix>held (entities) and <prefix>text (of holders, else null).

    Null text counts as empty.
    """
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans, held, kept = b.column(b.num_columns - 1), [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                found = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                held.append(sorted({entity_key(k, text[s:e]) for k, s, e in found}))
                kept.append(text if found else None)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(spans, span_type), pa.array(held, pa.list_(pa.string())), pa.array(kept, pa.string())],
                names=[*b.schema.names[:-1], f"{prefix}spans", f"{prefix}held", f"{prefix}text"])

    kept = docs.select(*[f"`{c}`" for c in keep], F.col(text_col).alias(f"{prefix}text"))
    schema = with_fields(kept.drop(f"{prefix}text").schema, f"{prefix}spans {SPANS}, {prefix}held array<string>, {prefix}text string")
    return kept.mapInArrow(run, schema)


def terms_of(holders: DataFrame) -> DataFrame:
    """(_r, term): the distinct terms outside base spans of rows (_r, spans, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows, terms = [], []
                for i in range(lo, min(lo + 64, b.num_rows)):
                    r, spans, text = (c[i].as_py() for c in b.columns)
                    new = {t for t, _, _ in outside_terms(text, [(s["kind"], s["start"], s["end"]) for s in spans])}
                    rows += [r] * len(new)
                    terms += new
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.string())], names=["_r", "term"])

    return holders.select("_r", "spans", "text").mapInArrow(run, "_r bigint, term string")


def places(marked: DataFrame) -> DataFrame:
    """(_r, more): spans of every occurrence of the terms told in rows (_r, spans, text, told)."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = []
            for i in range(b.num_rows):
                spans, text, told = (c[i].as_py() for c in b.columns[1:])
                kinds = {x["term"]: "remove" if x["remove"] else "term" for x in told}
                more.append([{"kind": kinds[t], "start": s, "end": e} for t, s, e in outside_terms(
                    text, [(x["kind"], x["start"], x["end"]) for x in spans]) if t in kinds])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(more, span_type)], names=["_r", "more"])

    return marked.select("_r", "spans", "text", "told").mapInArrow(run, f"_r bigint, more {SPANS}")


def disclosing(holders: DataFrame, docs: DataFrame, text_col: str, n_docs: int) -> DataFrame:
    """(_r, term, remove): for each holding row its terms whose smoothed share of one of its entities is at or above GENERALISE.

    ``holders`` (a written table) has a row (_r, spans, held, text) for each
    document with entities; ``docs`` the texts of all documents. A term and an
    entity stand together in at most as many documents as the rarer of them,
    which bounds what the term can disclose. Terms and pairs whose bound is below
    GENERALISE are left out before pairs are made, which changes no result. A
    term that the word count does not know (case rules differ for a few letters)
    counts as standing in holding documents only.
    """
    n = F.lit(float(n_docs))

    def share(n_et, n_e, n_t, prior: float = PRIOR):
        told = F.log2((n_et * n / n_e + prior) / (n_t + prior))
        whole = F.log2(n / n_e)
        return F.when(whole > 0, told / whole)

    def can(most, n_t):
        """Whether a term can disclose an entity of up to ``most`` documents: its share is largest if both are held by as many."""
        n_e = F.least(most, F.col("n_held"))
        return share(n_e, n_e, n_t) >= GENERALISE

    each = holders.select("_r", F.explode("held").alias("entity"))
    row = F.col("_r")
    holding = cut(each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64(row)).alias("x"),
                                             F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)")).alias("s")))
    # Entities that the same documents hold disclose alike: each such class is one entity from here on.
    entities = cut(holding.withColumn("class", F.struct("n_e", "x", "s")).select("entity", "class", "n_e"))
    held = cut(each.join(entities, "entity").select("_r", F.col("class").alias("entity"), "n_e").distinct())
    most = entities.agg(F.max("n_e")).first()[0] or 1
    own = terms_of(holders).groupBy("term").agg(F.count(F.lit(1)).alias("n_held")).where(can(F.lit(most), F.col("n_held")))
    words = (docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM), F.lit(0)))).alias("w"))
             .groupBy("w").agg(F.count(F.lit(1)).alias("n_w")))
    counts = cut(own.join(words, F.col("term") == F.col("w"), "left")
                 .select("term", "n_held", F.greatest("n_held", F.coalesce("n_w", "n_held")).alias("n_t"))
                 .where(can(F.lit(most), F.col("n_t"))))
    top = held.groupBy("_r").agg(F.max("n_e").alias("top"))
    rare = terms_of(holders).join(counts, "term").join(top, "_r").where(can(F.col("top"), F.col("n_t"))).drop("top")
    bound = share(F.least("n_e", "n_held"), F.col("n_e"), F.col("n_t"))
    pairs = cut(rare.join(held, "_r").where(bound >= GENERALISE).select("_r", "entity", "term", "n_e", "n_t"))
    n_et, n_e, n_t = F.col("n_et"), F.col("n_e"), F.col("n_t")
    told = (pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"))
            .where(share(n_et, n_e, n_t) >= GENERALISE)
            .select("entity", "term", ((share(n_et, n_e, n_t, 0.0) >= REMOVE) & (n_et > 1)).alias("remove")))
    return pairs.join(told, ["entity", "term"]).groupBy("_r", "term").agg(F.max("remove").alias("remove"))


def find_private(docs: DataFrame, keep: list[str], text_col: str = "text", prefix: str = "_pii_") -> DataFrame:
    """Columns ``keep`` of ``docs`` with <prefix>spans (base) and <prefix>more (added spans, or null).

    Added spans are all occurrences, outside base spans, of the disclosing terms
    in the documents that hold what they disclose, of kind ``term`` (generalised)
    or ``remove``. Rows are told apart by their place in a written table, so
    repeated ids and texts do no harm.
    """
    rid, spans, held, text, more = (prefix + x for x in ("rid", "spans", "held", "text", "more"))
    found = cut(detect(docs, keep, text_col, prefix).withColumn(rid, F.monotonically_increasing_id()))
    holders = found.where(F.size(held) > 0).select(
        F.col(rid).alias("_r"), F.col(spans).alias("spans"), F.col(held).alias("held"), F.col(text).alias("text"))
    told = (disclosing(holders, docs, text_col, found.count())
            .groupBy("_r").agg(F.collect_list(F.struct("term", "remove")).alias("told")))
    placed = places(holders.join(told, "_r")).withColumnRenamed("more", more)
    return found.join(placed, found[rid] == placed["_r"], "left").drop("_r", rid, held, text)


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms), one row per row.

    spans lists base and added spans as kind:start:end (code points, end
    exclusive) by start, then kind in the order of KINDS, then ``remove`` and
    ``term``. Null and empty texts hold nothing.
    """
    found = find_private(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    order = {k: i for i, k in enumerate((*KINDS, "remove", "term"))}
    rank = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), x["kind"])
    both = F.concat(F.col("_pii_spans"), F.coalesce("_pii_more", F.array().cast(SPANS)))
    ordered = F.transform(F.sort_array(F.transform(both, lambda x: F.struct(
        x["start"].alias("start"), rank(x).alias("r"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    count = lambda k: F.size(F.filter("_pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias(id_col), *[count(k) for k in KINDS],
                        F.sha2(text(F.col("_pii_spans")), 256).alias("base_sha256"), text(ordered).alias("spans"),
                        F.coalesce(F.size("_pii_more"), F.lit(0)).cast("long").alias("n_terms"))


def masked(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced, overlapping ones as one span labelled by the first."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["start"] >= done:
            out += [text[done:s["start"]], "" if s["kind"] == "remove" else f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, same columns and rows, with base spans masked and disclosing terms generalised or removed.

    A text without spans, or null, stays as it is. Other columns, character
    counts included, are not touched.
    """
    schema, names = docs.schema, docs.columns
    found = find_private(docs, names, text_col)
    marked = found.select(*[f"`{c}`" for c in names], F.concat(
        "_pii_spans", F.coalesce("_pii_more", F.array().cast(SPANS))).alias("_pii_all"))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(at), b.column(b.num_columns - 1)
            new = [masked(texts[i].as_py(), s) if (s := spans[i].as_py()) else texts[i].as_py() for i in range(len(texts))]
            columns = b.columns[:-1]
            columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return marked.mapInArrow(run, schema)
