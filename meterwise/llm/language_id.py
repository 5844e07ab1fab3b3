"""Language identification by nearest centroids.

Each language gets several centroids: spherical k-means over the normalised
TF-IDF vectors (hashed byte trigrams of lower-cased text, all but letters as one space) of at most
``PER_LANGUAGE`` of its documents. A text gets the language of the centroid with
the highest cosine. A text further from it than ``REJECT`` times the cosine
that the language's own sample reaches (its first percentile) is rejected.
What is broadcast is bounded by the number of languages times CENTROIDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut, fold, with_fields
from meterwise.llm.ngrams import DIMS, blocks, counts_of, idf_of, tfidf, unpack_counts

PER_LANGUAGE = 1000
CENTROIDS = 4
ROUNDS = 12
REJECT = 0.25
HOLD_OUT = 4
HELD = 2
UNDETERMINED = "und"
LETTER = r"\p{L}"


def spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """At most k unit centroids, from spread-out starting rows."""
    starts = [0]
    while len(starts) < min(k, len(rows)):
        starts.append(int((rows @ rows[starts].T).max(axis=1).argmin()))
    centres = rows[starts]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, at, n): trigram counts of the at most PER_LANGUAGE ids of each language with the smallest hashes.

    An id counts once however often it is repeated (its smallest text is taken).
    The hash limit lets through a little more than that; the rest is ranked.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where(
        F.col("lang").isNotNull() & (fold(F.col("id"), HOLD_OUT) != HELD) & F.col("t").rlike(LETTER))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    if not sizes:
        return None
    scale = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items())
                            for x in (lang, min(scale, scale * 2 * PER_LANGUAGE // n))])
    hashed = usable.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(scale))).where(F.col("h") < limits[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h", "id")  # about 2 * PER_LANGUAGE rows
    chosen = (hashed.groupBy("lang", "id", "h").agg(F.min("t").alias("t"))
              .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PER_LANGUAGE))
    return cut(chosen.select("lang", F.encode(F.lower("t"), "UTF-8").alias("t"))
               .mapInArrow(counts_of(1, letters_only=True), "lang string, at binary, n binary"))


def _document_counts(rows: pd.DataFrame) -> pd.DataFrame:
    seen = (unpack_counts(list(rows["at"]), list(rows["n"])) > 0).sum(axis=0)
    return pd.DataFrame({"n": [len(rows)], "df": [seen.astype("<i8").tobytes()]})


def _centroids(idf: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "n"])
        vectors = tfidf(unpack_counts(list(rows["at"]), list(rows["n"])), idf)
        centres = spherical_kmeans(vectors, CENTROIDS)
        floor = REJECT * float(np.quantile((vectors @ centres.T).max(axis=1), 0.01))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "floor": [floor],
                             "centres": [centres.astype("<f4").tobytes()]})
    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(idf, centroids, language of each centroid, floor of each centroid), or None without labelled text."""
    sample = _sample(docs, id_col, text_col, lang_col)
    seen = [] if sample is None else sample.groupBy("lang").applyInPandas(_document_counts, "n long, df binary").collect()
    if not seen:
        return None
    idf = idf_of(np.sum([np.frombuffer(r["df"], "<i8") for r in seen], axis=0), sum(r["n"] for r in seen)).astype(np.float32)
    found = sorted(sample.groupBy("lang").applyInPandas(_centroids(idf), "lang string, floor double, centres binary").collect())
    centres = [np.frombuffer(r["centres"], "<f4").reshape(-1, DIMS) for r in found]
    names = [r["lang"] for r, c in zip(found, centres) for _ in c]
    floors = np.array([r["floor"] for r, c in zip(found, centres) for _ in c])
    return idf, np.concatenate(centres), names, floors


def identify(docs: DataFrame, model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (names after ``prefix``) added.

    lang_pred is the nearest centroid's language, the first in name order among
    equals; "und" with score 0 if the text is null or has no letter, or if there
    is no model. score is the cosine to that centroid, 0 to 1. rejected is true
    for "und" and for texts beyond the rejection distance.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    letters = f"{prefix}letters"
    work = docs.withColumn(letters, F.when(F.col(text_col).rlike(LETTER), F.encode(F.lower(F.col(text_col)), "UTF-8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            best, score, floor = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
            if known.value is not None:
                idf, centres, names, floors = known.value
                for start, end, counts in blocks(texts, letters_only=True):
                    cos = tfidf(counts.astype(np.float32), idf) @ centres.T
                    near = cos.argmax(axis=1)
                    score[start:end] = np.clip(cos.max(axis=1), 0.0, 1.0)
                    floor[start:end] = floors[near]
                    best[start:end] = [names[i] for i in near]
            for i in np.flatnonzero(~texts.is_valid().to_numpy(zero_copy_only=False)):
                best[i], score[i], floor[i] = UNDETERMINED, 0.0, 1.0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string()), pa.array(score), pa.array(score < floor)],
                                             names=[*b.schema.names[:-1], *added])

    added = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    return work.mapInArrow(run, with_fields(
        docs.schema, f"{added[0]} string, {added[1]} double, {added[2]} boolean"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) for every row, learned from the rows not held out.

    Rows with a null language or a null id teach nothing; repeated rows are
    rows. An empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    found = identify(docs.select(id_col, text_col), model, text_col)
    held = F.coalesce(fold(F.col(id_col), HOLD_OUT) == HELD, F.lit(False)).alias("held_out")
    return found.select(id_col, held, "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found and not rejected."""
    model = fit(docs, id_col, text_col, lang_col)
    found = identify(docs, model, text_col, prefix="_llm_lid_")
    return found.where(~F.col("_llm_lid_rejected")).select(*[f"`{c}`" for c in docs.columns])
