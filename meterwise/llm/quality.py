"""Quality scores by votes of nearest labelled documents in a latent-semantic space.

The classifier is fitted on at most ``SAMPLE`` labelled rows (those whose id
has the smallest hash): TF-IDF of hashed byte trigrams, reduced to ``RANK``
latent dimensions by a truncated singular value decomposition. The projection
and the labelled vectors are broadcast; their size is bounded by SAMPLE, RANK
and DIMS. Every document's cosine to every labelled vector is computed exactly,
in blocks, and its NEIGHBOURS nearest vote with weights that grow with
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import fold
from meterwise.llm.ngrams import DIMS, blocks, counts_of, idf_of, tfidf, unpack_counts

SAMPLE = 4096
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 16   # a vote's weight is its cosine to this power
THRESHOLD = 0.3
HOLD_OUT = 5


def truncated_svd(rows: np.ndarray, rank: int) -> np.ndarray:
    """(DIMS, rank) right singular vectors by subspace iteration from a fixed start."""
    wide = min(rank + 10, *rows.shape)
    base = np.random.default_rng(0).standard_normal((rows.shape[1], wide))
    for _ in range(5):
        left, _ = np.linalg.qr(rows @ base)
        base = rows.T @ left
    _, _, vt = np.linalg.svd(base.T, full_matrices=False)
    return vt[:rank].T


def latent(counts: np.ndarray, idf: np.ndarray, projection: np.ndarray) -> np.ndarray:
    rows = tfidf(counts, idf) @ projection
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model of a bounded sample, whatever the order of its rows."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1], r[2], r[3]))
    if not rows:
        return
    counts = unpack_counts([r[2] for r in rows], [r[3] for r in rows])
    idf = idf_of((counts > 0).sum(axis=0), len(rows))
    projection = truncated_svd(tfidf(counts, idf), RANK)
    vectors = latent(counts, idf, projection)
    parts = [np.ascontiguousarray(x, "<f4").tobytes() for x in (idf, projection, vectors, [r[1] for r in rows])]
    yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts],
                                     names=["idf", "projection", "vectors", "votes"])


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Similarity-weighted mean label of the nearest known vectors; the mean label if none is similar."""
    cos = np.maximum(vectors @ known.T, 0.0)
    k = min(NEIGHBOURS, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(cos, near, 1).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    mean = (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
    return np.clip(np.where(total > 1e-12, mean, labels.mean()), 0.0, 1.0)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``sample`` labelled ids whose crc32 modulo 5 is not 0;
    a null label teaches nothing. Empty and null texts, and texts unlike all
    that is known, score the sample's mean label; without any labelled row
    every score is 0.5. Ties between equally near rows go either way but the
    same way in every run. A null id is not held out. Repeated rows each get a
    score, and an id teaches once; an empty ``docs`` gives an empty result; a very
    long text is counted whole, in the memory of its bytes.
    """
    spark = docs.sparkSession
    taught = (labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("label"))
              .where(F.col("label").isNotNull() & (fold(F.col("l_id"), HOLD_OUT) != 0))
              .orderBy(F.xxhash64("l_id"), "l_id", "label").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("t"))
    known = texts.join(F.broadcast(taught), F.col("id") == F.col("l_id"))  # at most ``sample`` rows of two numbers
    kind = docs.schema[id_col].dataType.simpleString()
    counted = (known.select("id", "label", "t")
               .mapInArrow(counts_of(2, repeats=True), f"id {kind}, label double, at binary, n binary"))
    # An id repeated in docs teaches once, so the sample stays bounded.
    once = counted.groupBy("id").agg(F.min(F.struct("label", "at", "n")).alias("s")).select("id", "s.*")
    fitted = once.coalesce(1).mapInArrow(
        _fit, "idf binary, projection binary, vectors binary, votes binary").collect()  # one bounded row
    if not fitted:
        return docs.select(id_col, _held_out(id_col), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    idf, projection, vectors, taught_labels = (np.frombuffer(x, "<f4") for x in fitted[0])
    model = spark.sparkContext.broadcast((idf, projection.reshape(DIMS, -1),
                                          vectors.reshape(len(taught_labels), -1), taught_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, projection, known, known_labels = model.value
        for b in batches:
            scores = [votes(latent(c.astype(np.float32), idf, projection), known, known_labels)
                      for _, _, c in blocks(b.column(1), repeats=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                                             names=["id", "score"])

    scored = texts.mapInArrow(run, f"id {kind}, score double")
    return scored.withColumnRenamed("id", id_col).select(
        id_col, _held_out(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _held_out(id_col: str):
    return F.coalesce(fold(F.col(id_col), HOLD_OUT) == 0, F.lit(False)).alias("held_out")
