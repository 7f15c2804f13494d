"""Quality by a vote of the nearest labelled documents in a latent-semantic space.

Terms are hashed trigrams of UTF-8 bytes, and a block of ``AGAIN`` equal terms for words that repeat
the word before them, as often as such words are frequent in the text; all are weighted by log count and inverse document
frequency. A truncated SVD of a bounded sample of labelled documents gives the latent space.
The labelled vectors are broadcast (at most ``SAMPLE`` rows, a documented parameter); every
document is compared with all of them in blocks, and its nearest ones vote for their label
with weights that grow with the cosine.

Only the text enters a score. An empty or NULL text, or one that shares no term with the
sample, gets the share of label 1 in the sample. Without any usable label every score is 0.5.
Documents with contradicting labels are left out of the sample; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import arrow_map, texts, words

SAMPLE = 3000  # labelled rows that the fit may use, half of them per label
TRIGRAMS = 4096
AGAIN = 64
TERMS = TRIGRAMS + AGAIN
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 6.0
THRESHOLD = 0.3
BLOCK = 128


def term_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams and of repeated words; texts under three bytes are padded with spaces."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    b = np.frombuffer(text.ljust(3), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    out[:TRIGRAMS] = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=TRIGRAMS)
    found = words(text)
    out[TRIGRAMS:] = 200 * sum(map(eq, found, found[1:])) // max(1, len(found))
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """idf (TERMS), basis (TERMS x rank), unit vectors of the sample (rows x rank), their labels, share of label 1."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        if not len(self.labels):
            return out
        z = weighted(counts, self.idf) @ self.basis
        size = np.linalg.norm(z, axis=1)
        z /= np.maximum(size, 1e-12)[:, None]
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        sure = (size > 1e-9) & (total > 1e-12)
        out[sure] = (weight * self.labels[near]).sum(1)[sure] / total[sure]
        return np.clip(np.round(out, 6), 0, 1)


def _sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [term_counts(t) for t in texts(batch)]
    at = [np.flatnonzero(c).astype(np.uint16) for c in found]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("label"), pa.array([a.tobytes() for a in at], pa.binary()),
         pa.array([c[a].tobytes() for c, a in zip(found, at, strict=True)], pa.binary())],
        names=["doc_id", "label", "terms", "counts"],
    )


def sample_of(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, label): the usable labels with the smallest id hashes, ``size`` / 2 of each label."""
    clean = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    )
    order = F.xxhash64("doc_id", F.lit("sample"))
    take = [clean.where(F.col("label") == y).orderBy(order, "doc_id").limit(size // 2) for y in (0, 1)]
    return take[0].union(take[1]).select("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, rank: int = RANK) -> Model:
    """Latent space and voters from at most ``size`` labelled documents."""
    chosen = F.broadcast(sample_of(labels, size))  # at most ``size`` rows of two numbers
    found = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id")
    rows = arrow_map(found.select("doc_id", "label", "text"), _sparse, "doc_id long, label int, terms binary, counts binary")
    rows = sorted(rows.dropDuplicates(["doc_id", "terms", "counts"]).orderBy("doc_id", "terms", "counts").limit(size).collect())
    if not rows:
        empty = np.zeros((0, 1), np.float32)
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), empty, np.zeros(0), 0.5)
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["terms"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = weighted(counts, idf)
    # randomised range finder with two power steps
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((TERMS, rank + 16)).astype(np.float32)))[0]
    for _ in range(2):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    basis = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :rank]).astype(np.float32)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = np.array([r["label"] for r in rows], np.float64)
    return Model(idf, basis, z.astype(np.float32), y, float(y.mean()))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every document and its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS x RANK and SAMPLE x RANK floats
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_scored_text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(batch, "_scored_text")
        parts = [shared.value.scores(np.stack([term_counts(t) for t in found[i : i + BLOCK]])) for i in range(0, len(found), BLOCK)]
        columns = [batch.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(parts))], names=[f"c{i}" for i in range(len(keep) + 1)])

    source = source.toDF(*[f"c{i}" for i in range(len(keep))], "_scored_text")
    schema = ", ".join(f"c{i} {t.dataType.simpleString()}" for i, t in enumerate(source.schema.fields[:-1]))
    return arrow_map(source, each, f"{schema}, c{len(keep)} double").toDF(*keep, "score")


def held_out() -> Column:
    """True where crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, prediction and fold of every document; labels of the held-out fold are never read."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    names = docs.columns
    scored = score(docs, fit(docs, labels.where(~held_out())), names)
    return scored.toDF(*names, "_quality_score").where(F.col("_quality_score") >= threshold).select(*[F.col(f"`{n}`") for n in names])
