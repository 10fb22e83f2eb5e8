"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte trigrams, hashed to ``TERMS`` columns, and one column for words that
repeat the word before them. Square roots of the counts, weighted by inverse document frequency and
scaled to length one, are projected on the leading ``AXES`` right singular vectors of the labelled
sample. For every document the cosines with all labelled vectors are computed exactly, in blocks;
its ``NEIGHBOURS`` nearest vote for their labels with weight cosine ** ``SHARPNESS``. The score is
the share of the votes for label 1.

Only what is fitted is bounded: of each label about ``SAMPLE`` rows are taken by a hash of their id
(all if there are fewer). Their vectors, at most a few thousand of ``AXES`` numbers, and the
projection are all that is broadcast. Every document is scored by its whole text, where it is read.

Defined cases: null and empty texts have no terms; their vector is zero, every neighbour is equally
far, and the score is the sample's share of label 1. Without labelled rows every score is 0.5. If
labels repeat, each labelled row votes. Equal cosines are taken in the order of the labelled rows
(by id). Repeated documents get equal scores, one row each. Other columns are no input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import documents, query
from tagshift.llm.textvec import joined, pieces, span_hashes, word_spans

TERMS, AXES, NEIGHBOURS, SHARPNESS, SAMPLE = 2048, 48, 15, 8, 1500
#: weight of one repeated word against one trigram
REPEAT_WEIGHT = 8.0
THRESHOLD = 0.7
_BLOCK = 256


def fold(key: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def sampled(labels: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """(key, label) of about ``per_label`` rows of each label, chosen by a hash of the key."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("int").alias(label))
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("n_of"))
    slots = 1 << 20
    return known.join(F.broadcast(counts), label).where(
        F.pmod(F.xxhash64(key), F.lit(slots)) * F.col("n_of") < slots * per_label).select(key, label)


def term_counts(bodies: list[bytes]) -> np.ndarray:
    """Texts x (TERMS + 1): counts of hashed trigrams, then of words equal to the word before."""
    data, starts = joined(bodies)
    n = len(bodies)
    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(data))))
    out = np.zeros((n, TERMS + 1), np.float32)
    if len(data) > 2:
        x = data.astype(np.uint32)
        code = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        inside = owner[:-2] == owner[2:]
        at = owner[:-2][inside] * TERMS + code[inside].astype(np.int64)
        out[:, :TERMS] = np.bincount(at, minlength=n * TERMS).reshape(n, TERMS)
    is_word = np.ones(256, bool)
    is_word[[9, 10, 11, 12, 13, 32]] = False
    a, b = word_spans(data, is_word)
    if len(a) > 1:
        h = span_hashes(data, a, b)
        again = (h[1:] == h[:-1]) & (owner[a[1:]] == owner[a[:-1]])
        out[:, TERMS] = np.bincount(owner[a[1:]][again], minlength=n) * REPEAT_WEIGHT
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def _vectors(texts: list[str | None], idf: np.ndarray, axes: np.ndarray) -> Iterator[np.ndarray]:
    for _, bodies in pieces(texts):
        for i in range(0, len(bodies), _BLOCK):
            yield _unit(_unit(np.sqrt(term_counts(bodies[i : i + _BLOCK])) * idf) @ axes)


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """Inverse document frequencies, axes, and vectors and labels of the labelled sample."""
    picked = F.broadcast(sampled(labels, label, key, sample))  # about ``sample`` ids of each label
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text")).join(picked, key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for _, bodies in pieces(batch.column(1).to_pylist()):
                for i in range(0, len(bodies), _BLOCK):
                    held += [x.astype(np.uint16).tobytes() for x in np.minimum(term_counts(bodies[i : i + _BLOCK]), 65535)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, pa.binary())], ["id", "label", "counts"])

    got = rows.select(F.col(key).cast("long").alias("id"), "text", label).mapInArrow(count, "id long, label int, counts binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("counts", "ascending")])
    n = got.num_rows
    if not n:
        return {"idf": np.ones(TERMS + 1, np.float32), "axes": np.zeros((TERMS + 1, 1), np.float32), "vectors": np.zeros((1, 1), np.float32), "labels": np.array([0.5], np.float32)}
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.uint16).reshape(n, TERMS + 1).astype(np.float32)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = _unit(np.sqrt(counts) * idf)
    _, turned = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(turned[:, ::-1][:, :AXES]).astype(np.float32)
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes), "labels": got.column("label").to_numpy().astype(np.float32)}


def vote(vectors: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors of each vector, weighted by cosine."""
    cosines = vectors @ model["vectors"].T
    k = min(neighbours, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < cosines.shape[1] else np.tile(np.arange(k), (len(vectors), 1))
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0.0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    base = float(model["labels"].mean())
    return np.where(total > 0, (weight * model["labels"][near]).sum(1) / np.where(total > 0, total, 1), base)


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [vote(v, m) for v in _vectors(batch.column(1).to_pylist(), m["idf"], m["axes"])]
            scores = np.clip(np.concatenate(found), 0, 1) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
                   label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted); labels are learnt only from rows that are not held out."""
    model = fit(docs, labels.where(~held_out), label, key, text)
    scored = score(docs, model, key, text)
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op2_quality_knn")
def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir), labels, F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
