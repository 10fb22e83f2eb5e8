"""Toxicity by a counterfactual-regularised classifier.

A text's features are its different words and the first 4, 5 and 6 bytes of them, in lower case,
as 64-bit hashes. A logistic model with an L1 penalty is fitted to a labelled sample. In each
sentence that names a group, the identity term is swapped for its counterpart; the difference in
features between the sentence and its swapped form is kept, and the model pays for the square of the
score change over all these pairs. Terms that stand for a group then carry no weight of their own,
so neutral mentions are not taken for toxic ones.

Only what is fitted is bounded: about ``SAMPLE`` rows of each label, taken by a hash of their id from
the labelled texts of at most ``SAMPLE_BYTES`` bytes, and at most ``FEATURES`` features. The model
that is broadcast is a list of features with weight, of that size at most. Every document is scored
by its whole text, where it is read.

Defined cases: null and empty texts have no features and get the score of the intercept. Without
labelled rows of both labels every score is 0 (nothing was seen to be toxic). Repeated documents
get equal scores, one row each. Other columns are no input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import documents, query
from tagshift.llm.quality_knn import fold, sampled
from tagshift.llm.textvec import joined, pieces, prefix_hashes, span_hashes, word_spans

SAMPLE, SAMPLE_BYTES, FEATURES, MIN_DOCS = 3000, 65_536, 20_000, 4
L1, PAIR_PENALTY, STEPS = 4e-4, 10.0, 300
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
#: counterparts, each swapped for the other; a parameter of the operator
IDENTITY = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("muslim", "christian"), ("muslims", "christians"),
    ("jewish", "catholic"), ("jews", "catholics"), ("black", "white"), ("gay", "straight"), ("immigrants", "citizens"), ("immigrant", "citizen"),
    ("asian", "european"), ("frauen", "männer"), ("frau", "mann"), ("femmes", "hommes"), ("femme", "homme"), ("mujeres", "hombres"), ("mujer", "hombre"),
]
_SENTENCE = re.compile(r"[^.!?\n]+")


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and prefix; a text's repeated words are listed again."""
    data, starts = joined(bodies)
    a, b = word_spans(data, _letters())
    owner = np.searchsorted(starts, a, "right") - 1
    texts, keys = [owner], [span_hashes(data, a, b)]
    for n in PREFIXES:
        long = b - a >= n
        texts.append(owner[long])
        keys.append(prefix_hashes(data, a[long], n))
    return np.concatenate(texts), np.concatenate(keys)


def _lowered(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


def swapper(identity: list[tuple[str, str]]):
    """A function that gives a text's sentences with identity terms, each with its swapped form."""
    other = {a: b for p in identity for a, b in (p, p[::-1])}
    term = re.compile(r"\b(" + "|".join(map(re.escape, sorted(other, key=len, reverse=True))) + r")\b") if other else None

    def pairs(text: str) -> list[tuple[str, str]]:
        if term is None or not term.search(text):
            return []
        return [(s, term.sub(lambda m: other[m[0]], s)) for s in _SENTENCE.findall(text) if term.search(s)]

    return pairs


def _unique(bodies: list[bytes]) -> list[np.ndarray]:
    owner, keys = features(bodies)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    owner, keys = owner[new], keys[new]
    return np.split(keys, np.searchsorted(owner, np.arange(1, len(bodies))))


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
        sample: int = SAMPLE, identity: list[tuple[str, str]] = IDENTITY) -> dict:
    """Features with weight, sorted, their weights, the intercept, and the number of swapped pairs that were found."""
    picked = F.broadcast(sampled(labels, label, key, sample))  # about ``sample`` ids of each label
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text")).join(picked, key).where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    pairs_of = swapper(identity)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lowered(batch.column(1).to_pylist())
            held, swaps = [], []
            for first, bodies in pieces(texts):
                held += [k.tobytes() for k in _unique(bodies)]
                for t in texts[first : first + len(bodies)]:
                    found = [x.encode() for p in pairs_of(t) for x in p]
                    sets = _unique(found) if found else []
                    # of each pair the features lost and those gained
                    swaps.append([np.setdiff1d(sets[i + j], sets[i + 1 - j]).tobytes() for i in range(0, len(sets), 2) for j in (0, 1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(held, pa.binary()), pa.array(swaps, pa.list_(pa.binary()))], ["id", "label", "keys", "swaps"])

    got = rows.select(F.col(key).cast("long").alias("id"), "text", label).mapInArrow(read, "id long, label int, keys binary, swaps array<binary>").toArrow()
    got = got.sort_by([("id", "ascending"), ("keys", "ascending")])
    y = got.column("label").to_numpy().astype(np.float64) if got.num_rows else np.zeros(0)
    swaps = [np.frombuffer(k, np.uint64) for s in got.column("swaps").to_pylist() for k in s]
    if not 0 < y.sum() < len(y):
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -np.inf, "pairs": len(swaps) // 2}
    held = [np.frombuffer(k, np.uint64) for k in got.column("keys").to_pylist()]
    return _train(held, y, swaps) | {"pairs": len(swaps) // 2}


def _train(held: list[np.ndarray], y: np.ndarray, swaps: list[np.ndarray]) -> dict:
    row = np.repeat(np.arange(len(held)), [len(k) for k in held])
    keys, col = np.unique(np.concatenate(held), return_inverse=True)
    # the features whose shares in the two classes differ most
    seen, toxic = np.bincount(col, minlength=len(keys)), np.bincount(col, y[row], len(keys))
    apart = np.abs(toxic / y.sum() - (seen - toxic) / (len(y) - y.sum()))
    best = np.flatnonzero(seen >= min(MIN_DOCS, len(y) // 2))
    best = np.sort(best[np.argsort(-apart[best], kind="stable")[:FEATURES]])
    new = np.full(len(keys), -1)
    new[best] = np.arange(len(best))
    row, col = row[new[col] >= 0], new[col][new[col] >= 0]
    keys, n, m = keys[best], len(held), len(best)

    gone, moved, sign = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, k in enumerate(swaps):
        at = np.searchsorted(keys, k)
        known = (at < m) & (keys[np.minimum(at, m - 1)] == k) if m else np.zeros(len(k), bool)
        gone.append(np.full(known.sum(), i // 2))
        moved.append(at[known])
        sign.append(np.full(known.sum(), -1.0 if i % 2 else 1.0))
    pair, moved, sign, n_pairs = np.concatenate(gone), np.concatenate(moved), np.concatenate(sign), max(1, len(swaps) // 2)

    weigh = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -30, 30)))
        r = weigh * (p - y)
        change = np.bincount(pair, w[moved] * sign, n_pairs)
        return np.bincount(col, r[row], m) + 2 * PAIR_PENALTY / n_pairs * np.bincount(moved, change[pair] * sign, m), float(r.sum())

    # largest curvature by power iteration, then accelerated proximal steps
    v = np.ones(m) / max(1, np.sqrt(m))
    top = 1.0
    for _ in range(20):
        z = np.bincount(col, (0.25 * weigh * np.bincount(row, v[col], n))[row], m)
        z += 2 * PAIR_PENALTY / n_pairs * np.bincount(moved, np.bincount(pair, v[moved] * sign, n_pairs)[pair] * sign, m)
        top = float(np.linalg.norm(z)) or 1.0
        v = z / top
    step = 1 / (1.1 * top + 0.25)
    w = last = np.zeros(m)
    b = last_b = 0.0
    for k in range(STEPS):
        pull = k / (k + 3)
        u, c = w + pull * (w - last), b + pull * (b - last_b)
        g, gb = slope(u, c)
        last, last_b = w, b
        z = u - step * g
        w, b = np.sign(z) * np.maximum(np.abs(z) - step * L1, 0), c - step * gb
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return {"keys": keys[kept], "weights": w[kept], "bias": b}


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    keys, out = model["keys"], np.full(len(texts), model["bias"], np.float64)
    mask = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys & mask).astype(np.int64)] = True
    for first, bodies in pieces(_lowered(texts) if len(keys) else []):
        owner, found = features(bodies)
        near = maybe[(found & mask).astype(np.int64)]
        owner, found = owner[near], found[near]
        at = np.searchsorted(keys, found)
        known = keys[np.minimum(at, len(keys) - 1)] == found
        # each feature counts once in a text
        once = np.unique(owner[known] * len(keys) + np.minimum(at, len(keys) - 1)[known])
        out[first : first + len(bodies)] += np.bincount(once // len(keys), model["weights"][once % len(keys)], len(bodies))
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1).to_pylist(), shared.value), pa.float64())], [key, "score"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
                    label: str = "toxic", threshold: float = THRESHOLD, identity: list[tuple[str, str]] = IDENTITY) -> DataFrame:
    """(key, held_out, score, predicted); labels are learnt only from rows that are not held out."""
    model = fit(docs, labels.where(~held_out), label, key, text, identity=identity)
    return score(docs, model, key, text).select(
        key, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(documents(spark, sf_dir), labels, F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
