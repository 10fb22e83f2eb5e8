"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Items are cut into units of at most ``UNIT`` words. Each (word, unit) has a BM25 impact, divided by
the score that the unit gives itself, so a passage that holds the whole unit scores 1 whatever the
unit's length. Documents are read in blocks of ``UNIT`` words; two neighbouring blocks are a passage,
so every run of ``UNIT`` words lies in one.

Retrieval returns all units of at least ``THRESHOLD``, by block-max WAND. Postings are cut into
blocks of ``BLOCK`` units and each word has its largest impact in a block. With a fixed threshold
the pivot can be found beforehand: in each block, the words of least impact that together stay
below ``SKIP`` are skipped, and a passage reaches the threshold only if the block maxima of its
other words make up the rest. Passages and blocks that fail this bound are never scored; for the
others the exact scores follow. Nothing is cut off: the bound is never below the score.

A retrieved pair is verified in the words around the passage: five-word shingles of the item's
question (all but its last sentence) and the words of its answer (the last sentence, or the last
quarter of an item of one sentence) must be there to at least ``OVERLAP``.

Items are taken in parts of about ``PART_WORDS`` words, so the index that is broadcast is bounded
for any benchmark; frequencies are counted over all items. Documents are not shuffled.

Defined cases: null or empty items and items without a word match nothing; null or empty documents
hold no passage. A question of fewer than five words is one shingle. Repeated items are found
each; one (item_id) is listed once for a document, with its best score. Repeated documents get equal
results, one row each. Columns of the documents are carried along; ``leaks`` replaces one of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.llm.base import documents, query
from tagshift.llm.textvec import joined, pieces, span_hashes, word_spans
from tagshift.sources.store import materialize

UNIT, BLOCK, THRESHOLD, SKIP, OVERLAP, SHINGLE = 64, 2, 0.6, 0.3, 0.8, 5
K1, B = 1.2, 0.75
PART_WORDS = 1_000_000
_PASSAGES = 2048
LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))
_SENTENCE_END = re.compile(rb"[.!?](?=\s)")


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def impacts(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, body, part, unit, word, impact): BM25 impacts over all items, as shares of the unit's own score."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(
        F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("body")).distinct()
    words = F.filter(F.split(F.lower("body"), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")
    rows = materialize(rows.withColumn("words", words).where(F.size("words") > 0), "items")
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_WORDS))
    n_units = F.ceil(F.size("words") / F.lit(UNIT)).cast("long")
    each = rows.select("item_id", "body", F.pmod(F.xxhash64("item_id", "body"), F.lit(parts)).cast("int").alias("part"), F.size("words").alias("n"),
                       n_units.alias("n_units"), F.posexplode("words").alias("place", "word"))
    each = each.withColumn("unit", F.floor(F.col("place") * F.col("n_units") / F.col("n")).cast("int"))
    unit = ["item_id", "body", "part", "unit"]
    tf = each.groupBy(*unit, "word").agg(F.count(F.lit(1)).alias("tf"))
    length = tf.groupBy(*unit).agg(F.sum("tf").alias("length"))
    stats = length.agg(F.count(F.lit(1)).alias("n_all"), F.avg("length").alias("mean_length"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(length, unit).join(df, "word").join(F.broadcast(stats)).select(
        *unit, "word", (F.log(1 + (F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1)
                        / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))).alias("w"))
    own = weighed.groupBy(*unit).agg(F.sum("w").alias("own"))
    return materialize(weighed.join(own, unit).select(*unit, "word", (F.col("w") / F.col("own")).alias("impact")), "impacts")


def build(rows: list[tuple[int, str, int, str, float]], threshold: float = THRESHOLD, skip: float = SKIP, block: int = BLOCK) -> dict:
    """The index of one part from its (item_id, body, unit, word, impact)."""
    units = sorted({(r[0], r[1], r[2]) for r in rows})
    number = {u: i for i, u in enumerate(units)}
    vocabulary = sorted({r[3] for r in rows})
    hashes = _hashes([w.encode() for w in vocabulary])
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = {w: int(place[i]) for i, w in enumerate(vocabulary)}
    word = np.array([at[r[3]] for r in rows], np.int64)
    unit = np.array([number[r[0], r[1], r[2]] for r in rows], np.int64)
    impact = np.array([r[4] for r in rows])
    # block maxima, and in each block the words of least impact that may be skipped
    n_blocks = -(-len(units) // block)
    pair, inverse = np.unique(word * n_blocks + unit // block, return_inverse=True)
    top = np.zeros(len(pair))
    np.maximum.at(top, inverse, impact)
    in_block = pair % n_blocks
    by = np.lexsort((top, in_block))
    run = np.cumsum(top[by])
    first = np.searchsorted(in_block[by], np.arange(n_blocks))
    within = run - (run[first] - top[by][first])[in_block[by]]
    skipped = np.zeros(len(pair), bool)
    skipped[by] = within < skip
    left_out = np.bincount(in_block[skipped], top[skipped], n_blocks)
    need = np.maximum(threshold - left_out, 1e-9)
    essential = np.flatnonzero(~skipped)
    starts = np.searchsorted(pair[essential] // n_blocks, np.arange(len(vocabulary) + 1))
    by_unit = np.lexsort((word, unit))
    return {
        "hashes": hashes[order], "starts": starts, "block_of": in_block[essential], "top": top[essential], "need": need,
        "unit_starts": np.searchsorted(unit[by_unit], np.arange(len(units) + 1)), "unit_words": word[by_unit], "unit_impacts": impact[by_unit],
        "units": [(u[0], u[1]) for u in units], "block": block, "threshold": threshold,
    }


def _hashes(words: list[bytes]) -> np.ndarray:
    data, starts = joined(words)
    return span_hashes(data, starts, starts + np.array([len(w) for w in words]))


def retrieve(bodies: list[bytes], index: dict) -> list[tuple[int, int, int, float]]:
    """(text, passage, unit, score) of all passages and units of at least the threshold."""
    data, text_starts = joined(bodies)
    a, b = word_spans(data, _word_bytes())
    if not len(a):
        return []
    owner = np.searchsorted(text_starts, a, "right") - 1
    first_word = np.searchsorted(owner, np.arange(len(bodies)))
    block_in_text = (np.arange(len(a)) - first_word[owner]) // UNIT
    n_blocks = np.bincount(owner, minlength=len(bodies))
    n_blocks = -(-n_blocks // UNIT)
    base = np.concatenate([[0], np.cumsum(n_blocks + 1)])  # passage j of a text is its blocks j - 1 and j
    keys = index["hashes"]
    h = span_hashes(data, a, b)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    known = keys[at] == h
    block = (base[owner] + block_in_text)[known]
    held = np.unique(np.concatenate([block, block + 1]) * len(keys) + np.tile(at[known], 2))  # (passage, word), once
    passage, word = held // len(keys), held % len(keys)
    out = []
    n_units_blocks = len(index["need"])
    width = max(1, _PASSAGES * 256 // max(256, n_units_blocks))
    for lo in range(0, int(base[-1]), width):
        i, j = np.searchsorted(passage, [lo, lo + width])
        p, w = passage[i:j] - lo, word[i:j]
        count = index["starts"][w + 1] - index["starts"][w]
        post = np.repeat(index["starts"][w] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(w) else w, count) + np.arange(count.sum())
        bound = np.bincount(np.repeat(p, count) * n_units_blocks + index["block_of"][post], index["top"][post], width * n_units_blocks)
        hit = np.flatnonzero(bound.reshape(width, n_units_blocks) >= index["need"][None, :] - 1e-9)
        for one in hit.tolist():
            q, blk = one // n_units_blocks, one % n_units_blocks
            k, m = np.searchsorted(p, [q, q + 1])
            mine = w[k:m]
            for u in range(blk * index["block"], min((blk + 1) * index["block"], len(index["units"]))):
                s, e = index["unit_starts"][u], index["unit_starts"][u + 1]
                score = float(index["unit_impacts"][s:e][np.isin(index["unit_words"][s:e], mine, assume_unique=True)].sum())
                if score >= index["threshold"] - 1e-9:
                    text = int(np.searchsorted(base, q + lo, "right") - 1)
                    out.append((text, int(q + lo - base[text]), u, min(score, 1.0)))
    return out


def _words(body: bytes) -> list[bytes]:
    data = np.frombuffer(body + b"\n", np.uint8)
    a, b = word_spans(data, _word_bytes())
    return [body[i:j] for i, j in zip(a.tolist(), b.tolist())]


def question_and_answer(body: bytes) -> tuple[list[bytes], list[bytes]]:
    ends = [m.end() for m in _SENTENCE_END.finditer(body.rstrip())]
    if ends and (answer := _words(body[ends[-1] :])) and (question := _words(body[: ends[-1]])):
        return question, answer
    words = _words(body)
    cut = len(words) - max(1, len(words) // 4)
    return (words[:cut], words[cut:]) if cut else (words, words)


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def verify(item: bytes, around: list[bytes]) -> tuple[float, float]:
    """Shares of the item's question and of its answer in the words ``around`` a passage."""
    question, answer = question_and_answer(item)
    size = min(SHINGLE, len(question))
    there = {tuple(around[i : i + size]) for i in range(len(around) - size + 1)}
    asked, words = _shingles(question), set(around)
    return len(asked & there) / len(asked), sum(w in words for w in answer) / len(answer)


def leaks_of(texts: list[str | None], index: dict, overlap: float = OVERLAP) -> list[list[dict]]:
    out: list[dict[int, dict]] = [{} for _ in texts]
    lowered = [(t or "").lower() for t in texts]
    for first, bodies in pieces(lowered):
        words: dict[int, list[bytes]] = {}
        for text, passage, unit, score in retrieve(bodies, index):
            item_id, item = index["units"][unit]
            own = words.setdefault(text, _words(bodies[text]))
            item = item.lower().encode()
            reach = 2 * UNIT + len(item) // 2
            lo = max(0, (passage - 1) * UNIT - reach)
            q, a = verify(item, own[lo : (passage + 1) * UNIT + reach])
            best = out[first + text].get(item_id)
            if q >= overlap and a >= overlap and (best is None or (score, q, a) > (best["score"], best["question_overlap"], best["answer_overlap"])):
                out[first + text][item_id] = {"item_id": item_id, "score": score, "question_overlap": q, "answer_overlap": a}
    return [[x[k] for k in sorted(x)] for x in out]


def decontamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``leaks``, the benchmark items that each document holds."""
    spark = docs.sparkSession
    table = impacts(benchmark)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "leaks"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.array().cast(LEAKS).alias("leaks"))
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    for part in range(parts):
        got = table.where(F.col("part") == part).select("item_id", "body", "unit", "word", "impact").collect()  # a part is bounded
        if not got:
            continue
        shared = spark.sparkContext.broadcast(build([tuple(x) for x in got]))
        last = part == parts - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
            for batch in batches:
                found = leaks_of(batch.column(1).to_pylist(), shared.value)
                before = batch.column(2).to_pylist()
                leaks = pa.array([a + b for a, b in zip(before, found)], kind)
                columns = [batch.column(0), *([] if last else [batch.column(1)]), leaks]
                yield pa.RecordBatch.from_arrays(columns, ["row", *([] if last else ["text"]), "leaks"])

        out = T.StructType([rows.schema["row"], *([] if last else [rows.schema["text"]]), T.StructField("leaks", LEAKS)])
        rows = rows.mapInArrow(run, out)
    return rows.select("row.*", "leaks")


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination(documents(spark, sf_dir), benchmark, keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks"))
