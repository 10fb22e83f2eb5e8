"""Line dedup: a suffix array over sequences of line ids, built by distributed prefix doubling.

Lines get ids, and lines that occur once are dropped: no repeated run can hold one. Round k orders
all suffixes by their first 2^k lines: a suffix's rank is the place of its pair of ranks (at its
start, and 2^(k-1) lines on) among all pairs, found by a range sort. Suffixes whose rank is theirs
alone share no run of that length and leave; the others go on to the next round. A run of
``min_words`` words has at most ``min_words`` lines with a word, so the number of rounds is bounded.

Suffixes that share their first L lines are an LCP interval of the array; with 2^k <= L < 2^(k+1) it
is named by the ranks of round k at the start and at L - 2^k lines on. For every line the shortest
runs of ``min_words`` words that begin with it and that end with it are looked up. In each interval
the first copy, by (document, line), stays and all later ones are marked. The marked lines are
exactly those in maximal repeated runs of at least ``min_words`` words with an earlier copy: in such a
run each line lies in a shortest run that begins or ends with it, or in the one that begins the run.

No group is gathered: first copies come from sums that combine before the shuffle, ranks go back to
the rows by joins with one row for each class on one side, and positions join by (document, line).

Defined cases: documents are ordered by id (null first), then by a hash of the text. Rows with the
same id and text are one document and get equal results, one row each; a copy under another id is
a later copy. A null text stays null, an empty one empty. Lines without a word take no part; they go
with the line above. A document whose lines are all later copies keeps an empty text; the
pipeline drops it. Lines are compared by a 128-bit hash. Columns of the input are carried along;
those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.llm.base import documents, query
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize

MIN_WORDS = 50
_LINES = "doc_id long, mark long, line int, h1 long, h2 long, ahead int, back int"


def shortest_runs(n_words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines in the shortest run of ``min_words`` words that begins, and that ends, with each line; 0 if none."""
    before = np.concatenate([[0], np.cumsum(n_words)])
    lines = np.arange(len(n_words))
    end = np.searchsorted(before, before[:-1] + min_words)
    ahead = np.where(end <= len(n_words), end - lines, 0)
    begin = np.searchsorted(before, before[1:] - min_words, "right") - 1
    return ahead, np.where(begin >= 0, lines - begin + 1, 0)


def _split(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = text.as_py()
                held = [(x, n) for x in body.encode().split(b"\n") if (n := len(x.split()))] if body else []
                if not held:
                    continue
                ahead, back = shortest_runs(np.array([n for _, n in held]), min_words)
                ids = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x, _ in held), "<i8").reshape(-1, 2)
                for column, values in zip(out, ([doc] * len(held), [mark] * len(held), range(len(held)), ids[:, 0], ids[:, 1], ahead, back)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2)],
                ["doc_id", "mark", "line", "h1", "h2", "ahead", "back"])

    return run


def _named(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the rank of each row's ``by``; rows whose ``by`` is theirs alone are left out."""
    classes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    ranks = ordered_scan(classes, by)
    return materialize(rows.join(ranks, by).select(*keep, "rank"), "ranks")


def _at(table: DataFrame, name: str, shift: Column | int = 0) -> DataFrame:
    return table.select("doc_id", "mark", (F.col("line") - shift).alias("line"), F.col("rank").alias(name))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, line, length): runs of lines with a word that are later copies; ``docs`` has (doc_id, mark, text)."""
    place = ["doc_id", "mark", "line"]
    lines = docs.mapInArrow(_split(min_words), _LINES).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    lines = materialize(lines, "lines")
    # rows with the same id and text are one document
    active = _named(lines.dropDuplicates(place), ["h1", "h2"], [*place, "ahead", "back"])
    runs = active.where("ahead > 0").select("doc_id", "mark", "line", F.col("ahead").alias("length")).unionByName(
        active.where("back > 0").select("doc_id", "mark", (F.col("line") - F.col("back") + 1).cast("int").alias("line"), F.col("back").alias("length"))).distinct()
    runs = materialize(runs, "runs")

    found, ranks, size = [], active.select(*place, "rank"), 1
    while True:
        here = runs.where((F.col("length") >= size) & (F.col("length") < 2 * size))
        both = here.join(_at(ranks, "first"), place).withColumn("start", F.col("line")).withColumn(
            "line", (F.col("line") + F.col("length") - size).cast("int")).join(_at(ranks, "second"), place)
        both = both.select("doc_id", "mark", F.col("start").alias("line"), "length", "first", "second")
        key, copy = ["length", "first", "second"], F.struct("doc_id", "mark", "line")
        both = materialize(both, "windows")
        # written, so that the join deals both sides anew and Spark can split a hot interval
        firsts = materialize(both.groupBy(*key).agg(F.min(copy).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
        found.append(materialize(both.join(firsts, key).where(copy != F.col("earliest")).select(*place, "length"), "copies"))
        size *= 2
        if size > min_words:
            break
        longer = runs.where(F.col("length") >= size)
        if longer.isEmpty() or ranks.isEmpty():
            break
        pairs = ranks.join(_at(ranks, "next", size // 2), place)
        ranks = _named(pairs.withColumnRenamed("rank", "here"), ["here", "next"], place)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _without(text: str, runs: list) -> tuple[str, int, int, int]:
    """(text without the lines of the runs, its lines with a word, lines deleted, words deleted)."""
    lines = text.split("\n")
    words = [len(x.encode().split()) for x in lines]
    n = sum(w > 0 for w in words)
    steps = np.zeros(n + 1, np.int64)
    for start, length in runs:
        steps[start] += 1
        steps[start + length] -= 1
    gone = (np.cumsum(steps) > 0).tolist()
    kept, at, away, lost, lost_words = [], -1, False, 0, 0
    for line, w in zip(lines, words):
        if w:
            at += 1
            away = gone[at]
            lost += away
            lost_words += w * away
        if not away:
            kept.append(line)
    return "\n".join(kept), n, lost, lost_words


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``clean_text``, ``n_lines``, ``n_deleted`` and ``n_deleted_words``."""
    made = ["clean_text", "n_lines", "n_deleted", "n_deleted_words"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = repeated_runs(rows.select("doc_id", "mark", "text"), min_words)
    # one row for each document, no longer than its own lines
    spans = runs.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("line", "length")).alias("runs"))
    joined = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(spans, ["doc_id", "mark"], "left").select("row", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, 0, 0, 0) if t is None else _without(t, [(x["line"], x["length"]) for x in r or []])
                    for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate([pa.string(), pa.int64(), pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *made])

    schema = T.StructType([joined.schema["row"], T.StructField(made[0], T.StringType()), *[T.StructField(c, T.LongType()) for c in made[1:]]])
    return joined.mapInArrow(cut, schema).select("row.*", *made)


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_deleted", "n_deleted_words", F.length("clean_text").cast("long").alias("clean_chars"), F.md5("clean_text").alias("clean_md5"))
