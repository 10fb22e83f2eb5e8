"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows are documents with different n-gram sets (equal sets are one row), columns are n-grams, that is
hashes. Two sets of sizes a and b that reach the similarity share at least o = ceil(t (a + b) / (1 + t))
n-grams, so at most a + b - 2 o n-grams are in one of them only. The hash space is cut into more blocks
of columns than that, so some block is the same in both rows; only rows that are the same in a block
are multiplied there, and these products name the candidate pairs. How many blocks there are follows from
the sizes: a window holds the sizes from one step to the next and what is similar above; sets meet in the
window of the smaller one.

A block is good for a row that holds at least ``_least`` n-grams of it. A row that may differ from others
in d n-grams stands in its first d + 1 good blocks: of these at most d differ, so one is the same, and good, in
the other row, which stands there too. A row that lacks so many good blocks stands in all of its window. What two unrelated
rows share by chance is thus several n-grams and nothing beside them in a block, not one n-gram.

The rest of the product is bounded before it is computed. A row carries check sums of a finer cut of the hash
space. Blocks whose sums differ hold at least one n-gram
that is not shared, so a pair with more of them than a + b - 2 o is discarded; so is one of sizes too
far apart. ``MINI`` coarse blocks come first, then about one for each two n-grams of the row. For the
pairs that stay the overlap is counted in full, on both texts.

Links are only needed between rows that are not connected yet. First each entry of a block's content (called a column below) meets
the next ``NEAR`` of its column in one of ``ORDERS`` orders, the same in many columns, so that a row meets few others however many columns they
share; what the bounds leave connects families. Columns that still hold several families are multiplied in tiles of ``TILE`` x ``TILE`` rows without
the pairs inside a family. A tile takes the fine bounds itself (up to ``FINE`` check sums of a row), so what they discard is never a row. A first
round names ``FIRST`` pairs of each row, which connects what belongs together; the second names all that are left.
All these pairs are counted; a family that falls apart is multiplied again, within itself.
A family of copies with small changes is thus joined by a few products for each row instead of all
pairs, and no link between different components is lost.

No column is gathered: entries are numbered by a range-sorted scan and meet by (column, number);
tiles are bounded. Sets of exact copies meet only once.

Defined cases: a null text has no words; a document without words has an empty set and is linked
with nothing, also not with another empty one. With fewer words than ``size`` the whole sequence is
one n-gram. Rows with equal sets are linked, whatever their ids; rows with the same id are separate
documents. A null id is no component id unless the component has no other. N-grams and sets are
compared by 64-bit hashes. Other columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import documents, query
from tagshift.llm.components import components
from tagshift.llm.textvec import joined, mixed, pieces, span_hashes, word_spans
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize

SIZE, PERCENT = 3, 90
MINI, NEAR, TILE = 64, 6, 512
#: orders in which the rows of a column meet their next; most check sums of a row of a tile; pairs of a row in a first tiling
ORDERS, FINE, FIRST = 2, 1 << 14, 2
#: bits that mark what a join asks for
BITS = 25
#: sizes of a window grow by a tenth up to this, then by the factor STEP
SMALL, STEP = 64, 2
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, is_word = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    lower[65:91] += 32
    is_word[[9, 10, 11, 12, 13, 32]] = False
    return lower, is_word


def ngram_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted different n-grams of each text, as 64-bit hashes."""
    lower, is_word = _tables()
    for _, bodies in pieces(texts):
        data, starts = joined(bodies)
        data = lower[data]
        a, b = word_spans(data, is_word)
        h = span_hashes(data, a, b)
        cut = np.searchsorted(a, np.append(starts, len(data)))
        for i in range(len(bodies)):
            w = h[cut[i] : cut[i + 1]]
            n = max(1, len(w) - size + 1) if len(w) else 0
            grams = np.full(n, np.uint64(min(size, len(w))), np.uint64)
            for k in range(min(size, len(w))):
                grams += mixed(w[k : k + n] * _FACTORS[k % len(_FACTORS)] + np.uint64(k))
            yield np.unique(mixed(grams))


def _set_id(grams: np.ndarray) -> int:
    """64-bit hash of a set."""
    if not len(grams):
        return 0
    total = np.array([grams.sum(dtype=np.uint64), np.bitwise_xor.reduce(grams), np.uint64(len(grams))], np.uint64)
    h = mixed(total * np.array(_FACTORS[:3], np.uint64))
    return int(mixed(h[:1] * _FACTORS[3] + h[1:2] * _FACTORS[4] + h[2:])[0].astype(np.int64))


def _check_sums(grams: np.ndarray, bits: int) -> np.ndarray:
    """Check sums, modulo 256, of 2 ** bits blocks of the hash space."""
    sums = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), ((grams >> np.uint64(8)) & np.uint64(255)).astype(np.float64), 1 << bits)
    return (sums.astype(np.int64) & 255).astype(np.uint8)


def _folded(sums: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``size`` coarser blocks."""
    return sums.reshape(size, -1).sum(1, dtype=np.uint64).astype(np.uint8)


def _required(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _sets_of(rows: DataFrame, size: int, columns: str, make) -> DataFrame:
    """mapInArrow over (keys..., text): ``make`` gets the key columns and the sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch, ngram_sets(batch.column(batch.num_columns - 1).to_pylist(), size))

    return rows.mapInArrow(run, columns)


def _differing(total: int, percent: int) -> int:
    """Most n-grams that are in one only of two similar sets whose sizes add up to ``total``, or of smaller ones."""
    return total * (100 - percent) // (100 + percent)


def _least(percent: int) -> int:
    """N-grams of a good block; a window's largest sets hold (100 + percent) / (200 - 2 percent) a block."""
    return max(1, min(4, 9 * (100 + percent) // (40 * max(1, 100 - percent))))


def _windows(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(window, its blocks, blocks that a set of ``n`` n-grams stands in) where a similar set can differ."""
    out, first = [], 1
    while first <= n:
        last = first + max(1, first // 10) - 1 if first < SMALL else STEP * first - 1
        top = 100 * last // percent
        if n <= top:
            most = _differing(last + top, percent)
            own = _differing(n + (100 * n // percent if n <= last else last), percent)
            if own:
                # some more than needed, as some are not good
                out.append((first, int((most + 1) * (1 + 2.4 * (100 - percent) / (100 + percent))), own + 1))
        first = last + 1
    return out


def _blocks(grams: np.ndarray, windows: list[tuple[int, int, int]], least: int) -> np.ndarray:
    """Hashes of the contents of the blocks that a set stands in."""
    out = [np.zeros(0, np.uint64)]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)])
    for window, blocks, own in windows:
        number = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        edge = np.searchsorted(number, np.arange(blocks + 1, dtype=np.uint64))
        held = np.diff(edge)
        at = np.flatnonzero(held >= least)[:own]
        if len(at) < own:
            at = np.arange(blocks)
        place = mixed((at.astype(np.uint64) + np.uint64(1)) * _FACTORS[5] + np.uint64(window))
        content = mixed((upto[edge[at + 1]] - upto[edge[at]]) * _FACTORS[4] + held[at].astype(np.uint64))
        out.append(mixed(content * _FACTORS[3] + place))
    return np.concatenate(out)


def _light(percent: int):
    def make(batch: pa.RecordBatch, sets: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        least, windows = _least(percent), cache(lambda n: _windows(n, percent))
        ids, sizes, mini, sums, fine, columns = [], [], [], [], [], []
        for s in sets:
            own = _check_sums(s, max(6, (len(s) // 2).bit_length()))
            ids.append(_set_id(s))
            sizes.append(len(s))
            mini.append(_folded(own, MINI).tobytes())
            sums.append(own.tobytes())
            fine.append(_folded(own, FINE).tobytes() if len(own) > FINE else None)
            columns.append(_blocks(s, windows(len(s)), least).astype(np.int64))
        ends = np.cumsum([0] + [len(c) for c in columns])
        columns = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(columns) if columns else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(mini, pa.binary()), pa.array(sums, pa.binary()), pa.array(fine, pa.binary()), columns],
            ["doc_id", "mark", "set_id", "n", "mini", "sums", "fine", "columns"])

    return make


def _bounded(percent: int):
    """Pairs (a, b, n_a, n_b, sums_a, sums_b) that the bounds leave, with ``apart``, the blocks that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (2, 3))
            need = _required(a, b, percent)
            apart = np.zeros(len(a), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(z.as_buffer(), np.uint8) for z in (x, y))
                size = min(len(x), len(y))
                apart[i] = np.count_nonzero(_folded(x, size) != _folded(y, size))
            keep = pa.array((need <= np.minimum(a, b)) & (apart <= a + b - 2 * need))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(apart).filter(keep)], ["a", "b", "apart"])

    return run


def _tile(percent: int, most: int | None):
    """Pairs of a tile that lie in one family but in different components, and that the bounds leave; of each row the first ``most``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, ids, n, label, family = (table.column(c).to_numpy() for c in ("block", "set_id", "n", "label", "family"))
        bodies = [np.frombuffer(x, np.uint8) for x in table.column("fine").to_pylist()]
        held = np.array([len(x) for x in bodies])
        mini = np.stack([_folded(x, MINI) for x in bodies])
        # rows compare at the size of the shorter one's check sums
        sizes = np.unique(held)
        sums = [np.stack([_folded(x, size) if len(x) >= size else np.zeros(size, np.uint8) for x in bodies]) for size in sizes.tolist()]
        low = block == block.min()
        one = bool(low.all())
        right = np.flatnonzero(low if one else ~low)
        got_a, got_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(low).tolist():
            need = _required(n[i], n[right], percent)
            ok = (label[right] != label[i]) & (family[right] == family[i]) & (need <= np.minimum(n[i], n[right]))
            if one:
                ok &= right > i
            j, apart = right[ok], (n[i] + n[right] - 2 * need)[ok]
            if len(j):
                near = (mini[j] != mini[i]).sum(1) <= apart
                j, apart = j[near], apart[near]
            if len(j):
                shorter = np.minimum(held[j], held[i])
                near = np.zeros(len(j), bool)
                for size, of in zip(sizes.tolist(), sums):
                    at = np.flatnonzero(shorter == size)
                    if len(at):
                        near[at] = (of[j[at]] != of[i]).sum(1) <= apart[at]
                j = j[near][:most]
            got_a.append(np.minimum(ids[i], ids[j]))
            got_b.append(np.maximum(ids[i], ids[j]))
        return pa.table({"a": pa.array(np.concatenate(got_a), pa.int64()), "b": pa.array(np.concatenate(got_b), pa.int64())})

    return run


def _counted(size: int, percent: int):
    """Pairs whose full overlap, counted on both texts, reaches the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 64):
                sides = [ngram_sets(batch.column(c).slice(i, 64).to_pylist(), size) for c in (2, 3)]
                for a, b in zip(*sides):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Columns of both sets of each pair."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])


def _fine(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that the fine bounds leave."""
    return materialize(_with(pairs, sets, "n", "sums").mapInArrow(_bounded(percent), "a long, b long, apart long"), "pairs")


def _left(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Different pairs that the coarse and then the fine bounds leave."""
    coarse = _with(pairs, sets, "n", "mini").mapInArrow(_bounded(percent), "a long, b long, apart long").select("a", "b")
    return _fine(coarse, sets, percent)


def _tiled(wide: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Different pairs of one family and different components in the columns of ``wide`` (gram, set_id, n, rank, n_in, label, family).

    The bounds are taken inside a tile, so that what is far apart never becomes a row.
    """
    several = wide.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gram")
    block = F.floor(F.col("rank") / TILE).cast("int")
    last = F.floor((F.col("n_in") - 1) / TILE).cast("int")
    tiled = wide.join(several, "gram").join(sets.select("set_id", F.coalesce("fine", "sums").alias("fine")), "set_id").select(
        "gram", "set_id", "n", "fine", "label", "family", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    tiled = tiled.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return _fine(tiled.groupBy("gram", "low", "high").applyInArrow(_tile(percent, most), "a long, b long").distinct(), sets, percent)


def _labels(links: DataFrame) -> DataFrame:
    return materialize(components(links).withColumnRenamed("node", "set_id"), "labels")


def _thinned(rows: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """``rows`` without most of those whose hash ``key`` is not among ``of``, so that the join after it deals little.

    The hashes are marked in 2 ** BITS bits, whatever their number: at most 4 MB to broadcast.
    """
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << BITS) - 1))
    marked = wanted.select(place(of).alias("_p")).select(F.bitmap_bucket_number("_p").alias("_bucket"), F.bitmap_bit_position("_p").alias("_bit"))
    bits = marked.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    spread = rows.withColumn("_p", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_p")).withColumn("_bit", F.bitmap_bit_position("_p"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return spread.join(F.broadcast(bits), "_bucket").where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def connected(rows: DataFrame, light: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, label) of every linked set; links are exactly the pairs of the given similarity."""
    # dealt once by column, for the count and for what it leaves; columns of one row go
    dealt = light.where(F.size("columns") > 0).select(F.explode("columns").alias("gram"), "set_id").repartition("gram")
    often = dealt.groupBy("gram").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo != hi").select("gram")
    entries = dealt.join(often.hint("merge"), "gram").distinct()
    entries = materialize(entries.join(light.where("n > 0").select("set_id", "n").distinct(), "set_id").select("gram", "set_id", "n"), "entries")
    # written, so that the join deals both sides anew and Spark can split a hot column
    often = materialize(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n_in")), "columns")
    entries = entries.join(often, "gram").withColumn("turn", F.xxhash64(F.pmod("gram", F.lit(ORDERS)), "set_id"))
    entries = materialize(ordered_scan(entries, ["turn", "set_id"], by=["gram"]).select("gram", "set_id", "n", "rank", "n_in"), "entries")
    named = materialize(entries.select("set_id").distinct(), "named")
    sets = _thinned(light.drop("columns"), "set_id", named, "set_id").join(named, "set_id").groupBy("set_id").agg(F.min(F.struct("doc_id", "mark", "n", "mini", "sums", "fine")).alias("of"))
    sets = materialize(sets.select("set_id", "of.*"), "sets")

    # each entry and the next few of its column, if their sizes allow
    ahead = entries.select("gram", F.col("set_id").alias("x"), F.col("n").alias("n_x"), F.explode(F.array(*[F.col("rank") + k for k in range(1, NEAR + 1)])).alias("rank"))
    near = ahead.join(entries.select("gram", "rank", F.col("set_id").alias("y"), F.col("n").alias("n_y")), ["gram", "rank"]).where(
        100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = _left(near, sets, percent)
    # what the first step did not cover; first a few pairs of each row, as families that are one after all have many
    open_ = materialize(entries.where(F.col("n_in") > NEAR + 1), "open")

    def wide(labels: DataFrame) -> DataFrame:
        of = open_.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        return materialize(of.withColumn("family", F.lit(0).cast("long")), "wide")

    pairs = near.unionByName(_tiled(wide(_labels(near)), sets, percent, FIRST)).select("a", "b").distinct()
    presumed = _labels(pairs)
    pairs = materialize(pairs.unionByName(_tiled(wide(presumed), sets, percent).select("a", "b")), "pairs")

    # one text for each set that is in a pair; what later steps count is between these
    wanted = sets.select("set_id", "doc_id", "mark").join(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id")
    wanted = materialize(wanted.withColumnsRenamed({"doc_id": "of_id", "mark": "of_mark"}), "wanted")
    some = _thinned(rows, "mark", wanted, "of_mark")
    held = some.join(wanted, some["doc_id"].eqNullSafe(wanted["of_id"]) & (some["mark"] == wanted["of_mark"])).select("set_id", "text").dropDuplicates(["set_id"])
    texts = materialize(held, "texts")

    def counted(of: DataFrame) -> DataFrame:
        return materialize(_with(of, texts, "text").mapInArrow(_counted(size, percent), "a long, b long"), "links")

    found = counted(pairs)
    labels = _labels(found)
    # sets that were presumed connected and are not: their other pairs were left out before
    apart = presumed.withColumnRenamed("label", "was").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    split = apart.groupBy("was").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("was")
    again = materialize(apart.join(split, "was").select("set_id", "was", "label"), "split")
    if again.isEmpty():
        return labels
    within = _tiled(materialize(open_.join(again.withColumnRenamed("was", "family"), "set_id"), "wide"), sets, percent)
    rest = within.join(pairs, ["a", "b"], "left_anti")
    return _labels(found.unionByName(counted(rest.select("a", "b"))))


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, stays), one row for each document.

    ``mark`` is a hash of the text; ``stays`` holds for the first document, by id and mark, of each component.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    light = materialize(_sets_of(rows, size, "doc_id long, mark long, set_id long, n long, mini binary, sums binary, fine binary, columns array<long>", _light(percent)), "light")
    labels = connected(rows, light, size, percent)
    placed = light.where("n > 0").select("doc_id", "mark", "set_id", "n").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    of = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "mark")).alias("first"))
    linked = placed.join(of, "label").select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", (F.struct("doc_id", "mark") == F.col("first")).alias("stays"))
    alone = light.where("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionByName(alone)


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).drop("mark", "stays")
