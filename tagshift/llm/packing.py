"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are its text's, then an end mark. Whole windows of ``capacity`` ids are cut off
first and stand alone; what remains of each document is cut into pieces of at most ``max_piece``,
since windows of few large pieces cannot be evened out. Each task gathers about ``CHUNK`` pieces (their lengths and check sums, not their ids) and deals them over windows:
every piece starts as a partition with one filled window, and the two partitions of greatest spread
are merged again and again, the fullest windows of one with the emptiest of the other, until one is
left. If its fullest window is over the capacity, the count of windows rises and the chunk is
dealt anew. Windows are near-equal, so the padding is spread evenly.

No shuffle is needed: pieces are packed with those of the same input split. Memory is bounded by
the chunk and one batch of texts, for any input.

Defined cases: a null or empty text is one piece that holds only the end mark. A document of any
length is cut into as many windows as it needs. Equal lengths are taken in input order. Repeated
rows are packed each by itself. An empty table gives no pieces. The result does not depend on
other columns of the input. Sequence numbers tell the split and the window in it; a lost task that
reads the same split again gives the same rows, so the input should be a table (the pipeline's are).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import documents, query
from tagshift.llm.tokens import word_ids

TOKENIZER, CAPACITY, END_MARK, MAX_PIECE, CHUNK = "word_bpe_49k.json", 2048, 1, 512, 1024
#: bytes of text whose words are looked up together
GROUP = 4_000_000
_SPLIT_BITS = 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each of ``sizes``; the windows get near-equal sums."""
    first = np.zeros((len(sizes), windows), np.int32)
    first[:, 0] = sizes
    heap = [(-size, i, sums) for i, (size, sums) in enumerate(zip(sizes, first))]
    heapq.heapify(heap)
    merged = []  # (one, other, order): window j of the merged partition joins order[j] of one and its mirror image of the other
    while len(heap) > 1:
        _, a, sums_a = heapq.heappop(heap)
        _, b, sums_b = heapq.heappop(heap)
        sums = sums_a + sums_b[::-1]  # both fall: the fullest meets the emptiest
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), len(sizes) + len(merged), sums))
        merged.append((a, b, order))
    place = {len(sizes) + len(merged) - 1: np.arange(windows)}
    for node in range(len(merged) - 1, -1, -1):
        a, b, order = merged[node]
        of_a = np.empty(windows, np.int64)
        of_a[order] = place.pop(len(sizes) + node)
        place[a], place[b] = of_a, of_a[::-1]
    return np.array([place[i][0] for i in range(len(sizes))], np.int64)


def deal(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each of ``sizes``, none over ``capacity``; the count of windows rises until that holds."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        at = difference(sizes, windows)
        over = np.maximum(np.bincount(at, sizes, windows) - capacity, 0).sum()
        if not over:
            return at
        windows += max(1, int(over) // capacity)


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_mark: int = END_MARK,
    max_piece: int = MAX_PIECE, chunk: int = CHUNK, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece; ``with_ids`` adds its ids as unsigned 32-bit numbers, for writing sequences."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        end, first = end_mark.to_bytes(4, "little"), TaskContext.get().partitionId() << _SPLIT_BITS
        done, rest, opened = [], [], 0
        columns = list(zip(*[iter(SCHEMA.replace(",", "").split())] * 2))
        schema = pa.schema([(n, pa.int64()) for n, _ in columns] + [("ids", pa.binary())] * with_ids)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), schema)], schema=schema)

        def split(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
            """(document, its ids), for the texts of about ``GROUP`` bytes at a time."""
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // GROUP
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                ids, n = known.of_texts(batch.column(1).slice(a, b - a))
                stops = np.cumsum(n).tolist()
                for doc, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), [0, *stops], stops):
                    yield doc, ids[i:j].tobytes() + end

        def settle() -> None:
            nonlocal opened
            if not rest:
                return
            offsets, numbers = {}, {}
            for p, w in zip(rest, deal([p[2] for p in rest], capacity).tolist()):
                number, offset = numbers.setdefault(w, len(numbers)), offsets.get(w, 0)
                done.append((*p[:5], first + opened + number, offset, *p[5:]))
                offsets[w] = offset + p[2]
            opened += len(numbers)
            rest.clear()

        for batch in batches:
            for doc, ids in split(batch):
                n, start = len(ids) // 4, 0
                while start < n:
                    length = capacity if n - start >= capacity else min(max_piece, n - start)
                    part = ids[4 * start : 4 * (start + length)]
                    piece = (doc, start, length, zlib.crc32(part), n)
                    more = (part,) if with_ids else ()
                    if length == capacity:
                        done.append((*piece, first + opened, 0, *more))
                        opened += 1
                    else:
                        rest.append((*piece, *more))
                    start += length
                if len(rest) >= chunk:
                    settle()
                if len(done) >= chunk:
                    yield table(done)
                    done.clear()
        settle()
        if done:
            yield table(done)

    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
