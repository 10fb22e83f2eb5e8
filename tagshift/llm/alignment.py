"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often.

Documents are shuffled by their full text; each distinct text is tokenised and aligned once, and its
links count as often as the text occurs. Documents get their measures back by the text's SHA-256.

Tokenizer A is a byte-level BPE, B a sentencepiece BPE. Where one space stands between two characters that are no white space, both begin a
new token: A's pattern cuts there, and no piece of B holds its space mark behind another character (checked when B is loaded;
otherwise texts stay whole). So the texts of a chunk are cut there, their different words are encoded joined, and
byte offsets of token ends are compared for all of them at once. A text's tokens are those of its words.

A text's links are kept as (number of the pair in the chunk's list of different pairs, times). Only these lists, not the
links, are exploded, added up over the corpus and joined with the sums; every chunk then gets the counts of
its own pairs and scores its texts. A chunk ends after ``CHUNK`` characters of text, so lists, groups and memory
are bounded by that, or by one longer text. The one broadcast table has at most one row for each id of B.

Defined cases: texts that are null, empty, or whose joined bytes of either tokenizer differ from space + text
(as those that hold the character U+2581 itself) have no tokens: zeros, and '' as ``groups_sha256``. Strings of special tokens are
plain text. Repeated rows count as often as they occur and each gets its result; a null id stays null. Columns named
like a result are replaced, others are kept. Empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.llm.base import documents, query
from tagshift.llm.token_counts import _letters_of_bytes
from tagshift.llm.tokens import worker_store
from tagshift.sources.store import materialize

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: characters of text after which a chunk ends, and of joined words that are encoded at once
CHUNK, BLOCK = 16_000_000, 200_000
#: how byte-level files of this family cut texts (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_MARK = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_SPACE_PAIR, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Side:
    """A tokenizer as a function from text to ids, with the bytes of each id; A's texts get their leading space here, B's from the library."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def printed(self, end: str) -> np.ndarray:
        return np.array([f"{i}{end}".encode() for i in range(len(self.tokens))], object)


def byte_side(path: str) -> Side:
    """Ids of a byte-level BPE file. Its merges are proven to stand in the order of their ids, which are then ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, byte = whole["model"], _letters_of_bytes()
    vocab, special = model["vocab"], {t["content"] for t in whole["added_tokens"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    cut = whole["pre_tokenizer"] or {}
    if whole["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or made != sorted(made):
        raise ValueError(f"{path} is no byte-level BPE with the usual pattern and merges in the order of ids")
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    library = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    return Side(lambda text: library.encode_ordinary(" " + text), tokens)


def piece_side(path: str) -> tuple[Side, bool]:
    """Ids of a sentencepiece file, and whether no piece reaches over the beginning of a word."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]

    def of(i: int, piece: str) -> bytes:
        found = _BYTE_PIECE.fullmatch(piece) if library.is_byte(i) else None
        return bytes([int(found[1], 16)]) if found else piece.replace(SPACE_MARK, " ").encode()

    inside = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")
    return Side(lambda text: library.encode(text, num_threads=1), [of(i, p) for i, p in enumerate(pieces)]), not any(map(inside.search, pieces))


def cut(text: str) -> list[str]:
    """Words that stand between single spaces with no white space on either side."""
    if text[0].isspace() or text[-1].isspace() or _SPACE_PAIR.search(text):
        return _CUT.split(text)
    return text.split(" ")


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a = byte_side(a_path)
        self.b, self.separable = piece_side(b_path)
        self.a_more, self.a_last = self.a.printed(","), self.a.printed("|")
        self.b_more, self.b_last = self.b.printed(","), self.b.printed(";")

    def exact(self, joined: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides where their bytes are space + text."""
        raw, ids = b" " + joined.encode(), []
        for side in (self.a, self.b):
            own = side.encode(joined)
            if b"".join(map(side.tokens.__getitem__, own)) != raw:
                return None
            ids.append(np.array(own, np.int64))
        return ids[0], ids[1]

    def block(self, words: list[str]) -> tuple[list, list, list, list, np.ndarray] | None:
        """Of each word: A tokens, B tokens, links, printed groups; then all links in order. None where bytes differ."""
        ids = self.exact(" ".join(words))
        if ids is None:
            return None
        a, b = ids
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        marked = np.zeros(ends[-1] + 1, bool)
        marked[ends_a] = True
        last_b = np.flatnonzero(marked[ends_b])
        common = ends_b[last_b]
        last_a = np.searchsorted(ends_a, common)
        of_word = np.searchsorted(common, ends)
        if not (common[of_word] == ends).all():
            raise ValueError("a token reaches over the beginning of a word")
        upto_a, upto_b, upto = last_a[of_word] + 1, last_b[of_word] + 1, of_word + 1
        # tokens in printing order: A's of a group, then B's
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_b = np.concatenate([[0], last_b[:-1] + 1])
        printed = np.empty(len(a) + len(b), object)
        is_last = np.zeros(len(a), bool)
        is_last[last_a] = True
        printed[np.arange(len(a)) + first_b[group_a]] = np.where(is_last, self.a_last[a], self.a_more[a])
        is_last = np.zeros(len(b), bool)
        is_last[last_b] = True
        printed[np.arange(len(b)) + last_a[group_b] + 1] = np.where(is_last, self.b_last[b], self.b_more[b])
        texts, stops = printed.tolist(), (upto_a + upto_b).tolist()
        strings = [b"".join(texts[i:j]) for i, j in zip([0, *stops], stops)]
        per_word = [np.diff(x, prepend=0).tolist() for x in (upto_a, upto_b, upto)]
        return *per_word, strings, (a[last_a] << 32) | b[last_b]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
        """For different words: A tokens, B tokens, links, printed groups, whether bytes differ, and all links in order of words."""
        n = len(words)
        out = [np.zeros(n, np.int64) for _ in range(3)]
        strings, bad, links = [b""] * n, np.zeros(n, bool), [np.zeros(0, np.int64)] * n

        def fill(at: list[int]) -> None:
            made = self.block([words[i] for i in at])
            if made is None:
                if len(at) == 1:
                    bad[at[0]] = True
                    return
                # halved until the words whose bytes differ stand alone
                fill(at[: len(at) // 2])
                fill(at[len(at) // 2 :])
                return
            index = np.array(at)
            for own, new in zip(out, made):
                own[index] = new
            upto = np.cumsum(made[2])
            for i, s, lo, hi in zip(at, made[3], [0, *upto.tolist()], upto.tolist()):
                strings[i], links[i] = s, made[4][lo:hi]

        held: list[int] = []
        size = 0
        for i, w in enumerate(words):
            # words with white space at an end stand alone: next to another one they could be cut otherwise
            if not w or w[0].isspace() or w[-1].isspace():
                fill([i])
                continue
            held.append(i)
            size += len(w) + 1
            if size >= BLOCK:
                fill(held)
                held, size = [], 0
        if held:
            fill(held)
        return *out, strings, bad, np.concatenate(links) if n else np.zeros(0, np.int64)


def pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Rising codes as steps, and times, byte planes apart, compressed."""
    import zstandard

    table = np.vstack([np.diff(codes, prepend=0), times]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(2, 4, -1)
    table = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(table[0]), table[1]


def chunk_rows(aligner: Aligner, texts: list[str], copies: list[int], with_groups: bool) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Measures and packed links of each text; the chunk's different pairs and how often they are linked, copies counted."""
    import hashlib

    code: dict[str, int] = defaultdict(count().__next__)
    lists = [list(map(code.__getitem__, cut(t) if aligner.separable else [t])) for t in texts]
    n_a, n_b, n_links, strings, bad, links = aligner.words(list(code))
    first = np.cumsum(n_links) - n_links
    pairs, number = np.unique(links, return_inverse=True)
    totals = np.zeros(len(pairs), np.int64)
    rows = []
    for own, times_held in zip(lists, copies):
        w = np.array(own, np.int64)
        if bad[w].any():
            rows.append({"n_a": 0, "n_b": 0, "n_links": 0, "groups_sha256": "", "links": None, "groups": "" if with_groups else None})
            continue
        each = n_links[w]
        stop = np.cumsum(each)
        at = np.repeat(first[w] - (stop - each), each) + np.arange(stop[-1])
        codes, times = np.unique(number[at], return_counts=True)
        totals[codes] += times * times_held
        text = b"".join(map(strings.__getitem__, own))[:-1]
        rows.append({
            "n_a": int(n_a[w].sum()), "n_b": int(n_b[w].sum()), "n_links": int(stop[-1]),
            "groups_sha256": hashlib.sha256(text).hexdigest(), "links": pack(codes, times), "groups": text.decode() if with_groups else None,
        })
    kept = totals > 0
    if not kept.all():
        # pairs of words that only texts without tokens hold
        pairs, totals, new = pairs[kept], totals[kept], np.cumsum(kept) - 1
        for r in rows:
            if r["links"] is not None:
                codes, times = unpack(r["links"])
                r["links"] = pack(new[codes], times)
    return rows, pairs, totals


_ALIGNED = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("key", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_links")],
    T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("totals", T.ArrayType(T.LongType())),
])


def aligned_texts(texts: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """For (key, text, copies) a row for each text, and for each chunk one with its pairs and totals."""
    schema = pa.schema([
        *[(n, pa.int64() if n.startswith("n_") or n == "chunk" else pa.binary() if n == "links" else pa.string()) for n in _ALIGNED.fieldNames()[:-2]],
        ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_store(f"aligner:{a_path}:{b_path}", lambda: Aligner(a_path, b_path))
        task, number = TaskContext.get().partitionId(), 0
        keys, held, copies, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            chunk = (task << 32) + number
            rows, pairs, totals = chunk_rows(aligner, held, copies, with_groups)
            every = [r | {"chunk": chunk, "key": k} for r, k in zip(rows, keys)] + [{"chunk": chunk, "pairs": pairs, "totals": totals}]
            return pa.RecordBatch.from_pylist(every, schema)

        for batch in batches:
            for key, text, n in zip(*[batch.column(i) for i in range(3)]):
                keys.append(key.as_py())
                held.append(text.as_py())
                copies.append(n.as_py())
                size += len(held[-1])
                if size >= CHUNK:
                    yield done()
                    number += 1
                    keys, held, copies, size = [], [], [], 0
        if held:
            yield done()

    return texts.select("key", "text", "copies").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Corpus-wide links of each id pair, and whether no pair with the same B id has more: (pair, n, best)."""
    listed = aligned.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "totals")).alias("p"))
    counts = materialize(listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("n")), "pair_counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    # one row for each id of B that occurs
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the text rows, chunk by chunk."""
    texts = aligned.where(F.col("key").isNotNull()).select("chunk", "key", "links")
    own = aligned.where(F.col("pairs").isNotNull()).select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("code", "pair"))
    own = own.join(counts, "pair").select("of_chunk", "code", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("code").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sums, tops = [], []
        for packed in left.column("links"):
            codes, times = unpack(packed.as_py()) if packed.is_valid else (np.zeros(0, np.int64),) * 2
            sums.append(int((n[codes] * times).sum()))
            tops.append(int(times[best[codes]].sum()))
        return pa.table({"key": left.column("key"), "n_best": pa.array(tops, pa.int64()), "count_sum": pa.array(sums, pa.int64())})

    return texts.groupBy("chunk").cogroup(own.groupBy("of_chunk")).applyInArrow(run, "key string, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None, with_groups: bool = False) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``MEASURES``; ``with_groups`` adds the printed groups as ``groups``."""
    made = (*MEASURES, *["groups"] * with_groups)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    body = F.col(f"`{text}`").cast("string")
    texts = docs.select(body.alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    # a chunk lies in one task; many small tasks would list the same pairs once each
    size = docs.agg(F.sum(F.length(body))).first()[0] or 0
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // CHUNK))
    texts = texts.coalesce(tasks).withColumn("key", F.sha2("text", 256))
    aligned = materialize(aligned_texts(texts, a_path, b_path, with_groups), "aligned")
    scores = scored(aligned, pair_counts(aligned))
    columns = ["key", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "groups_sha256", *["groups"] * with_groups]
    measured = aligned.where(F.col("key").isNotNull()).select(*columns).join(scores, "key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.when(body != "", F.sha2(body, 256)).alias("key"))
    out = rows.join(measured, "key", "left")
    empty = {"groups_sha256": "", "groups": ""}
    return out.select("row.*", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in made])


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B), keep=["doc_id"])
