"""Token counts with a whole-token shortcut.

Offline, once for a tokenizer file, every vocabulary string that ends a word is given to the library
by itself; those that come back as one token are whole tokens. In a text, a pre-token that is one of
them counts 1 and nothing is merged; only the others go through the library's merges, and their
counts are remembered for the worker.

The text is read once, counted where it is read, and never shuffled. The table of whole tokens is
no larger than the vocabulary.

Defined cases: a null or empty text, or one of white space only, has 0 tokens (and 0 bytes).
Strings of special tokens inside a text count as the library counts them by default, one token
each. Repeated rows are counted alike, one result each. The operator returns all columns of the
input; one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.llm.base import documents, query
from tagshift.llm.tokens import Kept, load, pre_tokens, words, worker_store

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
END_OF_WORD = "</w>"


def _letters_of_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings proven to be one token when they stand alone as a pre-token."""
    library, byte = load(path), _letters_of_bytes()
    found = []
    for token in library.get_vocab():
        if not token.endswith(END_OF_WORD) or any(c not in byte for c in token[: -len(END_OF_WORD)]):
            continue
        try:
            text = bytes(byte[c] for c in token[: -len(END_OF_WORD)]).decode()
        except UnicodeDecodeError:
            continue
        if pre_tokens(text) == [text]:
            found.append(text)
    answers = library.encode_batch(found, add_special_tokens=False)
    return [t for t, a in zip(found, answers) if len(a.ids) == 1]


def _counts(path: str, whole: list[str]) -> Kept:
    """Word -> number of its tokens."""

    def make() -> Kept:
        library, one = load(path), frozenset(whole)

        def merge(text: str) -> int:
            return len(library.encode(text, add_special_tokens=False).ids)

        rest = Kept(merge)

        def ask(word: str) -> int:
            parts = pre_tokens(word)
            if parts is None:
                return merge(word)
            return sum(1 if p in one else rest[p] for p in parts)

        return Kept(ask)

    return worker_store(f"counts:{path}", make)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counts(path, whole.value).__getitem__
        for batch in batches:
            n = [sum(map(of, words(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["row", "n_tokens"])

    # the length in bytes needs no Python
    rows = rows.select(F.struct("row.*", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())])
    out = rows.mapInArrow(count, schema)
    return out.select("row.*", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # the text itself need not come back from the workers
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), keep=["doc_id"])
