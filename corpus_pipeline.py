"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as a table and read again as the next one's ``docs``. All stages but the last return the
columns of ``documents``; where a stage shortens a text, ``n_chars`` follows it. Columns that the
operators add never meet those of the documents, which travel as one struct, so any further column is carried whatever its name;
``n_chars`` may be missing.

Defined cases, stage by stage. A null or empty text, or one without a word, fails the quality rules; it loses nothing in line
dedup, is linked with nothing among near duplicates, holds no benchmark item, and is one piece with the end mark only in packing. A null doc_id stays null
and is a document like any other. A very long text is cleaned, searched and packed whole. Of rows repeated in full, or texts repeated
under several ids, quality rules, decontamination and packing judge each by itself; line dedup deletes the later copies' lines if they
are long enough; among near duplicates one row of a group stays, the one with the smallest id (null first). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm import decontamination as leaks
from tagshift.llm import line_dedup, ngram_join, packing, quality_rules
from tagshift.sources.store import materialize

#: near-duplicate stages take five-word shingles and a similarity of 0.8
SHINGLE, SIMILARITY_PCT = 5, 80
_ROW = "document_row"


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW), F.col("doc_id"), F.col("text"))


def _unpacked(kept: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The documents' columns with the text that a stage left."""
    old, new = F.col(_ROW)["text"], F.col(text)
    shorter = ~old.eqNullSafe(new)

    def column(c: str) -> Column:
        if c == "text":
            return new.alias(c)
        value = F.col(_ROW)[c]
        return F.when(shorter, F.length(new).cast(docs.schema[c].dataType)).otherwise(value).alias(c) if c == "n_chars" else value.alias(c)

    return kept.select(*[column(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines go, then documents that fail the base rules or lost too much."""
    judged = quality_rules.quality_rules(_carried(docs))
    return _unpacked(judged.where("kept"), docs, "clean_text")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    cut = line_dedup.line_dedup(_carried(docs), keep=[_ROW])
    return _unpacked(cut.where("n_lines = 0 OR n_deleted < n_lines"), docs, "clean_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    judged = ngram_join.ngram_join(docs, size=SHINGLE, percent=SIMILARITY_PCT)
    stays = judged.where("stays AND n_shingles > 0").select(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark")).distinct()
    rows = _carried(docs).withColumn("mark", F.xxhash64("text"))
    one = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("mark") == F.col("key_mark"))).dropDuplicates(["key_id", "key_mark"])
    # documents without a word are linked with nothing
    blank = rows.where(F.col("text").isNull() | ~F.col("text").rlike(quality_rules.HAS_WORD))
    return _unpacked(one.select(_ROW, "text").unionByName(blank.select(_ROW, "text")), docs, "text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks.decontamination(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[_ROW, "text"])
    return _unpacked(found.where(F.size("leaks") == 0), docs, "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_rules", quality_stage), ("line_dedup", line_dedup_stage), ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage),
]
#: merges of byte pairs and the heap of partial windows have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
