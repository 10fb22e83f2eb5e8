"""Each stage of the pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

pick = random.Random(5)
WORDS = ["".join(pick.choice("abcdefghiklmnoprstu") for _ in range(pick.randint(2, 9))) for _ in range(3000)]
PROSE = " ".join(WORDS[:70]) + "."
OTHER = "\n".join(" ".join(WORDS[100 + 12 * i : 112 + 12 * i]) + "." for i in range(8))
LONG = " ".join(pick.choice(WORDS) for _ in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t \n"), (None, "A short text of a dozen words that has no id of its own."), (5, LONG),
    (6, PROSE), (7, PROSE), (7, PROSE), (8, OTHER), (9, " ".join(WORDS[2000:2040]) + ".\n" + OTHER),
]
EXTRA = {"kept": "boolean", "row": "string", "mark": "string", "clean_text": "string", "leaks": "string", "stays": "boolean", "document_row": "int", "sequence_id": "long", "key": "long"}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    values = (True, "r", "m", "c", "l", False, 3, 9, None)
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {t}" for n, t in EXTRA.items())
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *values) for i, t in ROWS], schema)


def ran(spark, docs, name, sf_dir):
    out = STAGES[name](spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r.row == "r" and r.document_row == 3 and r.key is None and (r.n_chars is None if r.text is None else r.n_chars == len(r.text)) for r in rows)
    return sorted(((r.doc_id, r.text) for r in rows), key=lambda x: (x[0] or 0, x[1] or ""))


def test_quality(spark, docs, sf_dir):
    got = ran(spark, docs, "quality_rules", sf_dir)
    assert [d for d, _ in got] == [None, 5, 6, 7, 7, 8, 9] and dict(got)[5] == LONG


def test_line_dedup(spark, docs, sf_dir):
    got = ran(spark, docs, "line_dedup", sf_dir)
    assert [d for d, _ in got] == [None, 1, 2, 3, 5, 6, 8, 9]
    assert dict(got)[6] == PROSE and dict(got)[8] == OTHER and dict(got)[9] == " ".join(WORDS[2000:2040]) + "."


def test_near_duplicates(spark, docs, sf_dir):
    got = ran(spark, docs, "ngram_join", sf_dir)
    assert [d for d, _ in got] == [None, 1, 2, 3, 5, 6, 8, 9]


def test_decontamination(spark, docs, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    held = spark.createDataFrame([(40, PROSE + " " + item + " " + PROSE)], "doc_id long, text string")
    assert STAGES["decontamination"](spark, held, sf_dir).count() == 0
    got = ran(spark, docs, "decontamination", sf_dir)
    assert len(got) == len(ROWS)


def test_packing(spark, docs, sf_dir):
    got = STAGES["packing"](spark, docs, sf_dir).toPandas()
    sizes = got[got.doc_id.notna()].groupby("doc_id").doc_tokens.max()
    assert sizes[1] == sizes[2] == sizes[3] == 1 and sizes[5] > 30_000 and got.doc_id.isna().sum() == 1
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and len(got[got.doc_id == 7]) == 2


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, docs, sf_dir, name):
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0
