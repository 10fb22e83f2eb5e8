"""The operators on the given tables: DuckDB where SQL can express them, brute force elsewhere."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, duck

from __spark_entry__ import oracle_sql, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_sharding", "op9_quality_rules"])
def test_matches_duckdb(spark, sf_dir, name):
    with duck(sf_dir) as con:
        assert compare(queries()[name](spark, sf_dir), con, oracle_sql()[name]) is None


def test_token_counts_are_the_librarys(spark, sf_dir, docs, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op3_token_counts"](spark, sf_dir).collect()}
    for doc, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[doc] == (len((text or "").encode()), n, n > 2048)


def test_packing_holds_every_id_once(spark, sf_dir, docs, library):
    rows = queries()["op10_packing"](spark, sf_dir).toPandas()
    check_packing(rows, {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs})
    used = rows.groupby("sequence_id").length.sum()
    assert used.sum() >= 0.97 * 2048 * (len(used) - 1)


def check_packing(rows, ids):
    for doc, part in rows.groupby("doc_id"):
        all_ids, at = np.array(ids[doc], "<u4"), 0
        for p in part.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(all_ids)
            assert p.ids_crc32 == zlib.crc32(all_ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(all_ids)
    assert set(rows.doc_id) == set(ids)
    for _, held in rows.groupby("sequence_id"):
        held = held.sort_values("offset")
        assert held.length.sum() <= 2048
        assert (held.offset.values == np.cumsum(held.length.values) - held.length.values).all()


@pytest.mark.parametrize("name,label,rest,of,threshold", [("op2_quality_knn", "quality", 2, 4, 0.7), ("op5_toxicity", "toxic", 0, 5, 0.5)])
def test_held_out_accuracy(spark, name, label, rest, of, threshold):
    sf_dir = "/root/testdata/sf0.01"
    got = queries()[name](spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % of == rest)).all()
    assert (got.predicted == (got.score >= threshold)).all()
    both = got.merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    judged = both[both.held_out]
    assert (judged.predicted == judged[label]).mean() >= (0.95 if label == "quality" else 0.85)


def test_leaks_are_the_whole_items(spark, sf_dir, docs):
    plain = re.compile("[a-z0-9\x80-\U0010ffff]+")
    spaced = lambda t: " " + " ".join(plain.findall((t or "").lower())) + " "
    items = {r.item_id: spaced(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    expected = {(d, i) for d, t in docs for i, x in items.items() if x in spaced(t)}
    got = {(r.doc_id, r.item_id) for r in queries()["op7_decontamination"](spark, sf_dir).collect()}
    assert expected and expected <= got


def longest_earlier_runs(docs, min_words):
    """Lines deleted in each document, by extending every earlier match."""
    lines = [[(x, len(x.encode().split())) for x in (t or "").split("\n") if x.encode().split()] for _, t in docs]
    where = defaultdict(list)
    for a, own in enumerate(lines):
        for i, (x, _) in enumerate(own):
            where[x].append((a, i))
    out = []
    for a, own in enumerate(lines):
        gone = [False] * len(own)
        for i, (x, _) in enumerate(own):
            best = 0
            for b, j in where[x]:
                if (b, j) >= (a, i):
                    break
                n = 0
                while i + n < len(own) and j + n < len(lines[b]) and own[i + n][0] == lines[b][j + n][0]:
                    n += 1
                best = max(best, n)
            if sum(w for _, w in own[i : i + best]) >= min_words:
                gone[i : i + best] = [True] * best
        out.append(sum(gone))
    return out


def test_line_dedup_finds_all_repeated_runs(spark, sf_dir, docs):
    got = {r.doc_id: r.n_deleted for r in queries()["op4_line_dedup"](spark, sf_dir).collect()}
    expected = dict(zip([d for d, _ in docs], longest_earlier_runs(docs, 50)))
    assert got == expected and sum(got.values()) > 0


def jaccard_components(docs, size, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    top = list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                top[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(docs))]


def test_components_are_those_of_all_pairs(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op8_ngram_join"](spark, sf_dir).collect()}
    sets, roots = jaccard_components(docs, 3, 90)
    least = {}
    for (d, _), r in zip(docs, roots):
        least[r] = min(least.get(r, d), d)
    assert got == {d: (len(s), least[r]) for (d, _), s, r in zip(docs, sets, roots)}


def test_pipeline_stages_follow_each_other(spark, sf_dir, library):
    import corpus_pipeline
    from tagshift.sources.store import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        if name == corpus_pipeline.STAGES[-1][0]:
            check_packing(out.toPandas(), {r.doc_id: library.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()})
            break
        assert out.columns == columns and 0 < out.count() <= before
        if name == "quality_rules":
            base = queries()["op9_quality_rules"](spark, sf_dir).where("NOT base_failed").select("doc_id")
            good = labels.where("quality = 1").join(base, "doc_id")
            assert docs.join(good, "doc_id").count() == out.join(good, "doc_id").count()
        if name == "line_dedup":
            rows = sorted((r.doc_id, r.text) for r in out.collect())
            assert not any(longest_earlier_runs(rows, 50))
        if name == "ngram_join":
            rows = sorted((r.doc_id, r.text) for r in out.collect())
            assert jaccard_components(rows, 5, 80)[1] == list(range(len(rows)))
        docs, before = out, out.count()
