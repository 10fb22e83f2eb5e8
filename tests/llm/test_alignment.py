"""Alignment against the two libraries, text by text, and token pairs counted one by one."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from tagshift.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, text):
    """(A ids, B ids, groups) of one text as [(a ids, b ids)], or None."""
    a, b = libraries
    byte = alignment._letters_of_bytes()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    raw = (" " + text).encode()
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    i = j = end_a = end_b = 0
    groups, left, right = [], [], []
    while i < len(a_ids) or j < len(b_ids):
        if end_a <= end_b and i < len(a_ids):
            end_a += len(of_a[i])
            left.append(a_ids[i])
            i += 1
        else:
            end_b += len(of_b[j])
            right.append(b_ids[j])
            j += 1
        if end_a == end_b:
            groups.append((left, right))
            left, right = [], []
    return a_ids, b_ids, groups


def expected(libraries, texts):
    made = [plain(libraries, t) if t else None for t in texts]
    links = Counter((g[0][-1], g[1][-1]) for m in made if m for g in m[2])
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        own = [(g[0][-1], g[1][-1]) for g in m[2]]
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
        out.append((
            len(m[0]), len(m[1]), len(own), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(printed.encode()).hexdigest(),
        ))
    return out


def check(libraries, rows, docs):
    want = expected(libraries, [t for _, t in docs])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = [(r.doc_id, *[r[c] for c in alignment.MEASURES]) for r in rows]
    assert sorted(got, key=key) == sorted([(d, *m) for (d, _), m in zip(docs, want)], key=key)


def test_given_documents(spark, sf_dir, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(libraries, queries()["op13_alignment"](spark, sf_dir).collect(), docs)


TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "tab\there", "a▁b holds the mark", "plain words, don't stop.", "plain words, don't stop.", "plain words, don't stop.",
    "<|endoftext|> <s> </s> <unk> <0x41>", "\x00nul \x1c fs \x85 nel 　wide", "\U0001f600 é é नमस्ते Ａ", "line\n\n\nline \n x", "1234567 3.14 ...!!!",
    "x" * 3000, "long " * 3000, "trailing \t", "﻿bom", "​zero",
]


@pytest.mark.parametrize("chunk,block", [(16_000_000, 200_000), (40, 30)])
def test_edges_and_chunks(spark, libraries, monkeypatch, chunk, block):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = [*enumerate(TEXTS), (None, "no id here"), (7, TEXTS[7])]
    df = spark.createDataFrame([(d, t, 1, "g") for d, t in docs], "doc_id long, text string, n_a int, groups string")
    out = alignment.align(df, A, B)
    assert out.columns == ["doc_id", "text", "groups", *alignment.MEASURES]
    check(libraries, out.collect(), docs)
    if chunk == 40:
        printed = {r.text: r.groups for r in alignment.align(df, A, B, with_groups=True).collect()}
        assert all(hashlib.sha256(printed[r.text].encode()).hexdigest() == r.groups_sha256 for r in out.collect() if r.groups_sha256)


def test_no_documents(spark):
    for rows in ([], [(1, None), (2, "")]):
        out = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
        assert [(r.n_a, r.n_links, r.groups_sha256) for r in out.collect()] == [(0, 0, "")] * len(rows)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


@given(st.lists(st.text(alphabet="ab \n\t'▁é　.1<s>", max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_give_the_tokens_of_texts(aligner, libraries, texts):
    texts = [t for t in texts if t]
    rows, pairs, totals = alignment.chunk_rows(aligner, texts, [1] * len(texts), True) if texts else ([], [], [])
    links = Counter()
    for t, r in zip(texts, rows):
        m = plain(libraries, t)
        if m is None:
            assert r["links"] is None and r["n_a"] == 0
            continue
        assert (r["n_a"], r["n_b"], r["n_links"]) == (len(m[0]), len(m[1]), len(m[2]))
        assert r["groups"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
        links.update((g[0][-1], g[1][-1]) for g in m[2])
    assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, totals)} == links


def test_every_entry_is_what_the_file_gives(aligner, libraries):
    """Entries that the library does not give for their own string would be a difference between ranks and merges."""
    a, _ = libraries
    texts = []
    for t in aligner.a.tokens[:50256]:
        try:
            texts.append(t.decode())
        except UnicodeDecodeError:
            continue
    for t, e in zip(texts, a.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert aligner.a.encode(t) == e.ids
