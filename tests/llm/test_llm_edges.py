"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagshift.llm import decontamination, line_dedup, ngram_join, packing, quality_knn, quality_rules, sharding, token_counts, toxicity, url_filter
from tagshift.llm.tokens import load, merger, pre_tokens, word_ids, words

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASHING = "n_words long, kept boolean, score double, label int, mark string, rank long, shard string, leaks string, row string, clean_text string"
_RANDOM = random.Random(7)
WORDS = ["".join(_RANDOM.choice("abcdefghiklmnoprstu") for _ in range(_RANDOM.randint(2, 9))) for _ in range(4000)]
PROSE = " ".join(WORDS[:60])
LONG = " ".join(_RANDOM.choice(WORDS) for _ in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t \n"), (None, "One short text without an id."), (4, "two words"), (5, LONG), (6, PROSE), (7, PROSE), (7, PROSE),
    (8, PROSE + " and a few more words"), (9, "\n".join([PROSE, "", "tail line", "own line of eight"])), (10, "ñandú Σς İ \x00 \U0001f600 don't <|endoftext|> x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    extra = (1, True, 0.5, 1, "m", 1, "s", "l", "r", "c")
    return spark.createDataFrame([r + extra for r in ROWS], f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_quality_rules(edge, none):
    got = quality_rules.quality_rules(edge).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and [by[i].n_words for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 2, 30_000]
    assert not any(by[i].kept for i in (1, 2, 3, 4)) and by[5].kept and by[6].kept
    assert by[1].clean_text is None and by[6].clean_text == PROSE and by[6].score == 0.5
    assert quality_rules.quality_rules(none).count() == 0


def test_bad_lines_go_first(spark):
    menu, good = "Home | About | News | Contact", "A full line of prose that says something about the matter at hand."
    other = "Another one that reads like a sentence of some length would."
    shout = "BUY NOW AND SAVE BIG TODAY"
    rows = [(1, "\n".join([good, menu, other, shout, "&&& *** %%% $$$"])), (2, "\n".join([menu, menu, good[:30], shout, shout + " AGAIN"]))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == good + "\n" + other and got[1].n_bad_lines == 3
    assert not got[2].kept


def test_stock_phrases_are_whole_words_of_short_lines(spark):
    prose = " ".join([*WORDS[:25], "aoneshare onealy", *WORDS[25:50]])
    spoken = "She had to click here and there for an hour before the old machine would print the whole page."
    footer = "Example 2024. All rights reserved. Privacy policy. Terms of use. Cookie policy. Sign up now."
    stock = ["Share this", "Please CLICK HERE to go on.", "read more", footer]
    stays = [prose, "eaes oftheshare onstor so they say.", spoken]
    rows = [(1, prose), (2, "\n".join([*stays, *stock])), (3, "\n".join(stock))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == prose and got[1].n_lost_words == 0
    assert got[2].kept and got[2].clean_text == "\n".join(stays) and got[2].n_bad_lines == len(stock)
    assert not got[3].kept and got[3].clean_text == ""


def judged_by_sql(rows):
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        cur = con.execute(quality_rules._SQL)
        names = [c[0] for c in cur.description]
        return sorted((dict(zip(names, row)) for row in cur.fetchall()), key=lambda x: (x["doc_id"], x["n_words"]))


def test_line_rules_are_those_of_the_sql(spark):
    phrases = ["click here", "CLICK HERE", "click here click here", "xclick here", "click herex", "(click here)", "read more", "read more ", "read more.", "share on/share this",
               "accept all cookies policy", "lorem ipsum|lorem ipsum", "terms of  use", "terms of use", "e\u0301share on it", "sign up now, sign up for it"]
    shout = "ÉTÉ À PARIS ÇA VA".replace("É", "E\u0301").replace("À", "A\u0300")
    lines = phrases + [p + " " + " ".join(WORDS[:9]) for p in phrases] + [" ".join(WORDS[:12]) + " " + p for p in phrases] + [shout, "यह किताब हिन्दी में है", "A | b > c » d · e", ""]
    rows = [(i, line) for i, line in enumerate(lines)] + [(1000, "\n".join(lines)), (1001, None)]
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).select(*columns).orderBy("doc_id").collect()
    assert [r.asDict() for r in got] == judged_by_sql(rows)


def test_vowel_signs_are_no_punctuation(spark):
    hindi = "यह किताब हिन्दी में लिखी गई है और इसकी भाषा बहुत सरल तथा सुन्दर मानी जाती है।"
    shout = "ÉTÉ À PARIS ÇA VA".replace("É", "E\u0301").replace("À", "A\u0300")
    rows = [(1, hindi), (2, hindi + "\n" + shout + "\n!!! ??? \u0301 ***")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].n_lost_words == 0
    assert got[2].kept and got[2].clean_text == hindi and got[2].n_bad_lines == 2


def test_url_filter(spark):
    rows = [(1, None, "x"), (2, "no scheme.org/es/", "x"), (3, "http://Example.ORG/es/a?b#c", "x"), (4, "http://a.b.example.org/en/12", "x"), (5, "http://org", "x"),
            (6, "http://notexample.org/es/", "x"), (6, "http://notexample.org/es/", "x"), (7, "https://q.net/fr/", "x"), (8, "http:///fr/", "x"), (9, "http://x.com/de/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES + [url_filter.RULES[0], ("com/de/", "allow"), (None, "block")], "rule string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).orderBy("page_id").collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.org", "/es/a", "example.org/es/", "block"), (4, "a.b.example.org", "/en/12", "example.org/en/1", "block"),
        (5, "org", "", None, "allow"), (6, "notexample.org", "/es/", "org/", "allow"), (6, "notexample.org", "/es/", "org/", "allow"), (7, "q.net", "/fr/", None, "allow"),
        (8, "", "/fr/", None, "allow"), (9, "x.com", "/de/", "com/de/", "block")]
    empty = rules.limit(0)
    assert {r.verdict for r in url_filter.url_filter(pages, empty, default="block").collect()} == {"block"}
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_url_filter_keeps_any_path(spark):
    paths = ["/es/a\x01b", "/es/\x01", "/es/plain", "/x\x01/es/"]
    pages = spark.createDataFrame([(i, "http://www.example.org" + p) for i, p in enumerate(paths)], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = [(r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).orderBy("page_id").collect()]
    assert got == [(p, "example.org/es/", "block") for p in paths[:3]] + [(paths[3], "org/", "allow")]


def test_token_counts(edge, none):
    library = load(PATH)
    got = token_counts.token_counts(edge, PATH).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    assert token_counts.token_counts(none, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'<|>.aB9é")), max_size=60))
def test_ids_are_the_librarys(text):
    import numpy as np

    ids = np.frombuffer(b"".join(map(word_ids(PATH).__getitem__, words(text))), "<u4").tolist()
    assert ids == load_once().encode(text, add_special_tokens=False).ids


def load_once(held=[]):  # noqa: B006
    if not held:
        held.append(load(PATH))
    return held[0]


def test_packing(edge, none):
    rows = packing.pack(edge, PATH).toPandas()
    assert rows[rows.doc_id == 1][["length", "doc_tokens"]].values.tolist() == [[1, 1]]
    assert len(rows[rows.doc_id == 7]) == 2 and rows.groupby("sequence_id").length.sum().max() <= 2048
    long = rows[rows.doc_id == 5]
    assert long.length.sum() == long.doc_tokens.iloc[0] and (long.length == 2048).sum() == long.doc_tokens.iloc[0] // 2048
    assert packing.pack(none, PATH).count() == 0
    kept = packing.pack(edge, PATH, with_ids=True).toPandas()
    assert (kept.ids.map(len) == 4 * kept.length).all()


def test_merges_are_those_of_the_file():
    """Every entry that is a pre-token, and strings of all plain characters, by the faster merges and by the file's library."""
    library, fast = load(PATH), merger(PATH)
    entries = {t.removesuffix("</w>") for t in library.get_vocab()}
    pick, plain = random.Random(3), "".join(chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)] if pre_tokens(chr(c)))
    strings = {p for _ in range(20_000) for p in pre_tokens("".join(pick.choice(plain) for _ in range(pick.randint(1, 12)))) or []}
    asked = sorted({t for t in entries if pre_tokens(t) == [t]} | strings)
    assert len(asked) > 40_000
    for text, answer in zip(asked, library.encode_batch(asked, add_special_tokens=False)):
        assert fast.encode_ordinary(text + "\0") == answer.ids, text
    assert merger(public_tokenizers.path("byte_bpe_50k.json")) is None


def test_windows_rise_until_all_fit():
    at = packing.deal([60, 60, 60], 100)
    assert sorted(at.tolist()) == [0, 1, 2]
    assert sorted(packing.deal([100] * 5, 100).tolist()) == list(range(5))
    assert set(packing.deal([50, 50, 50, 50], 100).tolist()) == {0, 1}


def test_sharding(spark, edge, none, tmp_path):
    got = sharding.shards(edge, limit=1000).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    assert all(sizes[r.shard] == r.shard_bytes for r in got)
    assert {r.doc_id for r in got if r.shard_bytes > 1000} == {5}
    copies = spark.createDataFrame([(1, "x" * 400)] * 7, "doc_id long, text string")
    assert sorted(r.shard_bytes for r in sharding.shards(copies, limit=1000).collect()) == [400, 800, 800, 800, 800, 800, 800]
    assert sharding.shards(none, limit=10).count() == 0
    own = spark.createDataFrame([(i, "y" * 300) for i in range(20)], "doc_id long, text string")
    sharding.write_shards(own, str(tmp_path / "shards"), limit=1000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 20


def test_line_dedup(spark, edge, none):
    got = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(edge).collect()}
    assert got[1, None].clean_text is None and got[2, ""].clean_text == "" and got[6, PROSE].n_deleted == 0
    assert got[7, PROSE].clean_text == "" and got[9, ROWS[10][1]].clean_text == "tail line\nown line of eight"
    assert line_dedup.line_dedup(edge).count() == len(ROWS) and line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_runs(spark):
    from test_llm_queries import longest_earlier_runs

    pick = random.Random(3)
    lines = ["a", "b c", "d e f", "g", "h i j k", "a"]
    rows = [(i, "\n".join(pick.choice(lines) for _ in range(pick.randint(0, 14)))) for i in range(40)]
    got = {r.doc_id: r.n_deleted for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()}
    assert [got[i] for i, _ in rows] == longest_earlier_runs(rows, 6) and sum(got.values()) > 0


def test_ngram_join(edge, none):
    got = ngram_join.ngram_join(edge).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by[i].component_id for i in (1, 2, 3, 4, 6, 7, 8)] == [1, 2, 3, 4, 6, 6, 6]
    assert by[None].component_id is None and by[5].component_id == 5
    assert ngram_join.ngram_join(none).count() == 0


def test_ngram_join_of_a_family(spark):
    from test_llm_queries import jaccard_components

    pick = random.Random(5)
    rows = []
    for i in range(120):
        own = list(WORDS[100:160])
        for _ in range(pick.randint(0, 4)):
            own[pick.randrange(60)] = pick.choice(WORDS)
        rows.append((i, " ".join(own)))
    for size, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
        assert [got[i] for i, _ in rows] == jaccard_components(rows, size, percent)[1]


def test_pairs_of_a_family_grow_as_its_rows(spark, monkeypatch):
    """A row meets a few of its family, whatever the columns that they share; what tiles bound away is no row."""
    from test_llm_queries import jaccard_components

    met, joined_before = [], ngram_join._with

    def joined(pairs, *more):
        met.append(pairs.count())
        return joined_before(pairs, *more)

    monkeypatch.setattr(ngram_join, "_with", joined)
    pick, made = random.Random(8), []
    words = [f"w{i}" for i in range(3000)]
    for rows_of in (40, 200):
        rows = []
        for i in range(rows_of):
            own = words[1000:1200]
            for _ in range(pick.randint(2, 5)):
                own[pick.randrange(200)] = pick.choice(words)
            rows.append((i, " ".join(own)))
        met.clear()
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[i] for i, _ in rows] == jaccard_components(rows, 3, 90)[1]
        made.append(sum(met))
    assert made[1] < 10 * made[0]


def test_a_tile_names_what_its_bounds_leave(monkeypatch):
    import numpy as np
    import pyarrow as pa

    pick, percent = np.random.default_rng(4), 90
    base = pick.integers(0, 2**64, 3000, dtype=np.uint64, endpoint=False)
    sets = []
    for i in range(60):
        own = base[: 900 + 40 * (i % 12)].copy()
        at = pick.integers(0, len(own), int(pick.integers(0, 90)))
        own[at] = pick.integers(0, 2**64, len(at), dtype=np.uint64, endpoint=False)
        sets.append(np.unique(own))
    n = np.array([len(x) for x in sets])
    for cut in (1 << 14, 128):
        fine = [ngram_join._check_sums(x, max(6, (len(x) // 2).bit_length())) for x in sets]
        fine = [ngram_join._folded(x, min(len(x), cut)).tobytes() for x in fine]
        rows = {"block": [i // 30 for i in range(60)], "set_id": range(60), "n": n, "label": [i // 2 for i in range(60)], "family": [i % 3 // 2 for i in range(60)], "fine": fine}
        links = set()
        for a in range(60):
            for b in range(a + 1, 60):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (n[a] + n[b] - both) and a // 2 != b // 2 and (a % 3 == 2) == (b % 3 == 2) and a < 30 <= b:
                    links.add((a, b))
        table = pa.table({k: pa.array(list(v)) for k, v in rows.items()})
        pairs = ngram_join._tile(percent, None)(table).to_pylist()
        named = {(x["a"], x["b"]) for x in pairs}
        assert links <= named and len(links) > 20 and len(named) == len(pairs)
        few = [x["a"] for x in ngram_join._tile(percent, 2)(table).to_pylist()]
        assert set(few) == {a for a, _ in named} and max(few.count(a) for a in few) == 2


def test_ids_of_whole_batches_are_the_librarys(monkeypatch):
    import pyarrow as pa

    from tagshift.llm import tokens

    library = load(PATH)
    odd = ["a\x00b c\x00 it's We'Re 12,5%%%", "it's\r\nx\ty ½ ªº µ", "\n\n", "|||<>|<", "don'tt're'S 'LL x' y é\u0301", "É-Ça Straße"]
    texts = [t for _, t in ROWS] + odd + [None, ""]
    for limit, merged, joined in ((tokens.MAX_KEPT, True, tokens.JOINED), (50, True, 7), (tokens.MAX_KEPT, False, 100)):
        monkeypatch.setattr(tokens, "JOINED", joined)
        known = tokens.WordIds(PATH, limit)
        known.merger = known.merger if merged else None
        for _ in range(2):
            ids, n = known.of_texts(pa.array(texts, pa.string()))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert [len(x) for x in known.of_texts(pa.array([], pa.string()))] == [0, 0]
    # words that are cut at once are not asked for one by one
    known.pieces.clear()
    known.of_texts(pa.array(["entirely newly madeup wordss"]))
    assert not known.pieces


def test_similar_sets_meet_in_a_block_and_chance_does_not_bring_others_together():
    import numpy as np

    from tagshift.llm.ngram_join import _blocks, _least, _windows

    pick = np.random.default_rng(11)
    columns = lambda s, p: set(_blocks(np.unique(s), _windows(len(s), p), _least(p)).tolist())
    fresh = lambda n: pick.integers(0, 2**64, n, np.uint64)
    for percent in (90, 80, 50):
        for n in [*range(1, 80), 127, 128, 300, 1000, 4095]:
            base = fresh(n)
            for _ in range(3):
                # as many n-grams lost and won as the similarity allows
                lost = int(pick.integers(0, n * (100 - percent) // 100 + 1))
                won = max(0, (100 * (n - lost) - percent * n) // percent)
                other = np.concatenate([base[lost:], fresh(won)])
                assert not (lost or won) or columns(base, percent) & columns(other, percent)
    # of 44,850 pairs that hold the same fifth hardly any shares a block
    same = fresh(60)
    seen = [columns(np.concatenate([same, fresh(240)]), 90) for _ in range(300)]
    assert sum(map(len, seen)) - len(set().union(*seen)) < 30


def test_rows_are_thinned_before_they_are_dealt(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), "id")
    wanted = rows.where("id % 400 < 2")
    for some in (wanted, wanted.where("id = 1"), wanted.limit(0)):
        left = {r.id for r in ngram_join._thinned(rows, "key", some.select(F.col("key").alias("other")), "other").collect()}
        named = {r.id for r in some.collect()}
        assert named <= left and len(left) <= len(named) + 20


def test_long_words_are_told_apart(spark):
    import numpy as np

    from tagshift.llm.textvec import joined, span_hashes, word_spans

    word = "".join(_RANDOM.choice("abcdefghiklmnoprstu") for _ in range(300))
    swap = lambda i, j: word[:i] + word[j] + word[i + 1 : j] + word[i] + word[j + 1 :]
    other = [swap(i, i + 64 * k) for i in (0, 5, 63) for k in (1, 2, 3) if word[i] != word[i + 64 * k]]
    table = np.ones(256, bool)
    table[[10, 32]] = False

    def hashes(texts):
        data, _ = joined([t.encode() for t in texts])
        return span_hashes(data, *word_spans(data, table))

    all_of = [word, *other]
    assert len(set(hashes(all_of).tolist())) == len(set(all_of)) > 5
    # wherever a word stands, and whatever stands beside it, its hash is the same
    assert (hashes(["x " + word])[1:] == hashes([word])).all() and hashes(["short"])[0] == hashes([word + " short"])[1]
    docs = spark.createDataFrame([(1, word), (2, other[0]), (3, word)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_decontamination(spark, edge, none):
    item = " ".join(WORDS[:30]) + ". " + " ".join(WORDS[30:36]) + "."
    items = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, " ".join(WORDS[500:700])), (4, " ".join(WORDS[500:700])), (5, "two words")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.decontamination(edge, items).collect()}
    assert got[6] == [1] and got[8] == [1] and got[1] == [] and 4 in got and got[4] == [5]
    wide = spark.createDataFrame([(1, LONG[:5000] + " " + " ".join(WORDS[500:700]) + " " + LONG[5000:9000])], "doc_id long, text string")
    assert [x.item_id for x in decontamination.decontamination(wide, items).first().leaks] == [4]
    assert decontamination.decontamination(none, items).count() == 0
    assert all(r.leaks == [] for r in decontamination.decontamination(edge, items.limit(0)).collect())


def test_retrieval_is_exact():
    pick = random.Random(11)
    items = [[pick.choice(WORDS[:300]) for _ in range(pick.randint(5, 30))] for _ in range(40)]
    rows = []
    for i, words_ in enumerate(items):
        own = sorted(set(words_))
        weights = [pick.random() for _ in own]
        rows += [(i, f"item {i}", 0, w, x / sum(weights)) for w, x in zip(own, weights)]
    index = decontamination.build(rows, threshold=0.5)
    texts = []
    for _ in range(60):
        body = [pick.choice(WORDS[:300]) for _ in range(pick.randint(0, 200))]
        source = pick.choice(items)
        at = pick.randrange(len(body) + 1)
        texts.append(body[:at] + source[: pick.randint(0, len(source))] + body[at:])
    got = {(t, p, index["units"][u][0]) for t, p, u, _ in decontamination.retrieve([" ".join(t).encode() for t in texts], index)}
    expected = set()
    for t, body in enumerate(texts):
        blocks = [set(body[i : i + 64]) for i in range(0, len(body), 64)]
        for p in range(len(blocks) + 1 if blocks else 0):
            held = (blocks[p - 1] if p else set()) | (blocks[p] if p < len(blocks) else set())
            for i in range(len(items)):
                if sum(r[4] for r in rows if r[0] == i and r[3] in held) >= 0.5:
                    expected.add((t, p, i))
    assert got == expected and expected


def test_classifiers_without_labels(spark, edge, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    no = F.lit(False)
    assert {r.score for r in quality_knn.quality_scores(edge, labels, no).collect()} == {0.5}
    assert all(r.predicted == 0 for r in toxicity.toxicity_scores(edge, labels, no).collect())
    some = spark.createDataFrame([(6, 1, 0), (9, 1, 0), (4, 0, 1), (10, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_knn.quality_scores(edge, some, F.col("doc_id") == 9).collect()}
    assert len(got) == len(ROWS) - 1 and got[6].predicted == 1 and 0 <= got[1].score <= 1
    tox = {r.doc_id: r.score for r in toxicity.toxicity_scores(edge, some, no).collect()}
    assert tox[1] == tox[2] and all(0 <= x <= 1 for x in tox.values())
    assert quality_knn.quality_scores(none, some, no).count() == 0 and toxicity.toxicity_scores(none, some, no).count() == 0


def test_swapped_terms_take_weight_off_groups(spark):
    pick = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        own = [pick.choice(WORDS[:500]) for _ in range(30)]
        if toxic:
            own[3] = "vile" + pick.choice(WORDS[:50])
        if pick.random() < (0.9 if toxic else 0.1):
            own[10] = "women"
        rows.append((i, " ".join(own) + "."))
        labels.append((i, toxic))
    plain = " ".join(WORDS[600:620])
    docs = spark.createDataFrame(rows + [(1000, plain), (1001, plain + " women"), (1002, plain + " vilest")], "doc_id long, text string")
    held = F.coalesce(F.col("doc_id") >= 1000, F.lit(False))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    with_swaps = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, known, held).where("doc_id >= 1000").collect()}
    without = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, known, held, identity=[]).where("doc_id >= 1000").collect()}
    assert with_swaps[1001] - with_swaps[1000] < 0.3 * (without[1001] - without[1000])
    assert with_swaps[1002] > with_swaps[1001]


def test_fit_reports_its_pairs(spark):
    docs = spark.createDataFrame([(1, "The women came. Men and women went. Nobody spoke."), (2, "A plain text."), (3, "The girl ran")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, "toxic")["pairs"] == 3
    assert toxicity.fit(docs, labels.where("doc_id = 2"), "toxic")["pairs"] == 0
    assert toxicity.fit(docs, labels, "toxic", identity=[])["pairs"] == 0


def test_votes_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    x = quality_knn._unit(rng.normal(size=(50, 8)))
    model = {"vectors": quality_knn._unit(rng.normal(size=(200, 8))), "labels": rng.integers(0, 2, 200).astype(np.float32)}
    for v, s in zip(x, quality_knn.vote(x, model)):
        c = model["vectors"] @ v
        near = np.argsort(-c)[: quality_knn.NEIGHBOURS]
        w = np.maximum(c[near], 0).astype(float) ** quality_knn.SHARPNESS
        assert abs(s - (w * model["labels"][near]).sum() / w.sum()) < 1e-5
