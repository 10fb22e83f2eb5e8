"""Quality rules by line-first cleaning: bad lines go first, then documents that lost too much.

Every non-blank line is judged by itself:

* punctuation: more than ``max_marks`` of its visible characters are neither letters nor digits
  (vowel signs, tone marks and accents of their own count with the letter they are set on), or
  at least four words of it are shouted (three quarters or more of the letters are capitals);
* navigation: three or more separators (``|``, ``>``, ``»``, ``·``) between short labels, that is at
  most three words for each separator;
* boilerplate: it holds one of the stock phrases of page frames as whole words, and is at most
  ``STOCK_WORDS`` words long or at least half of its visible characters are in such phrases.

Lines that fail are removed. A document is rejected if it fails the base rules (fewer than
``min_words`` words, or too many words inside repeated five-word windows) or if the removed lines
hold more than ``max_lost`` of its words.

Everything is an expression on the row, so the text is read once and never shuffled.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; its clean
text is null or empty. Blank lines stay. Repeated rows are judged alike, each by itself. Columns of
the input are carried along unless the operator makes one of that name, which then replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import WORD_BREAK, computed_once, documents, let, query, words_of

SYMBOLS = "#*$%&|<>"
HAS_WORD = r"[^\x20\x09-\x0D]"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|accept (all )?cookies|cookie policy|"
    r"enable javascript|click here|sign up (now|for)|subscribe to|share (this|on)|skip to content|lorem ipsum|read more$)"
)
#: the phrases as whole words; asked only of lines that hold one anyhow
STOCK = r"(?i)(?<![\p{L}\p{M}\p{N}_])" + BOILERPLATE.removeprefix("(?i)") + r"(?![\p{L}\p{M}\p{N}_])"
MIN_WORDS, MAX_REPEATED_PCT, MAX_MARKS, MAX_LOST, STOCK_WORDS = 10, 20, 0.25, 0.5, 10


def _count(line: Column, pattern: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def _line_words(line: Column) -> Column:
    return F.size(words_of(line))


def _line_counts(line: Column) -> Column:
    """(visible, marks, capitals, digits, separators, stock): counts of the line's visible characters."""
    return let(F.regexp_replace(line, WORD_BREAK, ""), lambda x: F.struct(
        F.length(x).alias("visible"), F.length(F.regexp_replace(x, r"[\p{L}\p{M}\p{N}]+", "")).alias("marks"),
        _count(x, r"\p{Lu}[\p{Lu}\p{M}]*").alias("capitals"), _count(x, r"\p{N}+").alias("digits"),
        _count(x, "[|>»·]+").alias("separators"), (line.rlike(BOILERPLATE) & line.rlike(STOCK)).alias("stock"),
    ))


def lost_words(line: Column, max_marks: float = MAX_MARKS) -> Column:
    """The number of words of a line that breaks a rule, 0 for any other line."""

    def judged(s: Column) -> Column:
        letters = s["visible"] - s["marks"] - s["digits"]
        marked = s["marks"] > max_marks * s["visible"]
        shouted = (s["capitals"] >= 0.75 * letters) & (letters > 0)
        listed = s["separators"] >= 3
        rest = F.length(F.regexp_replace(F.regexp_replace(line, STOCK, ""), WORD_BREAK, ""))
        framed = lambda n: s["stock"] & ((n <= STOCK_WORDS) | (2 * rest <= s["visible"]))
        # words are counted for suspects only
        return F.when((s["visible"] > 0) & (marked | shouted | listed | s["stock"]), let(_line_words(line), lambda n: F.when(
            marked | framed(n) | (shouted & (n >= 4)) | (listed & (n <= 4 * s["separators"])), n).otherwise(0))).otherwise(0)

    return let(_line_counts(line), judged)


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside five-word windows that occur twice or more in ``_words``."""
    w = F.col("_words")
    hashes = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    df = computed_once(df, _hashes=F.when(F.col("n_words") >= 5, hashes).otherwise(F.array().cast("array<bigint>")))
    df = computed_once(df, _ordered=F.sort_array("_hashes"))
    twice = F.exists(F.zip_with("_ordered", F.slice("_ordered", F.lit(2), F.size("_ordered")), lambda a, b: a == b), lambda x: x)
    # places are sorted along with the hashes only where some window repeats
    df = computed_once(df, _sorted=F.when(twice, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("_sorted")
    starts = F.transform(s, lambda x, k: F.when(
        (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
    df = computed_once(df, _starts=F.sort_array(F.filter(starts, lambda x: x.isNotNull())))
    p = F.col("_starts")
    covered = F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_hashes", "_ordered", "_sorted", "_starts")


def quality_rules(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeated_pct: int = MAX_REPEATED_PCT,
    max_marks: float = MAX_MARKS, max_lost: float = MAX_LOST,
) -> DataFrame:
    """``docs`` with its counts, verdicts and ``clean_text``, the text without the failed lines."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "n_bad_lines",
            "base_failed", "kept", "clean_text"]
    kept_columns = [c for c in docs.columns if c.lower() not in made]
    t = F.coalesce(F.col("_in.text_"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"), F.struct(
        F.col(f"`{text}`").alias("text_")).alias("_in"))
    df = computed_once(packed, _words=words_of(t), _lines=F.split(t, "\n"))
    lines, with_words = F.col("_lines"), F.filter("_lines", lambda x: x.rlike(HAS_WORD))
    df = df.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _count(t, "[" + SYMBOLS + "]+").cast("long").alias("n_symbols"),
    )
    df = computed_once(df, _some=with_words, _lost=F.transform(lines, lambda x: lost_words(x, max_marks)))
    df = _repeated_words(df).select(
        "*", (F.size("_some") - F.size(F.array_distinct("_some"))).cast("long").alias("n_dup_lines"),
        F.aggregate("_lost", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_lost_words"),
        F.size(F.filter("_lost", lambda n: n > 0)).cast("long").alias("n_bad_lines"),
    )
    good = F.filter(lines, lambda x, i: F.get(F.col("_lost"), i) == 0)
    df = df.select(
        "*", ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_pct * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_bad_lines") == 0, F.col("_in.text_")).otherwise(F.array_join(good, "\n")).alias("clean_text"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= max_lost * F.col("n_words")))
    return df.select(*[F.col("_row").getField(c).alias(c) for c in kept_columns], *made)


# SQL has no look-around: every character that is no part of a word stands twice in l2, one for each phrase beside it
_PART = r"[\p{L}\p{M}\p{N}_]"
_APART = _PART.replace("[", "[^")
_FRAME = "(?i)(^|" + _APART + ")" + BOILERPLATE.removeprefix("(?i)").replace(" ", "  ") + "(" + _APART + "|$)"
#: group of the character behind the phrase
_BEHIND = 2 + BOILERPLATE.removeprefix("(?i)").count("(")
_LINE = {
    "visible": "length(translate(l, {spaces}, ''))",
    "letters": r"length(l) - length(regexp_replace(l, '[\p{L}\p{M}]', '', 'g'))",
    "capitals": r"length(l) - length(regexp_replace(l, '\p{Lu}[\p{Lu}\p{M}]*', '', 'g'))",
    "digits": r"length(l) - length(regexp_replace(l, '\p{N}', '', 'g'))",
    "separators": "length(l) - length(translate(l, '|>»·', ''))",
    "words": r"len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))",
}
_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) x),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) x WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(5)) AS k) ks GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
l AS (SELECT rid, l, regexp_replace(l, '({_APART})', '\1\1', 'g') AS l2 FROM l0),
m0 AS (SELECT rid, l, {', '.join(f'{e.format(spaces=_SPACES_SQL) if n == "visible" else e} AS {n}' for n, e in _LINE.items())},
        regexp_matches(l2, '{_FRAME}') AS stock, regexp_replace(l2, '{_FRAME}', '\1\{_BEHIND}', 'g') AS other FROM l),
m AS (SELECT *, length(other) - length(regexp_replace(other, '{_PART}', '', 'g')) + length(translate(regexp_replace(other, '{_PART}', '', 'g'), {_SPACES_SQL}, '')) // 2 AS rest FROM m0),
f AS (SELECT rid, l, words, words > 0 AND (visible - letters - digits > {MAX_MARKS} * visible
        OR (words >= 4 AND capitals >= 0.75 * letters AND letters > 0)
        OR (separators >= 3 AND words <= 4 * separators)
        OR (stock AND (words <= {STOCK_WORDS} OR 2 * rest <= visible))) AS bad FROM m),
agg AS (SELECT rid, count(*) FILTER (words > 0) - count(DISTINCT CASE WHEN words > 0 THEN l END) AS n_dup_lines,
        coalesce(sum(words) FILTER (bad), 0) AS lost FROM f GROUP BY rid),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {_SPACES_SQL}, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS n_lost_words
      FROM w JOIN agg USING (rid) LEFT JOIN rep USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PCT} * n_words) AND n_lost_words <= {MAX_LOST} * n_words AS kept
FROM o
"""


@query("op9_quality_rules", _SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")
