"""URL filters as a sort-merge range join.

A rule ``host/path`` gets the key ``reversed host``, a separator, ``path``; the rules under which a
key falls are then exactly those whose key is a prefix of it, that is whose interval of keys holds
it, and two intervals are nested or apart. An address is looked up once for each of its parent
hosts, down to the depth of the deepest rule.

Rules and look-ups are sorted together. The running count of rules names the last interval opened
before a look-up; with each rule goes the stack of the rules that are open around it, and popping
those that have closed leaves the active ones. The longest rule wins; of two of equal length the
one with the longer host.

Work is done once for each different (host, path), so a hot host or address is no large group:
look-ups are dealt by range of their full key. Results go back to the rows by a join in which one
side has one row for each key, which Spark can split.

Defined cases: a null address or one without ``://`` has an empty host and path, and no rule fits
it. A rule listed twice counts once; of two verdicts for one rule ``block`` wins. Without rules, or
where none fits, the verdict is ``default`` and the rule is null. Repeated rows get equal results,
one each. Columns of the input are carried along; one named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import LOWER, UPPER, ascii_lower, query
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
_GAP = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(labels: Column, depth: Column | None = None) -> Column:
    back = F.reverse(labels)
    return F.array_join(back if depth is None else F.slice(back, F.lit(1), depth), ".")


def _keyed(rules: DataFrame) -> DataFrame:
    """One row for each rule: (rule, verdict, host_len, key)."""
    cut = F.instr("rule", "/")
    host = ascii_lower(F.when(cut > 0, F.substring(F.col("rule"), F.lit(1), cut - 1)).otherwise(F.col("rule")))
    path = F.when(cut > 0, F.substring(F.col("rule"), cut, F.length("rule"))).otherwise("")
    once = rules.where(F.col("rule").isNotNull() & (F.col("rule") != "")).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    keyed = once.select("rule", "verdict", F.length(host).alias("host_len"), F.size(F.split(host, "[.]")).alias("depth"),
                        F.concat(_reversed(F.split(host, "[.]")), F.lit(_GAP), path).alias("key"))
    return keyed.groupBy("key").agg(F.max(F.struct("verdict", "rule", "host_len", "depth")).alias("r")).select("key", "r.*")


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has (rule, verdict)."""
    made = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made], host.alias("host"), path.alias("path"))

    keyed = materialize(_keyed(rules), "rules")
    # the rules open around each rule: those whose key is a prefix of its own
    prefixes = keyed.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.substring(F.col("key"), F.lit(1), F.col("n")).alias("open"))
    around = keyed.select(F.col("key").alias("open"), F.struct(F.length("rule").alias("len"), "host_len", "rule", "verdict", "key").alias("r"))
    stacks = prefixes.join(around, "open").groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("stack"))
    depth = keyed.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))

    addresses = rows.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", "[.]")
    levels = F.least(F.size(labels), F.col("depth"))
    lookups = addresses.join(F.broadcast(depth)).where("depth > 0").select(
        "host", "path", labels.alias("labels"), F.explode(F.sequence(F.lit(1), levels)).alias("d"),
    ).select("host", "path", F.concat(_reversed(F.col("labels"), F.col("d")), F.lit(_GAP), "path").alias("key"), F.lit(0).cast("long").alias("is_rule"))
    events = lookups.unionByName(keyed.select(F.lit("").alias("host"), F.lit("").alias("path"), "key", F.lit(1).cast("long").alias("is_rule")))
    swept = ordered_scan(events.withColumn("turn", 1 - F.col("is_rule")), ["key", "turn", "host", "path"], running={"opened": "is_rule"}, rank=None)

    numbered = swept.where("is_rule = 1").select("key", (F.col("opened") + 1).alias("opened")).join(stacks, "key").select("opened", "stack")
    hit = swept.where("is_rule = 0").join(numbered, "opened")
    active = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    best = hit.select("host", "path", F.array_max(active).alias("best")).where("best IS NOT NULL")
    verdicts = best.groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", "best.rule", "best.verdict")
    judged = rows.join(verdicts, ["host", "path"], "left")
    kept = [c for c in rows.columns if c not in ("host", "path")]
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


_VALUES = ", ".join(f"('{r}', '{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for r, v in RULES)
_SQL = f"""
WITH rules(rule, verdict, rh, rp) AS (VALUES {_VALUES}),
p AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT h.*, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC NULLS LAST, length(rh) DESC) AS k
      FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query("op1_url_filter", _SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter(pages, rules).drop("url")
