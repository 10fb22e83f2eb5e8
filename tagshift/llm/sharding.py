"""Sharding by extendible hashing.

A row's hash is cut from the MD5 of its key and of its text. The directory is indexed by the leading
bits: a bucket over the byte limit is split on one more bit, any other bucket stays as it is, so a
shard is the shortest prefix whose rows fit. Byte sums are taken once at a depth that should leave
few oversized buckets, summed up to every shorter prefix, and the shortest that fits is looked up;
only rows of buckets that are still too large go on to more bits. The directory stays a table.

Rows that share all bits are copies of each other; a bucket of them is cut into overflow shards
(``bits.0``, ``bits.1``, ...) of as many copies as fit. A row that is larger than the limit by
itself gets a shard of its own, marked by ``shard_bytes`` over the limit: no cut of a text is made.

Defined cases: null keys and texts hash as empty strings, a null text has 0 bytes. Repeated rows get
equal hashes and so lie in one bucket or its overflow. An empty table gives no shards. Columns of
the input other than the key are not returned; ``write_shards`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.llm.base import documents, query
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize

#: small, so that the given tables split
SHARD_BYTES = 1 << 20
BITS, STEP = 60, 6


def _hashed(docs: DataFrame, key: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), F.md5(body)))
    return [F.octet_length(body).cast("long").alias("n_bytes"), mark.alias("mark"),
            F.conv(F.substring(mark, 1, BITS // 4), 16, 10).cast("long").alias("hash")]


def _prefix(bits: Column, depth: Column, of: int = BITS) -> Column:
    return F.call_function("shiftright", bits, (F.lit(of) - depth).cast("int"))


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes), one row for each document."""
    rows = materialize(docs.select(F.col(f"`{key}`"), *_hashed(docs, key, text)), "hashes")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    fine = min(BITS, max(1, (total // limit).bit_length() + STEP // 2))
    placed, rest = [], rows.withColumn("from", F.lit(0))
    while True:
        at = rest.withColumn("fine", _prefix(F.col("hash"), F.lit(fine)))
        sums = at.groupBy("fine", "from").agg(F.sum("n_bytes").alias("bytes"))
        levels = sums.select("fine", "bytes", F.explode(F.sequence("from", F.lit(fine))).alias("depth"))
        levels = levels.withColumn("prefix", _prefix(F.col("fine"), F.col("depth"), fine))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
        leaf = levels.join(fits, ["depth", "prefix"]).groupBy("fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        found = materialize(at.join(leaf, "fine", "left").select(*rows.columns, "leaf"), "placed")
        inside = found.where("leaf IS NOT NULL")
        placed.append(inside.select(key, "n_bytes", F.substring(F.lpad(F.bin("leaf.prefix"), BITS, "0"), F.lit(BITS + 1) - F.col("leaf.depth"), F.col("leaf.depth")).alias("shard"),
                                    "leaf.depth", "leaf.shard_bytes"))
        rest = found.where("leaf IS NULL").drop("leaf")
        if rest.isEmpty():
            break
        if fine == BITS:
            placed.append(_overflow(rest, key, limit))
            break
        rest, fine = rest.withColumn("from", F.lit(fine + 1)), min(BITS, fine + STEP)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _overflow(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Buckets that no bit can split: copies of one row, dealt in sort order."""
    turn = F.monotonically_increasing_id()
    ranked = ordered_scan(materialize(rows.withColumn("turn", turn), "overflow"), ["turn"], by=["hash", "mark"])
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    part = F.floor(F.col("rank") / fit).cast("long")
    out = ranked.select(key, "n_bytes", F.concat(F.lpad(F.bin("hash"), BITS, "0"), F.lit("."), F.col("mark"), F.lit("."), part).alias("shard"), F.lit(BITS).alias("depth"))
    sums = out.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return out.join(sums, "shard").select(key, "n_bytes", "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Writes the documents, one folder for each shard; keys must be unique for that."""
    at = shards(docs, key, text, limit).select(key, "shard")
    joined = docs.join(at, docs[key].eqNullSafe(at[key])).drop(at[key])
    joined.repartition("shard").write.partitionBy("shard").parquet(path)


_SQL = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS b FROM d, (SELECT unnest(range(0, 31)) AS depth) ks),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS k FROM l WHERE b <= {SHARD_BYTES})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INTEGER)) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes
FROM f WHERE k = 1
"""


@query("op6_sharding", _SQL)
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))
