"""Scans and sinks: every query that writes uses a fresh folder and reads its own output back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagshift.catalog.base import B, R, big, mass_of, query, r, sql, unsigned
from tagshift.functions import jets as J
from tagshift.operators import hist as H
from tagshift.plans.models import region_coupling
from tagshift.operators.blocks import round_robin_blocks
from tagshift.sources import fixtures as fx
from tagshift.sources import logs
from tagshift.sources import tables as T
from tagshift.sources.store import materialize, new_path
from tagshift.streaming.ingest import append_new_files


@query("a01_event_scan", sql("events4", f"""SELECT {B('event_id')} AS event_id, tag, region, {R('weight', 4)} AS weight, {R('m4j', 3)} AS m4j,
    {R('sT', 4)} AS sT FROM events4"""))
def event_scan(spark, d):
    path = new_path(spark, "events")
    fx.events(spark, d).write.parquet(path)
    return T.scan(spark, path).select(
        "event_id", "tag", "region", r("weight", 4).alias("weight"), r("m4j", 3).alias("m4j"), r("sT", 4).alias("sT")
    )


@query("a02_column_pruned_scan", f"""SELECT l_returnflag, {B('count(*)')} AS n, {R('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY l_returnflag""")
def column_pruned_scan(spark, d):
    df = T.scan(spark, f"{d}/lineitem.parquet", columns=["l_returnflag", "l_extendedprice"])
    return df.groupBy("l_returnflag").agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("l_extendedprice"), 2).alias("total"))


@query("a03_optional_columns", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderpriority FROM orders")
def optional_columns(spark, d):
    wanted = {"o_orderkey": "bigint", "o_custkey": "int", "o_orderpriority": "string", "o_clerk": "string"}
    return T.optional_columns(fx.table(spark, d, "orders"), wanted)


@query("a04_multi_file_scan", f"SELECT {B('count(*)')} AS n, {R('sum(o_totalprice)', 2)} AS total FROM orders")
def multi_file_scan(spark, d):
    root = new_path(spark, "eras")
    fx.table(spark, d, "orders").select("o_orderstatus", "o_totalprice").write.partitionBy("o_orderstatus").parquet(root)
    df = T.scan(spark, f"{root}/o_orderstatus=F", f"{root}/o_orderstatus=[!F]*", columns=["o_totalprice"])
    return df.agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("a05_chunked_append", f"""SELECT o_orderstatus, {B('count(*)')} AS n, {R('sum(o_totalprice / 1000)', 4)} AS total FROM orders GROUP BY o_orderstatus""")
def chunked_append(spark, d):
    """Two deliveries of raw files; the second call must pick up only the new ones."""
    root = new_path(spark, "chunks")
    raw, out, progress = f"{root}/raw", f"{root}/features", f"{root}/progress"
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    convert = lambda df: df.withColumn("price_k", F.col("o_totalprice") / 1000)
    for delivery in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        T.append(orders.where(delivery), raw)
        append_new_files(spark, raw, out, progress, convert)
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("price_k"), 4).alias("total")
    )


@query("a06_feature_sink", sql("dij", f"""SELECT region, {B('count(*)')} AS n, {R('max(CAST(m01 AS FLOAT))', 3)} AS max_m01,
    {R('min(CAST(dR23 AS FLOAT))', 5)} AS min_dr23 FROM dij GROUP BY region"""))
def feature_sink(spark, d):
    path = new_path(spark, "features")
    T.write_features(J.with_dijets(fx.events(spark, d)).select("event_id", "region", "m01", "dR23"), path)
    return spark.read.parquet(path).groupBy("region").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.max("m01"), 3).alias("max_m01"), r(F.min("dR23"), 5).alias("min_dr23")
    )


@query("a07_region_export", sql("events4", f"SELECT region, {B('count(*)')} AS n, {R('sum(weight)', 4)} AS sumw FROM events4 GROUP BY region"))
def region_export(spark, d):
    path = new_path(spark, "regions")
    T.write_by_region(fx.events(spark, d).select("event_id", "region", "weight"), path)
    return spark.read.parquet(path).groupBy("region").agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("weight"), 4).alias("sumw"))


def _array_sql() -> str:
    forms = {
        "PtEtaPhi": [x for i in range(4) for x in (f"pt{i}", f"eta{i}", unsigned(f"phi{i}"))],
        "PtEtaPhiM": [x for i in range(4) for x in (f"pt{i}", f"eta{i}", f"phi{i}", mass_of(str(i)))],
        "PxPyPzE": [f"{c}{i}" for i in range(4) for c in ("px", "py", "pz", "e")],
    }
    return sql("events4", " UNION ALL ".join(
        f"SELECT region, '{form}' AS form, {B(str(k))} AS slot, {R(f'sum({x})', 2)} AS total FROM events4 GROUP BY region"
        for form, terms in forms.items() for k, x in enumerate(terms)
    ))


@query("a08_kinematic_arrays", _array_sql())
def kinematic_arrays(spark, d):
    e = fx.events(spark, d)
    out = None
    for form in ("PtEtaPhi", "PtEtaPhiM", "PxPyPzE"):
        path = new_path(spark, form)
        T.write_by_region(T.kinematic_arrays(e, form), path)
        x = spark.read.parquet(path).select("region", F.posexplode("features").alias("slot", "x"))
        part = x.groupBy("region", big("slot").alias("slot")).agg(r(F.sum("x"), 2).alias("total")).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out


@query("a09_weight_vector", sql("events4", f"SELECT {B('event_id')} AS event_id, {R('weight', 4)} AS weight FROM events4"))
def weight_vector(spark, d):
    return fx.events(spark, d).select("event_id", r("weight", 4).alias("weight"))


@query("a10_replace_column", sql("events4", f"""SELECT region, {B('count(*)')} AS n, {R("sum(CASE WHEN region IN ('CR', 'SR') THEN h ELSE 0 END)", 4)} AS sum_score
    FROM events4 GROUP BY region"""))
def replace_column(spark, d):
    e = fx.events(spark, d)
    path = new_path(spark, "stored")
    e.select("event_id", "region", "weight", F.lit(-1.0).alias("FvT")).write.parquet(path)
    scores = e.where(F.col("region").isin("CR", "SR")).select("event_id", F.col("h").alias("FvT"))
    version = T.replace_column(spark, path, scores, "FvT", default=0.0)
    return spark.read.parquet(version).groupBy("region").agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("FvT"), 4).alias("sum_score"))


_BIN = "greatest(0, least(41, floor((sT - 150) * 40 / 400) + 1))"


@query("a11_histogram_catalogue", sql("events4", f"""SELECT region, 'h4b' AS sample, {B(_BIN)} AS bin,
      {R("sum(weight) * CASE WHEN region = 'SR' THEN 2 ELSE 1 END", 4)} AS sumw
    FROM events4 WHERE tag = '4b' AND region IN ('CR', 'SR') GROUP BY region, {_BIN}"""))
def histogram_catalogue(spark, d):
    """The SR histogram is written again at scale 2; the CR folder stays as it was."""
    path = new_path(spark, "catalogue")
    e = fx.events(spark, d).where("tag = '4b'").withColumn("sample", F.lit("h4b"))
    v = {"sT": ("sT", (40, 150.0, 550.0))}
    T.write_catalogue(H.fill(e.where("region IN ('CR', 'SR')"), v, ["region", "sample"]), path)
    T.write_catalogue(H.fill(e.where("region = 'SR'"), v, ["region", "sample"], scale=2.0), path)
    return spark.read.parquet(path).select("region", "sample", big("bin").alias("bin"), r("sumw", 4).alias("sumw"))


@query("a12_file_facts", f"""SELECT year, is_data, {B('count(*)')} AS n FROM
    (SELECT CAST(CASE WHEN o_orderstatus = 'F' THEN 2016 WHEN o_orderstatus = 'O' THEN 2017 ELSE 2018 END AS INTEGER) AS year,
            o_orderstatus <> 'O' AS is_data FROM orders) t GROUP BY year, is_data""")
def file_facts(spark, d):
    root = new_path(spark, "named")
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    folders = {"data2016": "o_orderstatus = 'F'", "ttbar2017": "o_orderstatus = 'O'", "data2018": "o_orderstatus NOT IN ('F', 'O')"}
    for name, rows in folders.items():
        orders.where(rows).write.parquet(f"{root}/{name}")
    df = T.with_file_facts(T.scan(spark, *[f"{root}/{n}" for n in folders]))
    return df.groupBy("year", "is_data").agg(big(F.count(F.lit(1))).alias("n"))


# an epoch is a stretch of five days, so that every epoch of a run has both kinds of line
_EPOCHS = """SELECT event_type AS run, CAST((day(ts) - 1) // 5 AS INTEGER) AS epoch, CASE WHEN user_id % 2 = 0 THEN 'validation' ELSE 'training' END AS split,
    avg(value) / 100 AS loss, max(value) / 100 AS stat, min(value) * 10 AS auc FROM events GROUP BY 1, 2, 3"""


def epoch_metrics(spark, d):
    e = fx.table(spark, d, "events").select("event_type", "ts", "user_id", "value")
    return e.groupBy(
        F.col("event_type").alias("run"), F.floor((F.day("ts") - 1) / 5).cast("int").alias("epoch"),
        F.when(F.col("user_id") % 2 == 0, "validation").otherwise("training").alias("split"),
    ).agg(
        (F.avg("value") / 100).alias("loss"), (F.max("value") / 100).alias("stat"), (F.min("value") * 10).alias("auc")
    )


@query("a13_training_log", f"SELECT run, epoch, split, {R('stat', 2)} AS stat, {R('auc', 2)} AS auc FROM ({_EPOCHS}) t")
def training_log(spark, d):
    path = new_path(spark, "logs")
    logs.log_lines(epoch_metrics(spark, d), 6).write.partitionBy("run").text(path)
    return logs.read_history(spark, path).select("run", "epoch", "split", r("stat", 2).alias("stat"), r("auc", 2).alias("auc"))


@query("j08_metric_history", f"SELECT run, epoch, split, {R('loss', 6)} AS loss, {R('stat', 4)} AS stat, {R('auc', 4)} AS auc FROM ({_EPOCHS}) t")
def metric_history(spark, d):
    """History table grown by one append for each half of the run."""
    path = new_path(spark, "history")
    m = epoch_metrics(spark, d)
    for half in ("epoch <= 2", "epoch > 2"):
        T.append(m.where(half), path)
    return spark.read.parquet(path).select("run", "epoch", "split", r("loss").alias("loss"), r("stat", 4).alias("stat"), r("auc", 4).alias("auc"))


@query("a14_block_store", sql("coupling", f"""SELECT {B('block')} AS block, {B('count(*)')} AS n_cells, {B('count(DISTINCT src_id)')} AS n_src, {B('count(DISTINCT tgt_id)')} AS n_tgt,
    {R('sum(value)')} AS mass, {R('sum(value * src_x)', 4)} AS source_sT, {R('sum(value * tgt_x)', 4)} AS target_sT FROM coupling GROUP BY block"""))
def block_store(spark, d):
    """Couplings by block, written and read again: cells, and the mean sT that each side gives."""
    path = new_path(spark, "blocks")
    e = materialize(fx.events(spark, d).where("tag = '3b'").select("event_id", "region", "sT", "weight"), "three")
    T.write_blocks(region_coupling(materialize(round_robin_blocks(e, 200), "blocks")), path)
    x = e.select("event_id", "sT")
    cells = spark.read.parquet(path).join(x.toDF("src_id", "s"), "src_id").join(x.toDF("tgt_id", "t"), "tgt_id")
    return cells.groupBy(big("block").alias("block")).agg(
        big(F.count(F.lit(1))).alias("n_cells"), big(F.count_distinct("src_id")).alias("n_src"), big(F.count_distinct("tgt_id")).alias("n_tgt"),
        r(F.sum("value")).alias("mass"), r(F.sum(F.col("value") * F.col("s")), 4).alias("source_sT"), r(F.sum(F.col("value") * F.col("t")), 4).alias("target_sT"),
    )
