"""Candidate pools of documents that share a key, and the state of pools in a staged process."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

MOST_DOCS = 20


def find(rows: DataFrame, keys: list[str], most: int = MOST_DOCS, cross: bool = True) -> DataFrame:
    """rows (keys, doc, cluster) -> (key, docs): keys that are not empty with 2 to `most` documents, in two clusters or more if cross.

    The counts come first, as an aggregate; only rows of the keys that are left are gathered.
    """
    filled = rows.where(" and ".join(f"{k} is not null and cast({k} as string) <> ''" for k in keys))
    sizes = filled.groupBy(*keys).agg(F.countDistinct("doc").alias("n"), F.countDistinct("cluster").alias("c"))
    good = sizes.where((F.col("n") >= 2) & (F.col("n") <= most) & ((F.col("c") >= 2) if cross else F.lit(True))).select(*keys)
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return filled.join(good, keys).groupBy(key.alias("key")).agg(F.sort_array(F.collect_set("doc")).alias("docs"), F.sort_array(F.collect_set("cluster")).alias("clusters"))


def report(pools: DataFrame) -> DataFrame:
    """Number, median, 90th percentile and largest size."""
    n = F.size("docs")
    return pools.agg(F.count("*").alias("pools"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.9).alias("p90"), F.max(n).cast("bigint").alias("largest"))


def build(pools: list[tuple[str, dict]], kind: str, n: int, seed_sizes: list[int], seed: int, seeded: bool) -> list[dict]:
    """n pools in a seeded order; pools: (key, cluster -> documents). Seeds: one document of each of some clusters."""
    rng = random.Random(seed)
    order = sorted(pools, key=lambda p: p[0])
    rng.shuffle(order)
    out = []
    for i, (key, by_cluster) in enumerate(order[:n]):
        seeds = []
        if seeded:
            size = rng.choice(seed_sizes)
            names = sorted(by_cluster)
            seeds = [rng.choice(sorted(by_cluster[c])) for c in rng.sample(names, min(size, len(names)))]
        docs = sorted({d for ds in by_cluster.values() for d in ds})
        out.append({"pool_id": f"{kind}-{i:04d}", "type": kind, "key": key, "order": i, "doc_ids": docs, "seed_doc_ids": seeds})
    return out


def states(pools: DataFrame, stages: list[tuple[str, DataFrame, str]], done: str = "done") -> DataFrame:
    """(pool, state): the state that the first missing stage names; stages in order: (name, table with pool, state if missing)."""
    state = F.lit(done)
    out = pools.select("pool")
    for name, found, _ in stages:
        out = out.join(found.select("pool").distinct().withColumn(name, F.lit(True)), "pool", "left")
    for name, _, missing in reversed(stages):
        state = F.when(F.col(name).isNull(), missing).otherwise(state)
    return out.select("pool", state.alias("state"))


def part_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as keys of orders; clusters are months."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", F.col("o_orderkey").alias("doc"), F.date_format("o_orderdate", "yyyy-MM").alias("cluster"))
    return find(rows, ["l_partkey"])


def pools_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pools(spark, sf_dir).select("key", F.size("docs").cast("bigint").alias("n_docs"), F.size("clusters").cast("bigint").alias("n_clusters"), F.array_min("docs").alias("first_doc"))


def pools_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(part_pools(spark, sf_dir))


def pool_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by stage: priced (over 1,000), shipped (an item has been), returned (an item has been)."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumn("pool", F.col("l_orderkey"))
    pools = orders.withColumn("pool", F.col("o_orderkey"))
    stages = [
        ("generated", pools.where("o_totalprice > 1000"), "gen_wait"),
        ("prepared", items.where("l_linestatus = 'F'"), "prepare"),
        ("checked", items.where("l_returnflag = 'R'"), "check_wait"),
    ]
    return states(pools, stages).groupBy("state").agg(F.count("*").alias("n"))


_POOLS = """p as (select l_partkey::varchar as key, count(distinct o_orderkey) as n_docs, count(distinct strftime(o_orderdate, '%Y-%m')) as n_clusters, min(o_orderkey) as first_doc
from lineitem join orders on l_orderkey = o_orderkey where l_partkey is not null group by l_partkey having n_docs between 2 and 20 and n_clusters >= 2)"""
QUERIES = {"pools_cross": pools_cross, "pools_report": pools_report, "pool_state": pool_state}
ORACLES = {
    "pools_cross": f"with {_POOLS} select * from p",
    "pools_report": f"with {_POOLS} select count(*) as pools, quantile_cont(n_docs, 0.5) as median, quantile_cont(n_docs, 0.9) as p90, max(n_docs) as largest from p",
    "pool_state": """select case when not o_totalprice > 1000 then 'gen_wait' when o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F') then 'prepare'
when o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') then 'check_wait' else 'done' end as state, count(*) as n from orders group by all""",
}
