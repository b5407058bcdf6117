"""Checkpoints and distributed connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list, by: str, how: str = "left") -> DataFrame:
    """Join on `key`, whose values are unique in `right`. Rows of the few `hot` values (a bounded list) are dealt by a hash of `by` as well."""
    if not hot:
        return left.join(right, key, how)
    salts = min(1000, max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by, F.lit(5)), F.lit(salts))).otherwise(0).cast("int"))
    right = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hot_values(counts: DataFrame, key: str, n: str = "n", most: int = 1000) -> list:
    """Values of `key` that hold a `most`-th of all rows or more: never more than `most`."""
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    return [r[0] for r in counts.filter((F.col(n) > 1) & (F.col(n) * most >= total)).select(key).collect()]


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the least node reachable) of undirected edges (a, b), by alternating large and small stars.

    Each round joins every edge to the least neighbour of its end: minima are
    combined before the shuffle and the joins can be split by AQE, so a node
    with very many neighbours costs no single task. Edges are checkpointed each
    round; rounds end when none changes. Loops and repeats are ignored.
    """
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    edges = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def extended(groups_of: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after further edges (a, b): only the components they join are run again, each as one node."""
    ends = lambda e, x: e.join(groups_of.select(F.col("node").alias(x), F.col("component").alias("_c")), x, "left").withColumn(x, F.coalesce("_c", x)).drop("_c")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    old = groups_of.unionByName(nodes.join(groups_of, "node", "left_anti").select("node", F.col("node").alias("component")))
    joined = components(ends(ends(edges, "a"), "b")).select(F.col("node").alias("component"), F.col("component").alias("_c"))
    counts = old.groupBy("component").agg(F.count("*").alias("n"))
    return checkpoint(spread_join(old, joined, "component", hot_values(counts, "component"), "node").select("node", F.coalesce("_c", "component").alias("component")))
