"""Connected components: of keyed graphs by rounds of joins, and of small graphs inside a task.

Alternating large-star and small-star rounds: each is two aggregations and two joins over edges, written as Parquet to the
shared folder of spark.checkpoint.dir. Nothing is gathered per component, so one may hold any share of the nodes.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROUNDS = 60


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder that the session names in spark.checkpoint.dir; a local session may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/quern-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """(stored(df), values of the aggregates counts over all its rows): they are observed while the rows are written, without another pass."""
    seen = Observation()
    return stored(df.observe(seen, *(c.alias(n) for n, c in counts.items()))), seen.get


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that shuffle, for tables that grow with the jobs.

    Sizes of stored files, and of what windows or lists unfold to, say little of the rows in memory: a side that looks small enough
    to be broadcast would pass whole through the driver.
    """
    return df.hint("merge")


def removed(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing needs any more."""
    spark, files = df.sparkSession, df.inputFiles()
    for folder in {f.rpartition("/")[0] for f in files if "/quern-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def labels(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, node, component of every node of edges (key, a, b); component is the smallest node reachable inside the key.

    Self-loops, repeated edges and edges with nulls are ignored; an empty table gives no rows.
    """
    edges = edges.filter("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = stored(edges), None
    for _ in range(ROUNDS):
        after = edges.agg(F.count("*"), F.sum(F.xxhash64(*key, "a", "b").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
        both = edges.unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        # Every larger neighbour of a node gets that neighbourhood's smallest node.
        least = both.groupBy(*key, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, [*key, "a"]).select(*key, F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Every node and its smaller neighbours get the smallest of them.
        least = large.groupBy(*key, "b").agg(F.min("a").alias("m"))
        moved = large.join(least, [*key, "b"]).filter("a <> m").select(*key, F.col("m").alias("a"), F.col("a").alias("b"))
        old, edges = edges, stored(moved.union(least.select(*key, F.col("m").alias("a"), "b")).filter("a < b").distinct())
        removed(old)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(*key, F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(*key, F.col("b").alias("node"), F.col("a").alias("component")).union(roots)


def components(nodes: DataFrame, edges: DataFrame, key: list[str], node: str) -> DataFrame:
    """key, node, component of every node; a node without edges is its own component. edges: key, a, b."""
    found = labels(edges, key).withColumnRenamed("node", node)
    return nodes.select(*key, node).distinct().join(found, [*key, node], "left").withColumn("component", F.coalesce("component", node))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with edges (a, b), the smallest node that each reaches."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    return root
