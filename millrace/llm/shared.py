"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """How many ways to deal packed rows: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    The folder is the one of ``spark.checkpoint.dir``; only a local session without that
    setting gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="millrace-llm-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def n_words(text: Column) -> Column:
    """Number of runs of other characters than blank, tab to carriage return; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): rows (node, root).

    In a round every node takes the node of least rank within two links, where ranks are
    hashes that change with the round. Nodes of one label become one, and the links
    between labels go into the next round. Stars vanish in one round, chains shrink by a
    constant share. Nodes without a link to another node have no row.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    found: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        ranked = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("id"))
        near = both.groupBy("a").agg(F.min(ranked("b")).alias("other")).select("a", F.least("other", ranked("a")).alias("best"))
        far = both.join(near.select(F.col("a").alias("b"), "best"), "b").groupBy("a").agg(F.min("best").alias("best"))
        label = cut(far.select(F.col("a").alias("node"), F.col("best.id").alias("up")))
        if found is None:
            found = label.select("node", F.col("up").alias("root"))
        else:
            up = label.select(F.col("node").alias("root"), "up")
            found = found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        edges = cut(
            edges.join(label.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
            .join(label.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        turn += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
