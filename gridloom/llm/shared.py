"""What the operators of this subpackage have in common: shared storage and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.store import Rounds, new_path
from gridloom.sources.store import kept as stored

__all__ = ["connected_components", "new_path", "partitions", "plain", "small_batches", "stored"]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets how many rows (of whole texts) a Python task is handed at once, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that other columns of the input never clash with an operator's."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges`` (two long columns); component: the smallest node reached.

    Alternates two star operations until the edges no longer change. Each is a partially aggregated
    minimum and an equi-join, whose hot keys adaptive execution splits; nothing is gathered in one
    task or on the driver. Every round is written to the shared folder, which cuts the lineage, and
    takes the place of the round before it.
    Rows with a null end and self-loops add nothing.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()

    def both(x: DataFrame) -> DataFrame:
        return x.select("u", "v").union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(x: DataFrame) -> DataFrame:
        """Every neighbour larger than u hangs on the smallest of u and its neighbours."""
        every = both(x)
        least = every.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return every.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(x: DataFrame) -> DataFrame:
        """u and its smaller neighbours hang on the smallest of them."""
        least = x.groupBy("u").agg(F.min("v").alias("m"))
        moved = x.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def digest(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.max(F.xxhash64("u", "v"))).first())

    rounds = Rounds(edges.sparkSession, "links")
    now = rounds.keep(pairs)
    before, after = None, digest(now)
    while after[0] and after != before:
        now = rounds.keep(small(large(now)))
        before, after = after, digest(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
