"""Shared storage for intermediate tables, and connected groups over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.sources.scratch import new_path, release, shared_dir  # noqa: F401


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables whose readers are done."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def connected_groups(edges: DataFrame, name: str) -> DataFrame:
    """(node, grp) for every node of edges(a, b); grp is the smallest node of its connected group.

    Alternating large-star and small-star rounds: every node is re-hung under the smallest neighbour, so a chain
    of n nodes needs O(log n) rounds and no group is ever gathered in one task. Group keys with many neighbours are
    reduced by min() with map-side combine; the join that follows is an equi-join AQE may split.
    """
    current = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    before = None
    while True:
        # large star: larger neighbours of a node move to the node's smallest neighbour (or itself)
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = stash(large, name)
        # small star: smaller neighbours of a node, and the node, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        before_it, current = current, stash(small, name)
        discard(before_it, large)
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("grp"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("grp")).union(roots)


def scanned(docs: DataFrame, name: str) -> DataFrame:
    """docs if all its rows come straight from files, else written to the shared folder and read back. The question
    reads no column, only file footers."""
    return docs if docs.where(F.input_file_name() == "").isEmpty() else stash(docs, name)


def block_of(key: str, text: str, block_bytes: int) -> Column:
    """A name for a bounded part of a scanned table: one split of an input file, parted by a hash of the row into
    pieces of about block_bytes of the file. It depends on the row and where it is stored only, so every scan deals
    alike, and one task holds all of it."""
    pieces = F.greatest(F.lit(1), F.ceil(F.input_file_block_length() / F.lit(block_bytes)))
    return F.concat_ws(":", F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64(key, text), pieces))
