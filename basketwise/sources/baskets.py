"""Transactions from other tables and from commit logs, and the filters over a history.

A history is a table (by.., seq long, tx_id, label, entities array<string>): seq grows with time, within each group of
the `by` columns if there are any. Positions are given before anything is filtered out, so empty and oversized transactions hold theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketwise.functions.scoring import abbrev
from basketwise.sources.scratch import written


def _indexed(df: DataFrame, name: str) -> DataFrame:
    """Positions 0, 1, .. in the order in which df has its rows. Rows are counted a partition, and each adds the number of rows
    in the partitions before; rows are written with their partition, so that both passes see the same ones."""
    here = df.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"), "*")
    here = written(here, "numbered")
    sizes = sorted(here.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    before = df.sparkSession.createDataFrame(starts, "_p int, _start long")
    return here.join(F.broadcast(before), "_p").select((F.col("_start") + F.col("_i")).alias(name), *df.columns)


def numbered(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Positions 0, 1, .. in the order of the columns: a range sort over all tasks, no global window."""
    return _indexed(df.orderBy(*order), name)


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of a log: records start with 0x01, then id 0x1f subject, then one entity a line; newest first in
    the file, numbered oldest first. Of several files the first by name holds the newest records; they may be split."""
    raw = spark.read.option("lineSep", "\x01").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")
    )
    # Spark deals out splits by size: the order is that of files, of places in them, and of rows of one split
    records = numbered(written(raw.where(F.trim("value") != ""), "commit-log"), "file", "start", "i", name="at")
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(F.translate(x, "\r\t", "  ")))
    head = F.split(F.element_at(F.split("value", "\n"), 1), "\x1f", 2)
    out = records.select(
        "at", abbrev(F.trim(head[0])).alias("tx_id"), F.trim(F.coalesce(F.get(head, F.lit(1)), F.lit(""))).alias("label"),
        F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != "").alias("entities"),
    )
    last = records.agg(F.max("at").alias("last"))
    return out.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("at")).alias("seq"), "tx_id", "label", "entities")  # one row


def assemble_transactions(
    df: DataFrame, tx_cols: Sequence[str], entity_col: str, order_cols: Sequence[str], label: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Transactions of a long table: rows that agree in tx_cols are one, ordered by the least of order_cols. Entities come sorted and
    distinct; rows without one make no entity but still a transaction."""
    tx_id = F.concat_ws("/", *[F.col(c).cast("string") for c in tx_cols])
    made = df.groupBy(*by, *tx_cols).agg(
        F.array_sort(F.collect_set(entity_col)).alias("entities"), F.min(F.struct(*order_cols)).alias("_order"),
        (F.min(label) if label else F.lit(None).cast("string")).alias("label"),
    )
    made = made.select(*by, "_order", tx_id.alias("tx_id"), "label", "entities")
    if by:
        placed = numbered(made, *by, "_order", "tx_id", name="_at")  # a group's rows follow each other, so its first place is enough
        first = placed.groupBy(*by).agg(F.min("_at").alias("_first"))
        return placed.join(first, list(by)).select(*by, (F.col("_at") - F.col("_first")).alias("seq"), "tx_id", "label", "entities")
    flat = made.select(F.col("_order.*"), "tx_id", "label", "entities")
    return numbered(flat, *order_cols, "tx_id").select("seq", "tx_id", "label", "entities")


def clean_transactions(tx: DataFrame, cap: int) -> DataFrame:
    """Distinct entities; transactions without any or with more than cap go. n_raw keeps the length before."""
    own = tx.withColumn("n_raw", F.size("entities")).withColumn("entities", F.array_sort(F.array_distinct("entities")))
    return own.where(F.size("entities").between(1, cap))


def drop_merges(tx: DataFrame) -> DataFrame:
    """Transactions with at most one parent; null parents count as none."""
    return tx.where(F.coalesce(F.size("parents"), F.lit(0)) <= 1) if "parents" in tx.columns else tx


def since(tx: DataFrame, marker: str | None) -> DataFrame | None:
    """Transactions after the one with that id; None where there is no such one, so all must be read again."""
    found = tx.where(F.col("tx_id") == marker).agg(F.max("seq")).first()[0] if marker is not None else None
    return None if found is None else tx.where(F.col("seq") > found)


def history_window(tx: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The n newest transactions (of each group); 0 means all."""
    if n == 0:
        return tx
    if by:
        last = tx.groupBy(*by).agg(F.max("seq").alias("_last"))
        return tx.join(last, list(by)).where(F.col("seq") > F.col("_last") - n).drop("_last")
    last = tx.agg(F.max("seq")).first()[0]
    return tx if last is None else tx.where(F.col("seq") > last - n)


def touches(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tx.select(*by, "seq", "tx_id", F.explode(F.array_distinct("entities")).alias("entity"))


def touching(tx: DataFrame, entities: DataFrame, limit: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """For each entity its newest transactions, newest first (rank 1..), with full entity lists; limit 0 means all."""
    hits = touches(tx, by).join(entities.select(*by, "entity").distinct(), [*by, "entity"])
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "entity").orderBy(F.desc("seq"))))
    if limit:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select(*by, "entity", "rank", "seq").join(tx, [*by, "seq"])


def changed_since(base: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entities whose hash differs between two snapshots (entity, hash), or that only one of them has."""
    b, c = base.select(*by, "entity", F.col("hash").alias("_b"), F.lit(True).alias("_in_b")), current.select(
        *by, "entity", F.col("hash").alias("_c"), F.lit(True).alias("_in_c")
    )
    both = b.join(c, [*by, "entity"], "full_outer")
    return both.where(F.col("_in_b").isNull() | F.col("_in_c").isNull() | ~F.col("_b").eqNullSafe(F.col("_c"))).select(*by, "entity").distinct()


def holdout_split(tx: DataFrame, holdout: int) -> tuple[DataFrame, DataFrame, int]:
    """(older, newest, length of newest): the newest min(holdout, half of all) transactions, with k = 0, 1, .."""
    total = tx.count()
    size = min(holdout, total // 2)
    cut = total - size
    return tx.where(F.col("seq") < cut), tx.where(F.col("seq") >= cut).withColumn("k", F.col("seq") - cut), size


def with_previous(versions: DataFrame, content: str, by: Sequence[str] = (), long: bool = False) -> DataFrame:
    """before and after of each version of an entity; the first has no before. long: an entity may have more versions than one task
    should sort."""
    if long:
        return _with_previous_row(versions, content, [*by, "entity"]).withColumnRenamed(content, "after")
    w = Window.partitionBy(*by, "entity").orderBy("seq")
    return versions.withColumn("before", F.lag(content).over(w)).withColumnRenamed(content, "after")


def _with_previous_row(versions: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """versions with `before`: the content of the row before by keys and seq, where it has the same keys. Rows are range-sorted and
    written with their partition; the first of each looks at the last of the partition before, which is one row a partition."""
    own = versions.orderBy(*keys, "seq")
    here = written(own.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), *versions.columns), "versions")
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(content).alias("content"))
    ends = here.groupBy("_p").agg(F.max_by(row, "_i").alias("_end"))
    starts = ends.select("_p", F.lag("_end").over(Window.orderBy("_p")).alias("_start"))  # a row a partition
    inside = F.lag(row).over(Window.partitionBy("_p").orderBy("_i"))
    told = here.join(F.broadcast(starts), "_p").withColumn("_row", F.coalesce(inside, F.col("_start")))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col("_row")[f"k{i}"].eqNullSafe(F.col(c))
    return told.select(*versions.columns, F.when(F.col("_row").isNotNull() & same, F.col("_row")["content"]).alias("before"))
