"""Index, mutes and findings on storage.

An index is a folder of levels and commits. A level is a folder of Parquet tables that holds what one update added; it is never
changed. A commit is one line of JSON in a folder of its number: it names the levels in order, oldest first, with a manifest of
each (files, rows and a checksum for each section), the settings, and the ledger of streams. A reader merges the levels of the
newest commit, so it sees a whole version or the one before. An update writes rows in proportion to what is new; when
the newest level has outgrown a share of the one before it, the two become one, so levels stay few and every row is
rewritten a logarithmic number of times. vacuum() deletes what no kept commit names.

Whatever can't be read as it was written (a commit, a missing or cut file, with verify="content" any changed row) makes the index
unusable as a whole: read_index gives None, and an update builds it again.

With `by` columns one index keeps many histories: all tables carry them, `heads` has a row a history, and a history that was
built again resets its rows of older levels.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from basketwise.config import MiningConfig
from basketwise.operators.mining import prune_labels
from basketwise.sources.running import running_sum
from basketwise.sources.scratch import lengths, listed, release, removed

FORMAT = 2
SECTIONS = ("counts", "pairs", "labels", "facet_stats", "facet_training", "locations", "heads", "group_resets", "facet_resets", "latest", "diffs", "touched")
IGNORES = "trigger string, hole string, until_trigger_changes long, created_at timestamp, note string"
#: Sections that are written at once.
WRITERS = 4
#: Pairs of levels that are made one at a time, while that takes no more than so many rounds.
ROUND_ROWS, MOST_ROUNDS = 1_000_000, 4
#: Seconds after which a commit that was begun and not finished is taken for given up.
UNFINISHED = 600
HEADS = "head string, seq long, transactions long, counted array<struct<after:bigint,upto:bigint>>"
#: Sections that may be absent, with their columns beside by.
OPTIONAL = {
    "facet_stats": "trigger string, companion string, facet string, n long, co long", "facet_training": "trigger string, companion string",
    "locations": "entity string, location string", "heads": HEADS, "group_resets": "", "facet_resets": "trigger string",
    "latest": "entity string, seq long, content string", "diffs": "seq long, entity string, facets array<string>",
    "touched": "seq long, entities array<string>",
}


@dataclass(frozen=True)
class Index:
    """counts(entity, n), pairs(entity_a, entity_b, co, recent, examples), labels(tx_id, label), facet_stats, facet_training,
    locations(entity, location); head is the id of the newest transaction counted. All tables have the `by` columns first.

    heads(by.., head, seq, transactions, counted): one row a history; counted are the stretches of seq that batch updates have
    counted. group_resets(by..) and facet_resets(by.., trigger) tell, in a level, what of older levels is void. latest, diffs and
    touched are what a stream of contents needs: last version of each structured entity, its diffs, and the transactions with one."""

    counts: DataFrame
    pairs: DataFrame
    labels: DataFrame
    facet_stats: DataFrame
    facet_training: DataFrame
    locations: DataFrame
    head: str | None = None
    transactions: int = 0
    config: MiningConfig = MiningConfig()
    heads: DataFrame | None = None
    group_resets: DataFrame | None = None
    facet_resets: DataFrame | None = None
    latest: DataFrame | None = None
    diffs: DataFrame | None = None
    touched: DataFrame | None = None
    by: tuple[str, ...] = ()
    #: These labels and what they were before pruning: where they are written, the pairs that are written prune them.
    unpruned: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def of(cls, spark: SparkSession, counts: DataFrame, pairs: DataFrame, labels: DataFrame, by: Sequence[str] = (), **rest) -> Index:
        for name in ("facet_stats", "facet_training", "locations"):
            if rest.get(name) is None:
                rest[name] = empty_section(spark, name, counts, by)
        return cls(counts, pairs, labels, by=tuple(by), **rest)


def empty_section(spark: SparkSession, name: str, like: DataFrame, by: Sequence[str]) -> DataFrame:
    """A table of that section without rows; its by columns have the types of those in like."""
    own = [f"{c} {like.schema[c].dataType.simpleString()}" for c in by]
    return spark.createDataFrame([], ", ".join([*own, OPTIONAL[name]] if OPTIONAL[name] else own))


# ---- merging levels ---------------------------------------------------------------------------------------------------


def merge_levels(levels: Sequence[Index]) -> Index:
    """One index of several levels, oldest first: counts add up, the newest examples of all stay, later heads and locations win, and
    what a later level resets is left out."""
    if len(levels) == 1:
        return levels[0]
    last, k = levels[-1], levels[-1].config.max_examples_per_pair
    by = list(last.by)

    def every(name: str) -> DataFrame | None:
        found = [(i, t) for i, x in enumerate(levels) if (t := getattr(x, name)) is not None]
        if not found:
            return None
        out = None
        for i, t in found:
            t = t.withColumn("_l", F.lit(i))
            out = t if out is None else out.unionByName(t)
        return out

    def alive(df: DataFrame | None, resets: DataFrame | None, keys: list[str]) -> DataFrame | None:
        """Without rows of levels before the last reset of their keys."""
        if df is None or resets is None or not keys:
            return df
        after = resets.groupBy(*keys).agg(F.max("_l").alias("_reset"))
        return df.join(after, keys, "left").where(F.col("_reset").isNull() | (F.col("_l") >= F.col("_reset"))).drop("_reset")

    groups = every("group_resets")
    own = {name: alive(every(name), groups, by) for name in SECTIONS if name != "group_resets"}
    triggers = own["facet_resets"]
    own["facet_stats"] = alive(own["facet_stats"], triggers, [*by, "trigger"])
    newest = F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, k)
    merged = {
        "counts": own["counts"].groupBy(*by, "entity").agg(F.sum("n").alias("n")),
        "pairs": own["pairs"].groupBy(*by, "entity_a", "entity_b").agg(F.sum("co").alias("co"), newest.alias("recent"))
        .withColumn("examples", F.transform("recent", lambda x: x["tx_id"])),
        "labels": own["labels"].groupBy(*by, "tx_id").agg(F.max_by("label", "_l").alias("label")),
        "facet_stats": own["facet_stats"].groupBy(*by, "trigger", "companion", "facet").agg(F.sum("n").alias("n"), F.sum("co").alias("co")),
        "facet_training": own["facet_training"].select(*by, "trigger", "companion").distinct(),
        "locations": own["locations"].groupBy(*by, "entity").agg(F.max_by("location", "_l").alias("location")),
    }
    if own["heads"] is not None:
        row = F.struct("head", "seq", "transactions", "counted")
        merged["heads"] = own["heads"].groupBy(*by).agg(F.max_by(row, "_l").alias("_h")).where("_h is not null").select(*by, "_h.*")
    if groups is not None:
        merged["group_resets"] = groups.select(*by).distinct()
    if triggers is not None:
        merged["facet_resets"] = triggers.select(*by, "trigger").distinct()
    if own["latest"] is not None:
        merged["latest"] = own["latest"].groupBy(*by, "entity").agg(F.max_by(F.struct("seq", "content"), F.struct("seq", "_l")).alias("_v")).select(*by, "entity", "_v.*")
    for name in ("diffs", "touched"):
        if own[name] is not None:
            merged[name] = own[name].drop("_l")
    return replace(last, **merged)


# ---- levels and commits -----------------------------------------------------------------------------------------------


def _checksums(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """(rows, sum of row hashes) of each table, in one job."""
    sums = None
    for name, t in tables.items():
        own = F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in sorted(t.columns)]).bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0))
        row = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), own.alias("sum"))
        sums = row if sums is None else sums.union(row)
    return {r["name"]: (r["rows"], r["sum"]) for r in sums.collect()} if sums is not None else {}


def _schema(section: Mapping) -> StructType:
    return StructType.fromJson(json.loads(section["schema"]))


def _with_examples(pairs: DataFrame) -> DataFrame:
    """Stored pairs with the ids of their examples, which are those of recent."""
    return pairs if "examples" in pairs.columns else pairs.withColumn("examples", F.transform("recent", lambda x: x["tx_id"]))


def _write_level(index: Index, path: str, rounds: int = 1) -> dict:
    """A new level and its manifest. Pairs are written in so many rounds by their first entity: what is shuffled at once is a part of them."""
    spark = index.counts.sparkSession
    name = uuid.uuid4().hex
    folder = f"{path}/levels/{name}"
    tables = {s: t for s in SECTIONS if (t := getattr(index, s)) is not None and t.columns}
    if "recent" in tables["pairs"].columns:  # the ids of examples stand there
        tables["pairs"] = tables["pairs"].drop("examples")
    write = lambda s: tables[s].write.option("compression", "zstd").parquet(f"{folder}/{s}")
    for i in range(rounds):
        some = tables["pairs"] if rounds == 1 else tables["pairs"].where(F.pmod(F.xxhash64("entity_a"), F.lit(rounds)) == i)
        some.write.mode("append").option("compression", "zstd").parquet(f"{folder}/pairs")
        release(spark)
    if index.unpruned is not None and index.unpruned[0] is index.labels:
        tables["labels"] = prune_labels(index.unpruned[1], _with_examples(spark.read.schema(tables["pairs"].schema).parquet(f"{folder}/pairs")), index.by)
    with ThreadPoolExecutor(WRITERS) as pool:  # most sections are small, so their jobs run side by side
        list(pool.map(write, [s for s in tables if s != "pairs"]))
    release(spark)
    sums = _checksums(spark, {s: spark.read.schema(t.schema).parquet(f"{folder}/{s}") for s, t in tables.items()})
    sections = {
        s: {"rows": sums[s][0], "sum": sums[s][1], "schema": t.schema.json(), "files": lengths(spark, f"{folder}/{s}")} for s, t in tables.items()
    }
    return {"folder": name, "sections": sections}


def _read_level(spark: SparkSession, path: str, level: Mapping, config: MiningConfig, by: Sequence[str]) -> Index:
    tables = {}
    for s, m in level["sections"].items():
        if m["rows"]:
            tables[s] = spark.read.schema(_schema(m)).parquet(f"{path}/levels/{level['folder']}/{s}")
        elif s not in ("group_resets", "facet_resets"):  # an empty one of these would cost every reader a join
            tables[s] = spark.createDataFrame([], _schema(m))
    return Index.of(spark, tables.pop("counts"), _with_examples(tables.pop("pairs")), tables.pop("labels"), by, config=config, **tables)


def _commit_numbers(spark: SparkSession, path: str) -> tuple[list[int], list[tuple[int, float]]]:
    """(numbers of finished commits, unfinished ones with the time of their last change)."""
    done, begun = [], []
    for name, at in listed(spark, f"{path}/commits"):
        inside = [n for n, _ in listed(spark, f"{path}/commits/{name}")]
        if "_SUCCESS" in inside or not name.isdigit():
            done.append(int(name))  # an error for any other name: damage
        else:
            begun.append((int(name), at))
    return sorted(done), begun


def _commits(spark: SparkSession, path: str, numbers: Sequence[int]) -> list[dict]:
    """The commits of these numbers; an error where one of them isn't as it was written."""
    folders = [f"{path}/commits/{n:012d}" for n in numbers]
    files = spark.read.format("binaryFile").load(folders).select("content").collect() if folders else []  # a line each
    commits = [json.loads(bytes(r[0]).decode()) for r in files]
    if any(not isinstance(c, dict) or "levels" not in c for c in commits) or sorted(c["number"] for c in commits) != sorted(numbers):
        raise ValueError("a commit can't be read")
    return sorted(commits, key=lambda c: c["number"])


def current_commit(spark: SparkSession, path: str) -> tuple[dict | None, bool]:
    """(newest commit, whether there is damage). A commit that was begun and not finished counts as never made."""
    try:
        numbers, _ = _commit_numbers(spark, path)
        return (_commits(spark, path, numbers[-1:])[0], False) if numbers else (None, False)
    except (PySparkException, Py4JJavaError, ValueError, KeyError):
        return None, True


def _commit(spark: SparkSession, path: str, before: Mapping | None, levels: list[dict], config: MiningConfig, by: Sequence[str], ledger: Mapping[str, int]) -> None:
    """The next commit; an error where another writer has made one meanwhile, or began one in the last minutes."""
    numbers, begun = _commit_numbers(spark, path)
    expected = -1 if before is None else before["number"]
    if (numbers[-1] if numbers else -1) != expected or any(n > expected and at > time.time() - UNFINISHED for n, at in begun):
        raise ValueError(f"another writer is at {path}")
    number = max([expected, *[n for n, _ in begun]]) + 1
    row = {"number": number, "format": FORMAT, "by": list(by), "training": config.training(), "levels": levels, "ledger": dict(ledger), "at": time.time()}
    line = spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("error").text(f"{path}/commits/{number:012d}")


def _own_heads(index: Index) -> Index:
    if index.heads is not None or index.by:
        return index
    rows = [(index.head, None, index.transactions, [])]
    return replace(index, heads=index.counts.sparkSession.createDataFrame(rows, HEADS))


def write_index(index: Index, path: str, batch: int | None = None, stream: str = "") -> None:
    """index as the only level of a new commit. The ledger of streams is kept, and takes note of the batch where one is given."""
    spark = index.counts.sparkSession
    before, damaged = current_commit(spark, path)
    ledger = dict(before["ledger"]) if before is not None else {}
    if batch is not None:
        ledger[stream] = batch
    level = _write_level(_own_heads(replace(index, group_resets=None, facet_resets=None)), path)
    if damaged:  # levels are named by their own commit only, so all that was there is void
        removed(spark, f"{path}/commits")
    _commit(spark, path, before, [level], index.config, index.by, ledger)


def append_level(delta: Index, path: str, ledger: Mapping[str, int] | None = None, ratio: float = 4.0) -> None:
    """delta as a new level after those of the newest commit. Levels at the end are made one while the one before has fewer
    than ratio times the rows of those after it."""
    spark, by = delta.counts.sparkSession, delta.by
    before, damaged = current_commit(spark, path)
    if before is None or damaged:
        raise ValueError(f"{path} has no index to add to")
    rows = lambda level: sum(m["rows"] for m in level["sections"].values())
    made = _write_level(delta, path)
    levels = [*before["levels"], *([made] if rows(made) else [])]
    if not rows(made):  # only the ledger moves
        _commit(spark, path, before, levels, delta.config, by, before["ledger"] | dict(ledger or {}))
        return
    start, size = len(levels) - 1, rows(levels[-1])
    while start > 0 and rows(levels[start - 1]) < ratio * size:
        start -= 1
        size += rows(levels[start])
    if start < len(levels) - 1:
        merged = merge_levels([_read_level(spark, path, x, delta.config, by) for x in levels[start:]])
        pruned = prune_labels(merged.labels, merged.pairs, by)
        merged = replace(merged, labels=pruned, unpruned=(pruned, merged.labels))
        rounds = min(MOST_ROUNDS, 1 + sum(x["sections"]["pairs"]["rows"] for x in levels[start:]) // ROUND_ROWS)
        if start == 0:  # nothing older is left to reset
            merged = replace(merged, group_resets=None, facet_resets=None)
        levels = [*levels[:start], _write_level(merged, path, rounds)]
        removed(spark, f"{path}/levels/{made['folder']}")  # no commit will name it
    _commit(spark, path, before, levels, delta.config, by, before["ledger"] | dict(ledger or {}))


def _whole(spark: SparkSession, path: str, levels: Sequence[Mapping], verify: str) -> bool:
    """Whether all files are there with their lengths; with verify="content" also rows and checksums, which reads all of them."""
    for level in levels:
        folder, sections = f"{path}/levels/{level['folder']}", level["sections"]
        if any(lengths(spark, f"{folder}/{s}") != m["files"] for s, m in sections.items()):
            return False
        if verify == "content":
            tables = {s: spark.read.schema(_schema(m)).parquet(f"{folder}/{s}") for s, m in sections.items()}
            if _checksums(spark, tables) != {s: (m["rows"], m["sum"]) for s, m in sections.items()}:
                return False
    return True


def read_index(spark: SparkSession, path: str, config: MiningConfig, by: Sequence[str] = (), verify: str = "files") -> Index | None:
    """The newest version, with today's query settings; None where there is none, where it is damaged, or where its format, training
    settings or by columns differ. Labels may include some that no example cites any more."""
    commit, damaged = current_commit(spark, path)
    if commit is None or damaged or commit["format"] != FORMAT or commit["by"] != list(by) or commit["training"] != json.loads(json.dumps(config.training())):
        return None
    try:
        if not _whole(spark, path, commit["levels"], verify):
            return None
        index = merge_levels([_read_level(spark, path, x, config, by) for x in commit["levels"]])
        if by:
            return index
        row = index.heads.first() if index.heads is not None else None
        return replace(index, head=row and row["head"], transactions=row["transactions"] if row else 0)
    except (PySparkException, Py4JJavaError, KeyError):
        return None


def last_batch(spark: SparkSession, path: str, stream: str = "") -> int:
    """The last batch of that stream that was counted; -1 for none."""
    commit, _ = current_commit(spark, path)
    return -1 if commit is None else commit["ledger"].get(stream, -1)


def index_levels(spark: SparkSession, path: str) -> DataFrame:
    """level (0 is the oldest), section, rows, bytes of the newest commit."""
    commit, _ = current_commit(spark, path)
    rows = [(i, s, m["rows"], sum(m["files"].values())) for i, x in enumerate(commit["levels"] if commit else []) for s, m in x["sections"].items()]
    return spark.createDataFrame(rows, "level int, section string, rows long, bytes long")


def vacuum(spark: SparkSession, path: str, keep: int = 1, grace_seconds: float = 86_400.0) -> int:
    """Delete all but the newest `keep` commits, and levels that none of those names; returns the number of levels deleted. What
    changed within the grace stays, as a writer may be about to commit it. A damaged index is left alone."""
    if keep < 1:
        raise ValueError("at least one commit must be kept")
    try:
        numbers, _ = _commit_numbers(spark, path)
        named = {x["folder"] for c in _commits(spark, path, numbers[-keep:]) for x in c["levels"]}
    except (PySparkException, Py4JJavaError, ValueError, KeyError):
        return 0
    for n in numbers[:-keep]:
        removed(spark, f"{path}/commits/{n:012d}")
    old = [f for f, at in listed(spark, f"{path}/levels") if f not in named and at <= time.time() - grace_seconds]
    for f in old:
        removed(spark, f"{path}/levels/{f}")
    return len(old)


def read_ignores(spark: SparkSession, path: str) -> DataFrame:
    """Mutes; lines that can't be read, or a missing table, mute nothing."""
    try:
        found = spark.read.schema(IGNORES).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], IGNORES)
    return found.where("trigger is not null and hole is not null and until_trigger_changes is not null")


def write_ignores(ignores: DataFrame, path: str) -> None:
    ignores.select("trigger", "hole", "until_trigger_changes", "created_at", "note").write.mode("overwrite").json(path)


def append_findings(findings: DataFrame, path: str) -> None:
    """findings(timestamp, source, result) appended, a folder a day."""
    findings.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)


def trim_by_size(df: DataFrame, order: str, size: str, cap: int, target: int, by: str | Sequence[str] = ()) -> DataFrame:
    """Rows of each log: all while it is within cap, else the newest whole ones up to target, the newest always (all of them,
    where several tie). Other ties are taken in the order of their columns. One log may fill any number of tasks."""
    by = [by] if isinstance(by, str) else list(by or ())
    rest = [c for c in df.columns if c not in (*by, order)]
    summed = running_sum(df, [F.desc(order), *rest], size, "_sum", by)
    sums = df.groupBy(*by).agg(F.sum(size).alias("_all"), F.max(order).alias("_newest"))
    whole = summed.join(sums, by) if by else summed.crossJoin(F.broadcast(sums))  # one row
    return whole.where((F.col("_all") <= cap) | (F.col("_sum") <= target) | (F.col(order) == F.col("_newest"))).drop("_all", "_sum", "_newest")
