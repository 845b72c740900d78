"""How filters work together: for every order in which they may run, what each step removes, what it would have
removed alone, what good and toxic documents it costs, and its Shapley share.

A document's failures are a bit mask. Only counts of (part, mask) matter, so documents are reduced to at most 2^filters rows a
part before any order is looked at. Copies are found by radix tries (text_tries), the other filters are Spark columns.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_tries import flag_copies

# fixed values of the contract: what parts words, and the floors of the five filters
BLANKS = r"[\x20\x09-\x0D]+"
FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 3, r"[#$%&*|]"


def text_failures(text: str = "text") -> dict[str, Column]:
    """Filters A to D over a text column that has no nulls."""
    t = F.col(text)
    words = F.filter(F.split(t, BLANKS), lambda w: w != "")
    return {
        "A": F.size(words) < FEW_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(t),
        "D": t.rlike(SYMBOLS),
    }


def failure_masks(
    docs: DataFrame, filters: Mapping[str, Column], copies: str | None = "E", key: str = "doc_id", text: str = "text",
    part: str = "lang", **how,
) -> DataFrame:
    """key, part, mask: bit i is set where the i-th filter fails; the filter `copies`, the last bit, is that of exact copies.
    The filters see the text as column "text", empty where it is null. Nulls of part become the empty string."""
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    mask = F.lit(0)
    for i, failed in enumerate(filters.values()):
        mask = mask + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    own = own.withColumn("mask", mask)
    if copies is not None:
        own = flag_copies(own, "id", "text", ("part", "mask"), "copy", **how)
        own = own.withColumn("mask", F.col("mask") + F.when(F.col("copy"), F.lit(1 << len(filters))).otherwise(F.lit(0)))
    return own.select(F.col("id").alias(key), "part", "mask")


def mask_counts(masks: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled good or toxic. Of several labels of a key the greatest counts;
    null labels and keys without one count as neither."""
    own = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(good).alias("_g"), F.max(toxic).alias("_x"))
    joined = masks.join(own, F.col(key) == F.col("_k"), "left")
    return joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_g") == 1).alias("good"), F.count_if(F.col("_x") == 1).alias("toxic")
    )


def order_audit(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters (letters of names, bit by bit) and step. The orders are a constant of
    factorial size, so names should be few."""
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[j] for j in order), "step": step, "bit": 1 << i, "before": before})
            before |= 1 << i
    schema = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    each = counts.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), schema)))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    # in a share of 1/k of all orders a filter comes first among the k that a document fails
    orders = len(steps) // len(names)
    share = F.expr(f"CASE WHEN (mask & bit) <> 0 THEN n * {orders} DIV bit_count(mask) ELSE 0L END")
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    return each.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier).alias("kept"), count(fails & ~earlier).alias("removed"), count(fails & earlier).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(fails & ~earlier, "good").alias("good_lost"),
        count(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", **how) -> DataFrame:
    """The audit of the five filters over whole texts. An empty table gives no rows; columns beyond those read don't matter."""
    return order_audit(mask_counts(failure_masks(docs, text_failures(), part=part, **how), labels), "ABCDE")
