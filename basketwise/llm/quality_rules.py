"""Quality rules: a learned decision list over text statistics, emitted as one Spark conditional expression.

Sequential covering with pruning. The labelled rows are split in two: on the first part a conjunction of thresholds is
grown one test at a time by information gain, one for either verdict; on the second part its last tests are dropped while
that raises its precision. The better of the two is the next rule, the rows it covers are taken out, and so on until no
rule is better than the rest of the rows. What no rule covers gets the verdict of most rows left. Rules come out in order
as (tests, verdict), the default as a rule without tests, and verdict() turns them into when(...).when(...).otherwise().
Fitting takes a bounded sample of labelled rows (parameter sample_rows); all else covers every row.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the contract: what parts words, what counts as a symbol, and the floors of the base test
BLANKS = re.compile("[\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_stops",
          "n_lines", "n_distinct_words", "n_same_next", "longest_word")
STATS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

#: Shares that rules may test, each a quotient of two counts; the same definition serves fitting and Spark.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "stop_share": ("n_stops", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "same_next_share": ("n_same_next", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "mean_word": ("word_chars", "n_words"),
}
_UPPER, _DIGIT, _STOP = re.compile(r"[^\W\d_]").findall, re.compile(r"\d").findall, ".!?"


def text_stats(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS."""
    words = [w for w in BLANKS.split(text) if w]
    n = len(words)
    joined = "".join(words)
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n > 2:
        base = np.int64(len(ids))
        if len(ids) < 2_000_000:
            windows = (seq[:-2] * base + seq[1:-1]) * base + seq[2:]
            _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
            twice = times[back] > 1
        else:
            seen = Counter(zip(words, words[1:], words[2:]))
            twice = np.fromiter((seen[x] > 1 for x in zip(words, words[1:], words[2:])), bool, n - 2)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    upper = sum(map(str.isupper, joined)) if not joined.islower() else 0
    return (
        n, len(joined), sum(map(joined.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, upper,
        len(_DIGIT(joined)), sum(map(joined.count, _STOP)), len(lines), len(ids),
        int((seq[1:] == seq[:-1]).sum()), max(map(len, words), default=0),
    )


def stats_column(text) -> Column:
    """Struct column of the counts; null counts as the empty text."""

    @F.arrow_udf(STATS_TYPE)
    def counted(texts: pa.Array) -> pa.Array:
        rows = [text_stats(t.as_py() or "") for t in texts]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
        return pa.StructArray.from_arrays(columns, list(COUNTS))

    return counted(text)


class Test(NamedTuple):
    share: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.share)]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self, stats: str) -> Column:
        top, under = SHARES[self.share]
        value = F.col(f"{stats}.{top}") / F.greatest(F.col(f"{stats}.{under}"), F.lit(1))
        return value >= self.threshold if self.above else value < self.threshold


class Rule(NamedTuple):
    tests: tuple[Test, ...]
    keep: bool


def _gain(p, n, p0, n0):
    return p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0)))


def _grow(x, y, names, max_tests):
    """Tests that single out rows with y true, best information gain first."""
    tests: list[Test] = []
    inside = np.ones(len(y), bool)
    while len(tests) < max_tests and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        if not p0:
            break
        best = (1e-6, None)
        for j, name in enumerate(names):
            order = np.argsort(x[inside, j], kind="stable")
            v, t = x[inside, j][order], y[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below, at = np.cumsum(t)[cut - 1], cut
            for above, p, n in ((False, below, at - below), (True, p0 - below, len(v) - at - (p0 - below))):
                g = _gain(p, n, p0, n0)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (g[k], Test(name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(x, names)
    return tests


def _covered(tests, x, names):
    out = np.ones(len(x), bool)
    for t in tests:
        out &= t.holds(x, names)
    return out


def learn_rules(
    x: np.ndarray, good: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4,
    min_precision: float = 0.9, min_covered: int = 3, seed: int = 7,
) -> list[Rule]:
    """Ordered rules of either verdict; a last one without tests if what is left is rejected, else it is kept. Rows are
    the same whatever their order: they are sorted first. Fewer than min_covered rows of a verdict: no rule for it. Of
    two rules with equal gain the rejecting one comes first."""
    order = np.lexsort(np.column_stack([x, good]).T)
    x, good = x[order], good[order]
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    rules: list[Rule] = []

    def next_rule(keep: bool):
        """(gain, rule, rows covered) of the best rule for a verdict, None if it is no better than the rest."""
        target = good == keep
        grow, prune = left & part, left & ~part
        if target[grow].sum() < min_covered or target[grow].all():
            return None
        tests = _grow(x[grow], target[grow], names, max_tests)

        def worth(ts):
            c = _covered(ts, x[prune], names)
            p, n = (c & target[prune]).sum(), (c & ~target[prune]).sum()
            return (p - n) / max(p + n, 1)

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        c = _covered(tests, x, names) & left
        hit, all_hit, rest = (c & target).sum(), (left & target).sum(), left.sum()
        if not tests or hit < min_covered or hit < min_precision * c.sum() or hit * rest <= all_hit * c.sum():
            return None
        return hit * (np.log2(hit / c.sum()) - np.log2(all_hit / rest)), Rule(tuple(tests), keep), c

    while len(rules) < max_rules:
        found = [r for r in (next_rule(False), next_rule(True)) if r]
        if not found:
            break
        _, rule, covered = max(found, key=lambda r: r[0])
        rules.append(rule)
        left &= ~covered
    default = not left.any() or 2 * good[left].sum() >= left.sum()
    while rules and rules[-1].keep == default:  # says what the default says
        rules.pop()
    return rules if default else [*rules, Rule((), False)]


def verdict(rules: list[Rule], stats: str) -> Column:
    """The rules in order as one conditional expression; true keeps. A rule without tests holds for all rows left."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for t in rule.tests:
            test = test & t.column(stats)
        out = F.when(test, F.lit(rule.keep)) if out is None else out.when(test, F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, key: str = "doc_id", text: str = "text",
    label: str = "quality", **options,
) -> list[Rule]:
    """Rules from at most sample_rows labelled documents, taken by the order of a hash of the key (so the same ones
    whatever the partitions). Labels that are null, and keys without a document, are left out. A key with several labels
    counts with the least of them, one with several documents with the one of least counts. No labels: no rules."""
    picked = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("id")).agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    wanted = [tuple(r) for r in picked.collect()]  # bounded by sample_rows
    if not wanted:
        return []
    small = docs.sparkSession.createDataFrame(wanted, picked.schema)
    stats = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(small), "id").select(
        "id", "label", stats_column(F.col("t")).alias("s")
    )
    # a key may have many rows: one of them, so that what is collected stays within sample_rows
    rows = stats.groupBy("id", "label").agg(F.min("s").alias("s")).select("label", "s.*").collect()
    rows = [r for r in rows if r["n_words"] >= MIN_WORDS]
    names = list(SHARES)
    x = np.array([[r[a] / max(r[b], 1) for a, b in SHARES.values()] for r in rows], float).reshape(-1, len(names))
    return learn_rules(x, np.array([bool(r["label"]) for r in rows], bool), names, **options)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", prefix: str = "_quality") -> DataFrame:
    """docs with the struct <prefix>_stats and the booleans <prefix>_base_failed and <prefix>_kept added.

    Row-local: no shuffle. Null and empty texts have no words and fail the base test; repeated rows and null keys are
    judged each for itself, texts of any length whole. Columns that have the names added are replaced. An empty table
    stays empty.
    """
    s = f"{prefix}_stats"
    failed = (F.col(f"{s}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{s}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{s}.n_words")
    )
    return (
        docs.withColumn(s, stats_column(F.col(text)))
        .withColumn(f"{prefix}_base_failed", failed)
        .withColumn(f"{prefix}_kept", ~F.col(f"{prefix}_base_failed") & verdict(rules, s))
    )
