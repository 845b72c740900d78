"""Scores, classes and name tests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson_lower(co, n, z: float = Z) -> Column:
    """Lower end of the Wilson interval of co successes in n; 0 where n is not positive."""
    co, n = _column(co).cast("double"), _column(n).cast("double")
    p, zz = co / n, F.lit(z * z)
    margin = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + zz / (F.lit(4.0) * n)) / n)
    return F.when(n <= 0, F.lit(0.0)).otherwise((p + zz / (F.lit(2.0) * n) - margin) / (F.lit(1.0) + zz / n))


def wilson_sql(co: str, n: str) -> str:
    """The same formula in SQL, operation by operation."""
    co, n, zz = f"({co})::double", f"({n})::double", f"{Z * Z!r}::double"
    p = f"({co} / {n})"
    margin = f"{Z!r}::double * sqrt(({p} * (1.0::double - {p}) + {zz} / (4.0::double * {n})) / {n})"
    return f"CASE WHEN {n} <= 0 THEN 0.0::double ELSE ({p} + {zz} / (2.0::double * {n}) - {margin}) / (1.0::double + {zz} / {n}) END"


def round_conf(confidence) -> Column:
    """Half-to-even at four digits; never the negative zero."""
    return F.bround(_column(confidence), 4) + F.lit(0.0)


def facet_class(n, co, floor: float, min_support: int) -> Column:
    """unknown, predictive or non_predictive."""
    return (
        F.when(F.coalesce(_column(n), F.lit(0)) < min_support, "unknown")
        .when(wilson_lower(co, n) >= floor, "predictive").otherwise("non_predictive")
    )


def clamp_floor(floor, least: float = 0.3) -> Column:
    """An explicit confidence floor, raised to the least one allowed; a missing one stays missing."""
    floor = _column(floor)
    return F.when(floor.isNotNull(), F.greatest(F.lit(least), floor))


def is_structured(name) -> Column:
    return F.lower(_column(name)).endswith(".json")


def is_eligible_source(name) -> Column:
    """Source files that people edit: .cs, not generated, not below obj/."""
    name = _column(name)
    return name.rlike(r"(?i)\.cs$") & ~name.rlike(r"(?i)\.(g|generated|designer)\.cs$") & ~name.rlike(r"(?i)(^|/)obj/")


def normalize_path(name, root=None) -> Column:
    """Entity id of a path: forward slashes, relative to root, no leading ./ or /.

    An absolute path is relative to root only if root is one of its folders; any other keeps its folders.
    """
    flat = F.translate(_column(name), "\\", "/")
    bare = F.regexp_replace(F.regexp_replace(flat, r"^(\./)+", ""), "^/+", "")
    if root is None:
        return bare
    root = F.regexp_replace(F.translate(_column(root), "\\", "/"), "/+$", "")
    inside = flat.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.regexp_replace(F.substr(flat, F.length(root) + 2), "^/+", "")).otherwise(bare)


def abbrev(sha) -> Column:
    return F.substring(_column(sha), 1, 12)


def edit_kind(before, after, n_changed) -> Column:
    """none: no visible edit (unknown); cosmetic: edited, but no unit changed; real; unknown if a side or the units are missing."""
    plain = lambda c: F.regexp_replace(_column(c), "\r\n", "\n")
    before, after, n = plain(before), plain(after), _column(n_changed)
    return (
        F.when(before.isNull() | after.isNull() | n.isNull(), "unknown").when(before == after, "none")
        .when(n == 0, "cosmetic").otherwise("real")
    )


def mute_reason(trigger, remaining) -> Column:
    return F.format_string("muted for %d more changes of %s", _column(remaining), _column(trigger))
