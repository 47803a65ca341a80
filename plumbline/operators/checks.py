"""Integrity rules: violations are counted in one pass, and the driver raises when there are any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import is_sha256, safe_name, strict_number


class DataError(ValueError):
    """Data that break a rule."""


def require(violations: DataFrame) -> None:
    """Raises with all counts above zero of a frame of one row."""
    found = {k: v for k, v in violations.first().asDict().items() if v}
    if found:
        raise DataError(", ".join(f"{k}: {v}" for k, v in sorted(found.items())))


def sample_rules(rows: DataFrame, task: str) -> DataFrame:
    """Counts of broken rules for rows (n_fields, sample_id, target, group): fields, ids, targets, groups."""
    sid, target = F.col("sample_id"), F.col("target")
    number = strict_number(target)
    bad_target = (F.coalesce(target, F.lit("")) == "") | (number.isNull() if task == "regression" else F.lit(False))
    return rows.agg(
        F.count_if(~F.col("n_fields").isin(2, 3)).alias("wrong_fields"),
        F.count_if(~F.coalesce(safe_name(sid), F.lit(False))).alias("unsafe_ids"),
        (F.count("*") - F.count_distinct(F.coalesce(sid, F.lit("")))).alias("repeated_ids"),
        F.count_if(bad_target).alias("bad_targets"),
        F.count_if((F.col("n_fields") == 3) & (F.coalesce("group", F.lit("")) == "")).alias("empty_groups"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("no_rows"),
    )


def consecutive_ids(rows: DataFrame, sample_id: str) -> DataFrame:
    """(n, consecutive): whether the ids are exactly 0..n-1 or 1..n, as row positions are."""
    sid = F.col(sample_id).cast("string")
    number = F.when(sid.rlike("^[0-9]{1,18}$"), sid.cast("long"))
    plain = F.count_if(number.isNull()) == 0
    low, high, n = F.min(number), F.max(number), F.count_distinct(number)
    return rows.agg(F.count("*").alias("n"), F.coalesce(plain & low.isin(0, 1) & (high - low + 1 == n) & (n == F.count("*")), F.lit(False)).alias("consecutive"))


def capabilities(rows: DataFrame, group: str) -> DataFrame:
    """(n, has_groups): every row has a group, or none of them counts."""
    return rows.agg(F.count("*").alias("n"), ((F.count(group) == F.count("*")) & (F.count("*") > 0)).alias("has_groups"))


def two_classes(rows: DataFrame, label: str, positive: str) -> DataFrame:
    """(classes, has_positive)."""
    return rows.agg(F.count_distinct(label).alias("classes"), (F.count_if(F.col(label) == positive) > 0).alias("has_positive"))


def reconcile(listed: DataFrame, present: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Counts of what parts a manifest (name, size_bytes, sha256) from files of the same columns.

    A full outer join by name; counts are summed before they leave their tasks."""
    a = listed.groupBy("name").agg(F.count("*").alias("times"), F.min("size_bytes").alias("size_l"), F.min("sha256").alias("sha_l"))
    b = present.groupBy("name").agg(F.min("size_bytes").alias("size_p"), F.min("sha256").alias("sha_p"))
    both = a.join(b, "name", "full_outer")
    here = F.col("times").isNotNull() & F.col("size_p").isNotNull()
    needed = [F.lit(1) - F.max(F.when((F.col("name") == r) & F.col("times").isNotNull(), 1).otherwise(0)) for r in required]
    missing = F.coalesce(sum(needed[1:], needed[0]), F.lit(len(required))) if required else F.lit(0)
    return both.agg(
        F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("repeated_entries"),
        F.count_if(F.col("times").isNotNull() & ~F.coalesce(safe_name(F.col("name")), F.lit(False))).alias("unsafe_names"),
        F.count_if(F.col("times").isNotNull() & ~F.coalesce(is_sha256(F.col("sha_l")), F.lit(False))).alias("bad_digests"),
        F.count_if(F.col("size_p").isNull()).alias("stale_entries"),
        F.count_if(F.col("times").isNull()).alias("unlisted_files"),
        F.count_if(here & ~F.col("size_l").eqNullSafe(F.col("size_p"))).alias("wrong_sizes"),
        F.count_if(here & ~F.col("sha_l").eqNullSafe(F.col("sha_p"))).alias("wrong_digests"),
        missing.cast("long").alias("missing_required"),
    )


def feature_rules(samples: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """Counts for features (sample_id, features): samples without a row, rows repeated, of other widths, not finite."""
    missing = samples.join(features, "sample_id", "left_anti").agg(F.count("*").alias("missing_rows"))
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = features.agg(
        (F.count("*") - F.count_distinct("sample_id")).alias("repeated_ids"),
        F.count_if(F.coalesce(F.size("features"), F.lit(-1)) != width).alias("wrong_widths"),
        F.count_if(~F.coalesce(finite, F.lit(False))).alias("not_finite"),
    )
    return missing.crossJoin(rows)


def target_domain(rows: DataFrame, value: str, kind: str, labels: Sequence[str] = (), length: Column | None = None) -> DataFrame:
    """(n, outside): how many values break a target's contract: positive, non_negative, boolean, labels, per_site or per_species.

    A value per site is an array, of `length` where that is told; one per species is a map (or a JSON object) whose keys are
    chemical symbols. Null values are outside of every domain."""
    v = F.col(value)
    is_text = isinstance(rows.schema[value].dataType, StringType)
    symbols = lambda m: F.forall(F.map_keys(m), lambda k: k.rlike("^[A-Z][a-z]?$"))
    rules = {
        "positive": lambda: (v.cast("double") > 0) & (v.cast("double") < float("inf")),
        "non_negative": lambda: (v.cast("double") >= 0) & (v.cast("double") < float("inf")),
        "boolean": lambda: v.cast("string").isin("true", "false"),
        "labels": lambda: v.isin(*labels),
        "per_site": lambda: v.isNotNull() if length is None else F.size(v) == length,
        "per_species": lambda: symbols(F.from_json(F.when(v.rlike(r"^\s*\{"), v), "map<string, string>") if is_text else v),
    }
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(rules[kind](), F.lit(False))).alias("outside"))


def tables_outside_fences(lines: DataFrame, document: str, position: str, text: str) -> DataFrame:
    """(document, tables, lines): separator rows of Markdown tables outside fenced code, and where they are.

    Such a row has a bar and a dash and else only bars, dashes, colons and blanks; whether it is fenced is told
    by the running parity of fences. `lines` are the positions, in order."""
    w = Window.partitionBy(document).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col(text).rlike(r"^\s*(```|~~~)")
    fenced = F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2 == 1
    # blanks and tabs may stand between, any white space around
    inner = F.regexp_replace(text, r"^\s+|\s+$", "")
    rule = inner.contains("|") & inner.contains("-") & (F.translate(inner, "|-: \t", "") == "")
    hit = lines.withColumn("_hit", F.coalesce(~fenced & ~fence & rule, F.lit(False)))
    at = F.array_sort(F.collect_list(F.when(F.col("_hit"), F.col(position))))
    return hit.groupBy(document).agg(F.count_if("_hit").alias("tables"), at.alias("lines"))


# Bounds of what a relaxed energy and its moments may be.
MAX_ENERGY_PER_SITE, EXCHANGE_PER_SQUARE, SLACK_PER_SITE, OVER_LIMIT = 100.0, 0.25, 0.5, 1.05


def _is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def relaxation_reasons(rows: DataFrame) -> DataFrame:
    """`rows` (energy, zero_energy, moments, symbols, limits) with `reasons` and `status`.

    `moments` has a vector for each site, `symbols` its element, `limits` the largest moment by element.
    Reasons are: an energy that isn't finite; else one of more than 100 a site; else one that lies further
    below that at zero moments than exchange can explain, 0.25 for each squared moment and 0.5 for each
    site; a moment that isn't finite; and each site whose moment is over 1.05 times its element's limit.
    Null energies and moments aren't finite; an element without a limit has none."""
    squares = F.transform("moments", lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x))
    out = rows.withColumn("_squares", squares).withColumn("_sites", F.size("moments"))
    finite = _is_finite(F.col("energy"))
    moments = F.coalesce(F.forall("moments", lambda m: F.coalesce(F.forall(m, _is_finite), F.lit(False))), F.lit(False))
    large = F.abs(F.col("energy") / F.col("_sites")) > MAX_ENERGY_PER_SITE
    bound = EXCHANGE_PER_SQUARE * F.aggregate("_squares", F.lit(0.0), lambda s, x: s + x) + SLACK_PER_SITE * F.col("_sites")
    deep = _is_finite(F.col("zero_energy")) & moments & (F.col("energy") - F.col("zero_energy") < -bound)
    energy = F.when(~finite, "energy isn't finite").when(large, "energy a site is too large").when(deep, "gain is more than exchange allows")

    def site(square: Column, i: Column) -> Column:
        symbol = F.get("symbols", i)
        over = _is_finite(square) & (F.sqrt(square) > OVER_LIMIT * F.try_element_at("limits", symbol))
        return F.when(over, F.concat(F.lit("site "), i.cast("string"), F.lit(" "), symbol, F.lit(" is over its limit")))

    sites = F.coalesce(F.array_compact(F.transform("_squares", site)), F.array().cast("array<string>"))
    reasons = F.concat(F.array_compact(F.array(energy, F.when(~moments, "a moment isn't finite"))), sites)
    out = out.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "valid").otherwise("invalid"))
    return out.drop("_squares", "_sites")


def energy_gain(energy: Column, zero_energy: Column, sites: Column) -> Column:
    """The energy that moments gain, for each site."""
    return (energy - zero_energy) / sites
