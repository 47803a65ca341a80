"""Metrics over ordered scores: ROC and precision-recall areas, quality of the top fractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums, with_rank


def scored(preds: DataFrame, score: str, is_positive) -> DataFrame:
    """The rows that can be ranked: those with a score that is a number and of which it is known what they are."""
    s = F.col(score).cast("double")
    return preds.filter(s.isNotNull() & ~F.isnan(s) & is_positive.isNotNull())


def score_counts(preds: DataFrame, by: Sequence[str], score: str, is_positive) -> DataFrame:
    """Positives and negatives at each distinct score, and `less`, minus the score. Null and NaN scores don't count."""
    out = scored(preds, score, is_positive).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg"))
    return out.withColumn("less", -F.col("score"))


def _both(counted, value):
    absent = F.raise_error(F.lit("ranks need both classes")).cast("double")
    return F.when(counted, value).otherwise(absent)


def roc_auc(preds: DataFrame, by: Sequence[str], score: str, is_positive) -> DataFrame:
    """(by, n_pos, n_neg, roc_auc) by mean ranks: ties share theirs. Rows without a score or a truth don't count."""
    counts = running_sums(score_counts(preds, by, score, is_positive).withColumn("n", F.col("pos") + F.col("neg")), by, "score", ["n"])
    mean_rank = F.col("run_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    sums = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * mean_rank).alias("ranks"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return sums.select(*by, "n_pos", "n_neg", _both((p > 0) & (n > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * n)).alias("roc_auc"))


def pr_auc(preds: DataFrame, by: Sequence[str], score: str, is_positive) -> DataFrame:
    """(by, n_pos, pr_auc): one step for each row, from the highest score down, negatives first among equals.

    With P positives and R rows above a score, its k-th positive has precision (P + k) / (R + neg + k), so
    each distinct score adds a short sum and rows themselves needn't be ordered. Rows without a score or a truth don't count."""
    counts = running_sums(score_counts(preds, by, score, is_positive).withColumn("n", F.col("pos") + F.col("neg")), by, "less", ["pos", "n"])
    above_pos, above = F.col("run_pos") - F.col("pos"), F.col("run_n") - F.col("n")
    # a score with very many rows is cut into runs of positives, so that no array grows with it
    run = 10_000
    runs = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("pos") - 1), F.lit(run).cast("long"))
    cut = counts.filter("pos > 0").select(*by, "pos", "neg", above_pos.alias("p"), above.alias("r"), F.explode(runs).alias("from"))
    steps = F.sequence(F.col("from") + 1, F.least(F.col("from") + run, F.col("pos")))
    terms = F.aggregate(steps, F.lit(0.0), lambda s, k: s + (F.col("p") + k).cast("double") / (F.col("r") + F.col("neg") + k))
    area = cut.select(*by, terms.alias("terms")).groupBy(*by).agg(F.sum("terms").alias("terms"))
    sizes = scored(preds, score, is_positive).groupBy(*by).agg(F.count_if(is_positive).alias("n_pos"))
    joined = sizes.join(area, list(by), "left") if by else sizes.crossJoin(area)
    return joined.select(*by, "n_pos", _both(F.col("n_pos") > 0, F.col("terms") / F.col("n_pos")).alias("pr_auc"))


def top_fractions(preds: DataFrame, score: str, tie: str, is_positive, fractions: Sequence[float]) -> DataFrame:
    """(fraction, taken, hits, precision, recall, enrichment) of the highest scores.

    Taken are max(1, fraction * n rounded half to even) rows; ties are ordered by `tie`. Recall and
    enrichment are 0 without positives. Fractions are told apart in the aggregation, so rows aren't
    repeated for them. Rows without a score or a truth don't count."""
    preds = scored(preds, score, is_positive)
    ranked = with_rank(preds.select(F.col(score).cast("double").alias("s"), F.col(tie).alias("t"), is_positive.alias("y")), [], -F.col("s"), F.col("t"))
    sizes = preds.agg(F.count("*").alias("n"), F.count_if(is_positive).alias("positives"))
    n, positives = sizes.first()
    taken = {f: min(max(1, round(f * n)), n) for f in fractions}
    hits = ranked.agg(*(F.count_if(F.col("y") & (F.col("rank") <= k)).alias(f"h{i}") for i, k in enumerate(taken.values())))
    rows = hits.select(F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.lit(k).cast("long").alias("taken"), F.col(f"h{i}").alias("hits")) for i, (f, k) in enumerate(taken.items())))).alias("r")).select("r.*")
    precision = F.when(F.col("taken") > 0, F.col("hits") / F.col("taken")).otherwise(0.0)
    rate = positives / n if n else 0.0
    return rows.select(
        "fraction", "taken", "hits", precision.alias("precision"),
        (F.col("hits") / F.lit(positives) if positives else F.lit(0.0)).alias("recall"),
        (precision / F.lit(rate) if rate else F.lit(0.0)).alias("enrichment"),
    )
