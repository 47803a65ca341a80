"""The registered queries over the driver's tables, each with the same result as SQL where SQL can say it.

Doubles are rounded to nine digits on both sides: sums of doubles depend on the order of partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import checks, compare, decisions, evaluate, features, fits, lookups, ordered, ranking, splits
from . import training
from .registry import QUERIES, SQL, query, rounded, t  # noqa: F401  QUERIES and SQL are read here

RATIOS = (0.7, 0.1, 0.1, 0.1)
SPLITS_SQL = "r(o, split, q) AS (VALUES (0, 'train', 0.7::DOUBLE), (1, 'validation', 0.1::DOUBLE), (2, 'calibration', 0.1::DOUBLE), (3, 'test', 0.1::DOUBLE))"


def _slots_sql(table: str, key: str, stratum: str) -> str:
    return f"""{SPLITS_SQL},
d AS (SELECT CAST({key} AS VARCHAR) sample_id, {stratum} stratum FROM {table}),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || stratum || ':' || sample_id)) position FROM d),
n AS (SELECT stratum, count(*) n FROM d GROUP BY 1),
k AS (SELECT stratum, o, split, q * n qn, unnest(range(0, CAST(ceil(q * n) AS BIGINT) + 2)) k FROM n, r),
s AS (SELECT stratum, split, row_number() OVER (PARTITION BY stratum ORDER BY k - qn, o) position FROM k),
a AS (SELECT sample_id, stratum, split FROM p JOIN s USING (stratum, position))"""


@query(f"WITH {_slots_sql('documents', 'doc_id', chr(39) * 2)} SELECT sample_id, split FROM a")
def split_hash_random(spark, sf):
    return splits.split_rows(t(spark, sf, "documents"), "doc_id", RATIOS, 42).select("sample_id", "split")


@query(f"WITH {_slots_sql('documents', 'doc_id', chr(39) * 2)} SELECT split, count(*) n FROM a GROUP BY 1")
def split_sizes(spark, sf):
    return split_hash_random(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {_slots_sql('documents', 'doc_id', 'lang')} SELECT sample_id, stratum, split FROM a")
def split_hash_stratified(spark, sf):
    return splits.split_rows(t(spark, sf, "documents"), "doc_id", RATIOS, 42, "lang")


GROUP_SQL = f"""WITH RECURSIVE {SPLITS_SQL},
u AS (SELECT source unit, count(*) size, row_number() OVER (ORDER BY sha256('42::' || source), source) i FROM documents GROUP BY 1),
n AS (SELECT sum(size)::DOUBLE n, max(i) m FROM u),
g(i, a, b, c, d, unit, split) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, ''::VARCHAR, ''::VARCHAR
  UNION ALL
  SELECT i, a + CASE WHEN w = 0 THEN size ELSE 0 END, b + CASE WHEN w = 1 THEN size ELSE 0 END,
         c + CASE WHEN w = 2 THEN size ELSE 0 END, d + CASE WHEN w = 3 THEN size ELSE 0 END,
         unit, CASE w WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'calibration' ELSE 'test' END
  FROM (SELECT u.i, g.a, g.b, g.c, g.d, u.unit, u.size,
               CASE WHEN g.a - 0.7::DOUBLE * n <= least(g.b - 0.1::DOUBLE * n, g.c - 0.1::DOUBLE * n, g.d - 0.1::DOUBLE * n) THEN 0
                    WHEN g.b - 0.1::DOUBLE * n <= least(g.c - 0.1::DOUBLE * n, g.d - 0.1::DOUBLE * n) THEN 1
                    WHEN g.c - 0.1::DOUBLE * n <= g.d - 0.1::DOUBLE * n THEN 2 ELSE 3 END w
        FROM g JOIN u ON u.i = g.i + 1 CROSS JOIN n)),
a AS (SELECT CAST(doc_id AS VARCHAR) sample_id, source unit, split FROM documents JOIN (SELECT unit, split FROM g WHERE i > 0) ON unit = source)"""


@query(f"{GROUP_SQL} SELECT sample_id, unit, split FROM a")
def split_group(spark, sf):
    return splits.split_groups(t(spark, sf, "documents"), "doc_id", "source", RATIOS, 42)


@query(
    f"""{GROUP_SQL}, g2 AS (SELECT sample_id, CASE WHEN sample_id::BIGINT % 101 = 0 THEN 'validation' WHEN sample_id::BIGINT % 103 = 0 THEN 'nowhere' ELSE split END split FROM a WHERE sample_id::BIGINT % 97 <> 0
 UNION ALL SELECT sample_id, split FROM a WHERE sample_id::BIGINT % 89 = 1 UNION ALL SELECT 'x' || sample_id, split FROM a WHERE sample_id::BIGINT % 83 = 2),
w AS (SELECT CAST(doc_id AS VARCHAR) sample_id, source unit FROM documents)
SELECT count_if(split NOT IN ('train', 'validation', 'calibration', 'test'))::BIGINT unknown_splits, count(*) - count(DISTINCT sample_id) repeated_ids,
4 - count(DISTINCT split) FILTER (split <> 'nowhere') empty_splits, (SELECT count(*) FROM w WHERE sample_id NOT IN (SELECT sample_id FROM g2)) missing_ids,
count_if(sample_id NOT IN (SELECT sample_id FROM w))::BIGINT extra_ids,
(SELECT count(*) FROM (SELECT unit FROM w JOIN g2 USING (sample_id) GROUP BY unit HAVING count(DISTINCT split) > 1)) leaking_groups FROM g2"""
)
def split_leakage_check(spark, sf):
    """Over an assignment with every kind of violation."""
    docs, good = t(spark, sf, "documents"), split_group(spark, sf).select("sample_id", "split")
    n = F.col("sample_id").cast("long")
    moved = F.when(n % 101 == 0, "validation").when(n % 103 == 0, "nowhere").otherwise(F.col("split"))
    broken = good.filter(n % 97 != 0).withColumn("split", moved).unionByName(good.filter(n % 89 == 1))
    broken = broken.unionByName(good.filter(n % 83 == 2).withColumn("sample_id", F.concat(F.lit("x"), "sample_id")))
    return splits.check_assignment(broken, docs, "doc_id", "source", splits.SPLITS)


@query("SELECT o_orderstatus, count(*) n, median(o_totalprice) median, round(stddev_pop(o_totalprice), 6) deviation FROM orders GROUP BY 1")
def train_median_baseline(spark, sf):
    found = evaluate.summary(t(spark, sf, "orders"), ["o_orderstatus"], F.col("o_totalprice"))
    return found.withColumn("deviation", F.round("deviation", 6))


@query(
    """SELECT o_orderstatus, o_orderpriority majority, n FROM (SELECT o_orderstatus, o_orderpriority, count(*) n,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) r FROM orders GROUP BY 1, 2) WHERE r = 1"""
)
def train_majority_baseline(spark, sf):
    return splits.majority(t(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority")


def _quantities(spark, sf) -> DataFrame:
    rows = t(spark, sf, "lineitem")
    p = F.col("l_quantity") + (F.col("l_linenumber") - 3) * F.lit(0.5)
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", F.col("l_quantity").alias("truth"), p.alias("prediction"))


PRED_SQL = "q AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_quantity y, l_quantity + (l_linenumber - 3) * 0.5::DOUBLE p FROM lineitem)"


@query(
    f"""WITH {PRED_SQL} SELECT l_returnflag, count(*) n, round(avg(abs(y - p)), 9) mae, round(sqrt(avg((y - p) * (y - p))), 9) rmse,
round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 9) r2 FROM q GROUP BY 1"""
)
def regression_metrics(spark, sf):
    return rounded(evaluate.regression(_quantities(spark, sf), ["mae", "rmse", "r2"], ["l_returnflag"]))


@query(
    f"""WITH {PRED_SQL}, h AS (SELECT *, floor(p + 0.5) r FROM q) SELECT l_returnflag, count(*) n, round(avg((r = y)::INT), 9) rounded_accuracy,
round(avg((abs(r - y) <= 1)::INT), 9) within_one, round(avg((r < y)::INT), 9) underprediction_rate, round(avg(r - y), 9) mean_excess FROM h GROUP BY 1"""
)
def integer_metrics(spark, sf):
    return rounded(evaluate.regression(_quantities(spark, sf), list(M.INTEGER), ["l_returnflag"]))


def _events(spark, sf) -> DataFrame:
    v = F.col("value")
    base = F.floor(v / 10) * 10.0
    return t(spark, sf, "events").filter(v.isNotNull()).select(
        "event_id", "ts", "event_type", v.alias("truth"), base.alias("lower"), (base + 4.0).alias("median"), (base + 8.0).alias("upper")
    )


EVENT_SQL = "e AS (SELECT event_id, ts, event_type, value y, floor(value / 10) * 10 lo, floor(value / 10) * 10 + 4 mid, floor(value / 10) * 10 + 8 up FROM events WHERE value IS NOT NULL)"


@query(
    f"""WITH {EVENT_SQL} SELECT event_type, count(*) n, round(avg((y BETWEEN lo AND up)::INT), 9) coverage, round(avg(up - lo), 9) width FROM e GROUP BY 1"""
)
def interval_metrics(spark, sf):
    return rounded(evaluate.intervals(_events(spark, sf), ["event_type"]).select("event_type", "n", "coverage", "width"))


@query(
    f"""WITH {EVENT_SQL} SELECT event_type, count(*) n, round(avg(greatest(0.05::DOUBLE * (y - lo), -0.95::DOUBLE * (y - lo))), 9) pinball_0_05,
round(avg(greatest(0.5::DOUBLE * (y - mid), -0.5::DOUBLE * (y - mid))), 9) pinball_0_5,
round(avg(greatest(0.95::DOUBLE * (y - up), (0.95::DOUBLE - 1) * (y - up))), 9) pinball_0_95,
round((avg(greatest(0.05::DOUBLE * (y - lo), -0.95::DOUBLE * (y - lo))) + avg(greatest(0.5::DOUBLE * (y - mid), -0.5::DOUBLE * (y - mid)))
 + avg(greatest(0.95::DOUBLE * (y - up), (0.95::DOUBLE - 1) * (y - up)))) / 3, 9) pinball_mean FROM e GROUP BY 1"""
)
def pinball_levels(spark, sf):
    return rounded(evaluate.intervals(_events(spark, sf), ["event_type"]).drop("coverage", "width"))


@query(
    f"""WITH {PRED_SQL}, b(position, lo, hi, band) AS (VALUES (0, '-inf'::DOUBLE, 10::DOUBLE, '<10'), (1, 10, 25, '[10,25)'), (2, 25, 40, '[25,40)'), (3, 40, 'inf', '>=40'), (4, 1000, 1000, 'none'))
SELECT position, band, count(y) n, round(avg(abs(y - p)), 9) mae, round(avg(floor(p + 0.5) - y), 9) mean_excess
FROM b LEFT JOIN q ON y >= lo AND y < hi WHERE position < 4 GROUP BY 1, 2"""
)
def metrics_by_band(spark, sf):
    return rounded(evaluate.by_band(_quantities(spark, sf), [10, 25, 40], ["mae", "mean_excess"]))


def _status(spark, sf) -> DataFrame:
    guess = F.when(F.col("o_totalprice") >= 250_000, "P").when(F.col("o_totalprice") >= 150_000, "O").otherwise("F")
    return t(spark, sf, "orders").select(F.col("o_orderstatus").alias("truth"), guess.alias("prediction"))


STATUS_SQL = "s AS (SELECT o_orderstatus y, CASE WHEN o_totalprice >= 250000 THEN 'P' WHEN o_totalprice >= 150000 THEN 'O' ELSE 'F' END p FROM orders)"


@query(
    f"""WITH {STATUS_SQL}, c AS (SELECT y c FROM s UNION SELECT p FROM s)
SELECT a.c truth, b.c prediction, count(s.y) n FROM c a CROSS JOIN c b LEFT JOIN s ON s.y = a.c AND s.p = b.c GROUP BY 1, 2"""
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_status(spark, sf))


@query(f"WITH {STATUS_SQL} SELECT count(*) n, round(avg((y = p)::INT), 9) accuracy FROM s")
def multiclass_accuracy(spark, sf):
    return rounded(_status(spark, sf).agg(F.count("*").alias("n"), M.accuracy(F.col("truth"), F.col("prediction")).alias("accuracy")))


def _labelled(spark, sf) -> DataFrame:
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return t(spark, sf, "labels").join(docs, "doc_id")


LABEL_SQL = "x AS (SELECT doc_id, lang, source, n_chars, quality, toxic, quality = 1 y FROM labels JOIN documents USING (doc_id))"


@query(
    f"""WITH {LABEL_SQL}, p AS (SELECT y, n_chars >= 1000 p FROM x),
c AS (SELECT count(*) n, count_if(y AND p) tp, count_if(NOT y AND p) fp, count_if(y AND NOT p) fn, count_if(NOT y AND NOT p) tn FROM p)
SELECT n, tp::BIGINT tp, fp::BIGINT fp, fn::BIGINT fn, tn::BIGINT tn, round((tp + tn) / n, 9) accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) balanced_accuracy,
round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) f1,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE
 (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) mcc FROM c"""
)
def classification_metrics(spark, sf):
    preds = _labelled(spark, sf).select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") >= 1000).alias("prediction"))
    return rounded(evaluate.classification(preds, list(M.CLASSIFICATION), True))


@query(
    f"""WITH {LABEL_SQL}, r AS (SELECT y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 r FROM x),
c AS (SELECT count_if(y) p, count_if(NOT y) n, sum(CASE WHEN y THEN r ELSE 0 END) s FROM r)
SELECT p::BIGINT n_pos, n::BIGINT n_neg, round((s - p * (p + 1) / 2) / (p::DOUBLE * n), 9) roc_auc FROM c"""
)
def roc_auc(spark, sf):
    return rounded(ranking.roc_auc(_labelled(spark, sf), [], "n_chars", F.col("quality") == 1))


@query(
    f"""WITH {LABEL_SQL}, r AS (SELECT y, sum(y::INT) OVER w tp, row_number() OVER w rn FROM x
WINDOW w AS (ORDER BY n_chars DESC, y::INT, doc_id ROWS UNBOUNDED PRECEDING))
SELECT count_if(y)::BIGINT n_pos, round(sum(CASE WHEN y THEN tp / rn ELSE 0 END) / count_if(y), 9) pr_auc FROM r"""
)
def pr_auc(spark, sf):
    return rounded(ranking.pr_auc(_labelled(spark, sf), [], "n_chars", F.col("quality") == 1))


@query(
    f"""WITH {LABEL_SQL}, r AS (SELECT y, row_number() OVER (ORDER BY n_chars DESC, doc_id) rn, count(*) OVER () n, count_if(y) OVER () pos FROM x),
f(fraction) AS (VALUES (0.01::DOUBLE), (0.02), (0.05), (0.1), (0.15), (0.25), (1.0)),
g AS (SELECT fraction, greatest(1, round_even(fraction * max(n), 0))::BIGINT taken, max(n) n, max(pos) pos FROM f, r GROUP BY 1),
h AS (SELECT fraction, taken, n, pos, (SELECT count_if(y) FROM r WHERE rn <= taken)::BIGINT hits FROM g)
SELECT fraction, taken, hits, round(hits / taken, 9) "precision", round(hits / pos, 9) recall, round((hits / taken) / (pos / n), 9) enrichment FROM h"""
)
def ranking_quality(spark, sf):
    return rounded(ranking.top_fractions(_labelled(spark, sf), "n_chars", "doc_id", F.col("quality") == 1, [0.01, 0.02, 0.05, 0.1, 0.15, 0.25, 1.0]))


CUTS_SQL = f"""WITH {LABEL_SQL}, s AS (SELECT n_chars::DOUBLE s, count_if(y) p, count_if(NOT y) n FROM x GROUP BY 1),
w AS (SELECT s, lag(s) OVER (ORDER BY s) prev, sum(p) OVER (ORDER BY s DESC) tp, sum(n) OVER (ORDER BY s DESC) fp, sum(p) OVER () pt, sum(n) OVER () nt FROM s),
c AS (SELECT coalesce((prev + s) / 2, s) threshold, tp::DOUBLE tp, fp::DOUBLE fp, (pt - tp)::DOUBLE fn, (nt - fp)::DOUBLE tn FROM w),
v AS (SELECT threshold, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS value,
 tp / (tp + fn) recall FROM c UNION ALL SELECT 'inf'::DOUBLE, 0, 0)"""


@query(f"{CUTS_SQL} SELECT threshold, round(value, 9) AS value, round(recall, 9) recall FROM v ORDER BY round(value, 9) DESC, threshold LIMIT 1")
def select_threshold_mcc(spark, sf):
    return rounded(decisions.select_threshold(_labelled(spark, sf), "n_chars", F.col("quality") == 1, "mcc"))


@query(
    f"{CUTS_SQL} SELECT threshold, round(value, 9) AS value, round(recall, 9) recall FROM v WHERE recall >= 0.97 ORDER BY round(value, 9) DESC, threshold LIMIT 1"
)
def select_threshold_min_recall(spark, sf):
    return rounded(decisions.select_threshold(_labelled(spark, sf), "n_chars", F.col("quality") == 1, "mcc", 0.97))


LEVELS = {0.5: "q50", 0.9: "q90", 0.95: "q95", 0.975: "q97"}


def _levels(spark, sf) -> DataFrame:
    rows = _quantities(spark, sf)
    return rows.select("*", *((F.col("prediction") + F.lit(add)).alias(c) for c, add in zip(LEVELS.values(), (0.0, 0.7, 1.4, 2.1))))


LEVEL_SQL = f"""{PRED_SQL}, l(level, add) AS (VALUES (0.5::DOUBLE, 0.0::DOUBLE), (0.9, 0.7), (0.95, 1.4), (0.975, 2.1)),
m AS (SELECT *, floor(p + add + 0.5) r, p + add v, CASE WHEN floor(p + 0.5) < 10 THEN '<10' WHEN floor(p + 0.5) < 25 THEN '[10,25)' WHEN floor(p + 0.5) < 40 THEN '[25,40)' ELSE '>=40' END band FROM q, l)"""


@query(
    f"""WITH {LEVEL_SQL}, g AS (SELECT level, round(avg(abs(y - v)), 9) AS value, round(avg((r < y)::INT), 9) rate FROM m GROUP BY 1)
SELECT level, value, rate, rate IS NOT NULL feasible FROM g ORDER BY value, level LIMIT 1"""
)
def decision_level(spark, sf):
    return rounded(decisions.select_level(_levels(spark, sf), LEVELS, "truth", "mae"))


@query(
    f"""WITH {LEVEL_SQL}, g AS (SELECT level, round(avg(abs(y - v)), 9) AS value, round(avg((r < y)::INT), 9) rate FROM m GROUP BY 1)
SELECT arg_min(level, (value, level)) FILTER (rate <= 0.1) level, arg_min(value, (value, level)) FILTER (rate <= 0.1) AS value,
coalesce(arg_min(rate, (value, level)) FILTER (rate <= 0.1), min(rate)) rate, count_if(rate <= 0.1) > 0 feasible FROM g"""
)
def decision_level_with_floor(spark, sf):
    return rounded(decisions.select_level(_levels(spark, sf), LEVELS, "truth", "mae", 0.1))


@query(
    f"""WITH {LEVEL_SQL}, g AS (SELECT band, level, round(avg(abs(y - v)), 9) AS value, round(avg((r < y)::INT), 9) rate FROM m GROUP BY 1, 2),
c AS (SELECT *, rate <= 0.1 ok FROM g)
SELECT band, arg_min(level, (value, level)) FILTER (ok) level, arg_min(value, (value, level)) FILTER (ok) AS value,
coalesce(arg_min(rate, (value, level)) FILTER (ok), min(rate)) rate, count_if(ok) > 0 feasible FROM c GROUP BY band"""
)
def level_by_band(spark, sf):
    return rounded(decisions.level_by_band(_levels(spark, sf), LEVELS, "truth", "prediction", [10, 25, 40], "mae", 0.1))


@query(
    f"""WITH {PRED_SQL}, k AS (SELECT unnest(range(0, 9))::INT o), z AS (SELECT y, floor(p + 0.5) r FROM q),
b AS (SELECT CASE WHEN r < 10 THEN 0 WHEN r < 25 THEN 1 WHEN r < 40 THEN 2 ELSE 3 END position, y, r FROM z),
g AS (SELECT position, o, count(*) n, round(avg((r + o < y)::INT), 9) rate FROM b, k GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY (rate <= 0.05) DESC, CASE WHEN rate <= 0.05 THEN o ELSE -o END) i FROM g)
SELECT position, ['<10', '[10,25)', '[25,40)', '>=40'][position + 1] band, n, o "offset", rate, rate <= 0.05 feasible FROM f WHERE i = 1"""
)
def band_offsets(spark, sf):
    return rounded(decisions.band_offsets(_quantities(spark, sf), "truth", "prediction", [10, 25, 40], 0.05))


@query(
    f"""WITH {PRED_SQL} SELECT l_orderkey, l_linenumber, floor(p + 0.5) + CASE WHEN floor(p + 0.5) < 6 THEN 0 WHEN floor(p + 0.5) < 20 THEN 1 ELSE 2 END published FROM q"""
)
def publish_rule(spark, sf):
    rows = _quantities(spark, sf)
    return rows.select("l_orderkey", "l_linenumber", S.published(F.col("prediction"), [(6.0, 0), (20.0, 1), (None, 2)]).alias("published"))


@query(
    f"""WITH {PRED_SQL} SELECT l_orderkey, l_linenumber, floor(CASE WHEN floor(p + 0.5) < 10 THEN p + 0.7::DOUBLE WHEN floor(p + 0.5) < 40 THEN p + 1.4::DOUBLE ELSE p + 2.1::DOUBLE END + 0.5) published FROM q"""
)
def publish_by_band(spark, sf):
    rows = _levels(spark, sf)
    levels = {"<10": F.col("q90"), "[10,40)": F.col("q95"), ">=40": F.col("q97")}
    return rows.select("l_orderkey", "l_linenumber", S.published_by_band(F.col("prediction"), [10, 40], levels).alias("published"))


CONFORMAL_SQL = f"""{EVENT_SQL}, s AS (SELECT event_type, greatest(lo - y, y - up) s FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s) i, count(*) OVER (PARTITION BY event_type) n FROM s),
k AS (SELECT event_type, n, s correction FROM r WHERE i = least(n, ceil((n + 1) * (0.95::DOUBLE - 0.05::DOUBLE))))"""


@query(f"WITH {CONFORMAL_SQL} SELECT event_type, n, round(correction, 9) correction FROM k")
def conformal_correction(spark, sf):
    return rounded(decisions.conformal_correction(_events(spark, sf), "truth", "lower", "upper", 0.95 - 0.05, ["event_type"]))


@query(
    f"""WITH {CONFORMAL_SQL}, c AS (SELECT e.*, least(lo - correction, mid) l, greatest(up + correction, mid) u FROM e JOIN k USING (event_type))
SELECT event_type, count(*) n, round(avg((y BETWEEN l AND u)::INT), 9) coverage, round(avg(u - l), 9) width FROM c GROUP BY 1"""
)
def calibrated_interval(spark, sf):
    rows = _events(spark, sf)
    found = decisions.conformal_correction(rows, "truth", "lower", "upper", 0.95 - 0.05, ["event_type"]).drop("n")
    lower, upper = S.calibrated(F.col("lower"), F.col("median"), F.col("upper"), F.col("correction"))
    joined = rows.join(found, "event_type").select("event_type", "truth", "median", lower.alias("lower"), upper.alias("upper"))
    return rounded(evaluate.intervals(joined, ["event_type"]).select("event_type", "n", "coverage", "width"))


@query(
    """WITH s AS (SELECT avg(p_size) m, stddev_pop(p_size) d, avg(p_retailprice) m2, stddev_pop(p_retailprice) d2 FROM part)
SELECT p_partkey, round((p_size - m) / d, 9) z_size, round((p_retailprice - m2) / d2, 9) z_price FROM part, s"""
)
def standardize(spark, sf):
    part = t(spark, sf, "part")
    z = fits.standardizer(part, ["p_size", "p_retailprice"]).apply()
    return rounded(part.select("p_partkey", z.alias("z")).select("p_partkey", F.get("z", 0).alias("z_size"), F.get("z", 1).alias("z_price")))


@query(
    """WITH x AS (SELECT unnest(range(1, 65)) i, embedding::DOUBLE[] e FROM embeddings), y AS (SELECT i, unnest(range(i, 65)) j, e FROM x)
SELECT (i - 1)::INT i, (j - 1)::INT j, round(sum(e[i] * e[j]), 6) v FROM y GROUP BY 1, 2"""
)
def gram_matrix(spark, sf):
    return rounded(fits.gram_cells(t(spark, sf, "embeddings"), "embedding", 64), 6)


def _parts(spark, sf) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 7).cast("double").alias("seven"), "p_retailprice")


RIDGE_SQL = """m AS (SELECT avg(size) a, stddev_pop(size) sa, avg(seven) b, stddev_pop(seven) sb, avg(p_retailprice) y FROM train),
z AS (SELECT (size - a) / sa u, (seven - b) / sb v, p_retailprice - y w FROM train, m),
g AS (SELECT sum(u * u) + 1.0 uu, sum(u * v) uv, sum(v * v) + 1.0 vv, sum(u * w) uw, sum(v * w) vw FROM z),
f AS (SELECT (uw * vv - vw * uv) / (uu * vv - uv * uv) w1, (vw * uu - uw * uv) / (uu * vv - uv * uv) w2 FROM g)"""


@query(
    f"""WITH train AS (SELECT p_size::DOUBLE size, (p_partkey % 7)::DOUBLE seven, p_retailprice FROM part), {RIDGE_SQL}
SELECT round(w1, 6) w_size, round(w2, 6) w_seven, round(y, 6) bias FROM f, m"""
)
def ridge_fit(spark, sf):
    model = fits.ridge(_parts(spark, sf), ["size", "seven"], "p_retailprice", 1.0)
    return spark.createDataFrame([(*(round(w, 6) for w in model.weights), round(model.bias, 6))], "w_size double, w_seven double, bias double")


@query(
    f"""WITH {_slots_sql("part", "p_partkey", chr(39) * 2)},
x AS (SELECT a.split, p_size::DOUBLE size, (p_partkey % 7)::DOUBLE seven, p_retailprice FROM part JOIN a ON a.sample_id = CAST(p_partkey AS VARCHAR)),
train AS (SELECT * FROM x WHERE split = 'train'), {RIDGE_SQL},
pr AS (SELECT 'baseline' source, split, p_retailprice t, (SELECT median(p_retailprice) FROM train) p FROM x
 UNION ALL SELECT 'model', split, p_retailprice, y + w1 * (size - a) / sa + w2 * (seven - b) / sb FROM x, m, f)
SELECT source, split, count(*) n, round(avg(abs(t - p)), 6) mae, round(sqrt(avg((t - p) * (t - p))), 6) rmse,
round(1 - sum((t - p) * (t - p)) / (count(*) * var_pop(t)), 6) r2 FROM pr GROUP BY 1, 2"""
)
def ridge_against_median(spark, sf):
    return rounded(training.ridge_against_median(_parts(spark, sf), "p_partkey", ["size", "seven"], "p_retailprice"), 6)


@query(
    f"""WITH {LABEL_SQL}, e AS (SELECT n_chars / 1000.0 a, (doc_id % 5)::DOUBLE b, 1 / (1 + exp(-greatest(-60, least(60, 0.1 + 0.2 * (n_chars / 1000.0) - 0.3 * (doc_id % 5))))) - y::INT e FROM x)
SELECT count(*) n, round(avg(e), 9) g_bias, round(avg(e * a), 9) g_0, round(avg(e * b), 9) g_1 FROM e"""
)
def logistic_gradient_step(spark, sf):
    x = F.array((F.col("n_chars") / 1000.0).cast("double"), (F.col("doc_id") % 5).cast("double"))
    return rounded(fits.logistic_gradient(_labelled(spark, sf), x, 2, F.col("quality"), [0.2, -0.3], 0.1))


@query("""SELECT quality AS "label", count(*) n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 9) weight FROM labels GROUP BY 1""")
def balanced_class_weights(spark, sf):
    return rounded(fits.class_weights(t(spark, sf, "labels"), "quality"))


@query(
    """WITH x AS (SELECT "label", generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE v FROM embeddings),
g AS (SELECT "label", i, avg(v) a, max(v) b, stddev_pop(v) c FROM x GROUP BY 1, 2)
SELECT "label", i - 1 + k AS at, round(CASE k WHEN 0 THEN a WHEN 64 THEN b ELSE c END, 9) AS value FROM g, (VALUES (0), (64), (128)) t(k)"""
)
def pooled_embedding(spark, sf):
    pools = features.pooled(t(spark, sf, "embeddings"), ["label"], "embedding")
    return rounded(pools.select("label", F.posexplode("features").alias("at", "value")).withColumn("at", F.col("at").cast("long")))


@query(
    """SELECT d AS l_discount, k::INT k, round(exp(-100 * (d - 0.02::DOUBLE * k) * (d - 0.02::DOUBLE * k)), 9) AS value
FROM (SELECT DISTINCT l_discount d FROM lineitem), (SELECT unnest(range(0, 6)) k)"""
)
def rbf_expansion(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_discount").distinct()
    return rounded(rows.select("l_discount", F.posexplode(S.radial_basis(F.col("l_discount"), 0.0, 0.1, 0.02, 100.0)).alias("k", "value")))


@query(
    """SELECT c_nationkey dst, count(*) n_edges, round(sum(o_totalprice), 2) total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"""
)
def graph_edge_aggregate(spark, sf):
    edges = t(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("src"))
    edges = edges.join(t(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("dst")), "cust").select("src", "dst")
    return rounded(features.edge_sums(edges, t(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), "o_totalprice"), "o_totalprice"), 2)


@query("""SELECT c_mktsegment, count(*) n_nodes, round(avg(c_acctbal), 6) mean FROM customer GROUP BY 1""")
def graph_mean_pool(spark, sf):
    return rounded(features.graph_means(t(spark, sf, "customer"), "c_mktsegment", "c_acctbal"), 6)


@query(
    """WITH p AS (SELECT "label", vec_id, embedding[1:3]::DOUBLE[] e FROM embeddings),
d AS (SELECT a."label", a.vec_id, b.vec_id other, sqrt((a.e[1] - b.e[1]) ** 2 + (a.e[2] - b.e[2]) ** 2 + (a.e[3] - b.e[3]) ** 2) distance FROM p a JOIN p b ON a."label" = b."label" AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY "label", vec_id ORDER BY distance, other) place FROM d WHERE distance <= 0.25)
SELECT "label", vec_id, other, round(distance, 9) distance, place::INT place FROM r WHERE place <= 12"""
)
def top_k_neighbours(spark, sf):
    points = t(spark, sf, "embeddings").select("label", "vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("position"))
    return rounded(lookups.nearest_within(points, "label", "vec_id", "position", 0.25, 12))


@query("SELECT doc_id, quality, lang, n_chars FROM labels JOIN documents USING (doc_id)")
def feature_lookup_strict(spark, sf):
    return lookups.lookup(t(spark, sf, "labels").select("doc_id", "quality"), t(spark, sf, "documents"), "doc_id", ["lang", "n_chars"])


@query(
    """WITH l0 AS (SELECT CASE WHEN doc_id % 50 = 7 THEN 'a/' || doc_id ELSE doc_id::VARCHAR END "name", quality + 1 size_bytes,
 CASE WHEN doc_id % 41 = 3 THEN 'no digest' WHEN doc_id % 43 = 5 THEN sha256('other') ELSE sha256(doc_id::VARCHAR) END s FROM labels),
l1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l0 WHERE "name" LIKE '%9'),
l AS (SELECT "name", count(*) times, min(size_bytes) size_bytes, min(s) s FROM l1 GROUP BY 1),
p AS (SELECT CAST(doc_id AS VARCHAR) "name", (n_chars % 2) + 1 size_bytes, sha256(CAST(doc_id AS VARCHAR)) s FROM documents)
SELECT coalesce(sum(times - 1), 0)::BIGINT repeated_entries, count_if(l."name" LIKE '%/%')::BIGINT unsafe_names, count_if(NOT regexp_full_match(l.s, '[0-9a-f]{64}'))::BIGINT bad_digests,
count_if(p."name" IS NULL)::BIGINT stale_entries, count_if(l."name" IS NULL)::BIGINT unlisted_files, count_if(l.size_bytes <> p.size_bytes)::BIGINT wrong_sizes, count_if(l.s <> p.s)::BIGINT wrong_digests,
(SELECT count(*) FROM (VALUES ('id_prop.csv'), ('1'), ('3')) r(x) WHERE x NOT IN (SELECT "name" FROM l)) missing_required FROM l FULL JOIN p ON l."name" = p."name" """
)
def manifest_reconcile(spark, sf):
    """Over a manifest with every kind of violation."""
    doc, name = F.col("doc_id"), F.col("doc_id").cast("string")
    digest = F.sha2(name.cast("binary"), 256)
    listed = t(spark, sf, "labels").select(
        F.when(doc % 50 == 7, F.concat(F.lit("a/"), name)).otherwise(name).alias("name"), (F.col("quality") + 1).cast("long").alias("size_bytes"),
        F.when(doc % 41 == 3, "no digest").when(doc % 43 == 5, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(digest).alias("sha256"),
    )
    listed = listed.unionByName(listed.filter(F.col("name").endswith("9")))
    present = t(spark, sf, "documents").select(name.alias("name"), (F.col("n_chars") % 2 + 1).alias("size_bytes"), digest.alias("sha256"))
    return checks.reconcile(listed, present, ["id_prop.csv", "1", "3"])


@query(
    """SELECT 'documents' "table", count(*) n, min(doc_id) IN (0, 1) AND max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AND count(*) = count(DISTINCT doc_id) consecutive FROM documents
UNION ALL SELECT 'labels', count(*), min(doc_id) IN (0, 1) AND max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AND count(*) = count(DISTINCT doc_id) FROM labels"""
)
def consecutive_id_check(spark, sf):
    each = [checks.consecutive_ids(t(spark, sf, name), "doc_id").select(F.lit(name).alias("table"), "n", "consecutive") for name in ("documents", "labels")]
    return each[0].unionByName(each[1])


@query(
    """SELECT doc_id, 'doc-' || substr(sha256(text), 1, 16) content_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) r FROM documents) WHERE r = 1"""
)
def content_id_dedupe(spark, sf):
    first = splits.first_by_content(t(spark, sf, "documents").select("doc_id", "text"), F.col("text"), "doc_id")
    return first.select("doc_id", S.content_id(F.col("text"), "doc-").alias("content_id"))


@query("SELECT event_id, CASE WHEN value <= 20 THEN 'low' ELSE 'high' END AS \"label\" FROM events WHERE value <= 20 OR value >= 60")
def dead_zone_label(spark, sf):
    label = S.dead_zone_label(F.col("value"), 20, 60, "high", "low")
    return t(spark, sf, "events").select("event_id", label.alias("label")).filter("label is not null")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 'large' ELSE 'small' END AS \"label\" FROM orders")
def derived_target(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.derived_class(F.col("o_totalprice"), 150_000, "large", "small").alias("label"))


@query(
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber id, l_linestatus g, l_quantity v FROM lineitem WHERE l_quantity > 2),
b AS (SELECT l_orderkey * 10 + l_linenumber id, l_linestatus g, CASE WHEN l_linestatus = 'O' THEN l_quantity WHEN l_linenumber = 1 THEN l_quantity + 0.05 ELSE l_quantity + (l_linenumber - 4) * 0.25 END v FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 2 OR l_linestatus = 'F' AND l_linenumber < 7),
j AS (SELECT coalesce(a.g, b.g) g, a.id, coalesce(a.id, b.id) ids, a.v av, b.v bv, abs(a.v - b.v) d, abs(a.v - 25) m FROM a FULL JOIN b USING (id)),
s AS (SELECT g l_linestatus, count(d) n, count_if(bv IS NULL)::BIGINT only_left, count_if(av IS NULL)::BIGINT only_right, max(d) max_diff, round(avg(d), 9) mean_diff,
arg_min(ids, (-d, ids)) FILTER (d IS NOT NULL) worst, count_if((av >= 25) <> (bv >= 25))::BIGINT flips, arg_min(ids, (m, ids)) FILTER (d IS NOT NULL) closest, min(m) FILTER (d IS NOT NULL) closest_margin FROM j GROUP BY 1)
SELECT *, CASE WHEN only_left > 0 OR only_right > 0 OR max_diff > 0.1 THEN 'differs' WHEN flips > 0 THEN 'flips' ELSE 'same' END verdict FROM s"""
)
def run_comparison(spark, sf):
    """Runs that agree in one group and lack each other's ids in the other."""
    rows = t(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    opened = F.col("l_linestatus") == "O"
    left = rows.filter("l_quantity > 2").select("id", F.col("l_linestatus"), F.col("l_quantity").alias("v"))
    moved = F.when(opened, F.col("l_quantity")).when(F.col("l_linenumber") == 1, F.col("l_quantity") + 0.05).otherwise(F.col("l_quantity") + (F.col("l_linenumber") - 4) * F.lit(0.25))
    right = rows.filter((opened & (F.col("l_quantity") > 2)) | ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") < 7))).select("id", F.col("l_linestatus"), moved.alias("v"))
    return rounded(compare.verdict(compare.differences(left, right, "id", "v", 25.0, ["l_linestatus"]), 0.1))


@query(
    """WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) epoch, round(avg(value), 9) loss FROM events GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER w i, min(loss) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best FROM d WINDOW w AS (PARTITION BY event_type ORDER BY epoch)),
b AS (SELECT *, best IS NULL OR loss < best better, max(CASE WHEN best IS NULL OR loss < best THEN i END) OVER (PARTITION BY event_type ORDER BY epoch ROWS UNBOUNDED PRECEDING) last FROM a),
c AS (SELECT *, min(CASE WHEN i - last >= 3 THEN i END) OVER (PARTITION BY event_type) stop FROM b)
SELECT event_type, max(epoch) epoch, arg_max(loss, i) loss FROM c WHERE better AND (stop IS NULL OR i <= stop) GROUP BY 1"""
)
def early_stopping_epoch(spark, sf):
    daily = t(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("epoch")).agg(F.round(F.avg("value"), 9).alias("loss"))
    return splits.early_stop(daily, ["event_type"], "epoch", "loss", 3)


@query("SELECT p_partkey, greatest(1, ceil(round(p_size / 0.7::DOUBLE, 5)))::INT points FROM part")
def mesh_from_spacing(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.mesh_points(F.col("p_size").cast("double"), 0.7).alias("points"))


@query(
    """WITH x AS (SELECT p_partkey, unnest(range(1, 13)) n, p_size::DOUBLE s FROM part)
SELECT p_partkey, (n - 1)::INT rung, n::INT mesh, round(s / n, 9) change, round((s / n + lead(s / n) OVER (PARTITION BY p_partkey ORDER BY n)) / 2, 9) probe FROM x"""
)
def mesh_ladder(spark, sf):
    return rounded(features.ladder(t(spark, sf, "part"), "p_partkey", F.col("p_size"), 12))


CELL_SQL = """v AS (SELECT p_partkey, 3 + p_size / 10.0::DOUBLE a1, 0.0::DOUBLE a2, 0.0::DOUBLE a3, 0.3::DOUBLE b1, 4 + p_size / 20.0::DOUBLE b2, 0.0::DOUBLE b3, 0.5::DOUBLE c1, (p_partkey % 7) / 10.0::DOUBLE c2, 5 + p_size / 50.0::DOUBLE c3 FROM part),
l AS (SELECT *, a1 a, sqrt(b1 ** 2 + b2 ** 2) b, sqrt(c1 ** 2 + c2 ** 2 + c3 ** 2) c, a1 * b2 * c3 volume FROM v),
r AS (SELECT *, 2 * pi() / a1 x1, -2 * pi() * b1 / (a1 * b2) x2, 2 * pi() * (b1 * c2 - b2 * c1) / volume x3, 0.0 y1, 2 * pi() / b2 y2, -2 * pi() * c2 / (b2 * c3) y3, 2 * pi() / c3 z3 FROM l),
m AS (SELECT *, x1 ** 2 m11, x1 * x2 m12, x1 * x3 m13, x2 ** 2 + y2 ** 2 m22, x2 * x3 + y2 * y3 m23, x3 ** 2 + y3 ** 2 + z3 ** 2 m33,
 sqrt(x1 ** 2 + x2 ** 2 + x3 ** 2) ra, sqrt(y2 ** 2 + y3 ** 2) rb, z3 rc FROM r)"""


def _cells(spark, sf):
    """Cells whose axes aren't at right angles."""
    zero, size = F.lit(0.0), F.col("p_size").cast("double")
    return t(spark, sf, "part"), "p_partkey", (3 + size / 10, zero, zero), (F.lit(0.3), 4 + size / 20, zero), (F.lit(0.5), (F.col("p_partkey") % 7) / 10, 5 + size / 50)


@query(
    f"""WITH {CELL_SQL} SELECT p_partkey, round(a, 9) a, round(b, 9) b, round(c, 9) c, round(degrees(acos((b1 * c1 + b2 * c2) / (b * c))), 6) alpha, round(degrees(acos(c1 / c)), 6) beta,
round(degrees(acos(b1 / b)), 6) gamma, round(volume, 6) volume, round(ra, 9) ra, round(rb, 9) rb, round(rc, 9) rc,
round(ra ** 2 + rb ** 2 + rc ** 2, 6) trace, round((x1 * y2 * z3) ** 2, 6) determinant FROM m"""
)
def lattice_features(spark, sf):
    """The metric's eigenvalues are compared by their sum and product."""
    cell = features.lattice_block(*_cells(spark, sf))
    low, middle, high = F.col("low"), F.col("middle"), F.col("high")
    out = rounded(cell.withColumns({"trace": low + middle + high, "determinant": low * middle * high}).drop("low", "middle", "high"))
    return out.withColumns({n: F.round(n, 6) for n in ("alpha", "beta", "gamma", "volume", "trace", "determinant")})


@query(
    f"""WITH {CELL_SQL}, q AS (SELECT *, (y2 * 0 + y3 * z3) / (rb * rc) ca, x3 * z3 / (ra * rc) cb, (x2 * y2 + x3 * y3) / (ra * rb) cg, list_sort([ra, rb, rc]) s FROM m)
SELECT p_partkey, round(ra, 6) ra, round(rb, 6) rb, round(rc, 6) rc, round(x1 * y2 * z3, 6) rvolume, round(degrees(acos(ca)), 6) ralpha, round(degrees(acos(cb)), 6) rbeta, round(degrees(acos(cg)), 6) rgamma,
round(m11 + m22 + m33, 6) trace, round(m11 ** 2 + m22 ** 2 + m33 ** 2 + 2 * (m12 ** 2 + m13 ** 2 + m23 ** 2), 5) trace_squared, round((x1 * y2 * z3) ** 2, 5) determinant,
round(s[3] / s[1], 6) longest_ratio, round(s[2] / s[1], 6) middle_ratio, round(abs(ca) + abs(cb) + abs(cg), 6) skew FROM q"""
)
def reciprocal_features(spark, sf):
    """The ratio of eigenvalues is compared in the tests."""
    out = features.reciprocal_block(*_cells(spark, sf)).drop("spread")
    return rounded(out.withColumns({n: F.round(n, 5) for n in ("trace_squared", "determinant")}), 6)


@query("SELECT c_custkey, c_name FROM customer ORDER BY sha256('7::' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50")
def hash_sample(spark, sf):
    return splits.hash_sample(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 7)


@query(
    r"""WITH x AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM conversations
 UNION ALL SELECT doc_id, -1, unnest(['| a | b |', '|:--|--:|', '|---|', '```', '|---|---|', '  ~~~', 'text', '- | -', '| --- x |', '---', '|::|', ' -|']), unnest(range(1, 13)) FROM documents WHERE doc_id % 3 = 0),
y AS (SELECT conv_id, turn * 1000000 + i - 1 ord, trim(line, ' ') line FROM x),
z AS (SELECT conv_id, ord, line, left(line, 3) IN ('```', '~~~') fence, sum((left(line, 3) IN ('```', '~~~'))::INT) OVER (PARTITION BY conv_id ORDER BY ord) % 2 = 1 inside FROM y),
h AS (SELECT *, NOT inside AND NOT fence AND instr(line, '|') > 0 AND instr(line, '-') > 0 AND len(list_filter(string_split(line, ''), lambda c: c NOT IN ('|', '-', ':', ' ', chr(9), ''))) = 0 hit FROM z)
SELECT conv_id, count_if(hit)::BIGINT "tables", coalesce(string_agg(ord::VARCHAR, ',' ORDER BY ord) FILTER (hit), '') "lines" FROM h GROUP BY 1"""
)
def tables_outside_fences(spark, sf):
    """Over the lines of all turns, and a written table before some of them."""
    parts = t(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    said = F.array(*map(F.lit, ("| a | b |", "|:--|--:|", "|---|", "```", "|---|---|", "  ~~~", "text", "- | -", "| --- x |", "---", "|::|", " -|")))
    more = t(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("conv_id"), F.lit(-1).alias("turn"), F.posexplode(said).alias("i", "line"))
    lines = parts.unionByName(more).withColumn("at", F.col("turn") * 1_000_000 + F.col("i"))
    return checks.tables_outside_fences(lines, "conv_id", "at", "line").withColumn("lines", F.concat_ws(",", F.col("lines").cast("array<string>")))


@query("SELECT doc_id, text FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def exclusion_list(spark, sf):
    return lookups.excluded(t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark"), "text")


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) only_left, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) only_right")
def set_differences(spark, sf):
    return lookups.both_ways(t(spark, sf, "labels"), t(spark, sf, "documents"), "doc_id")


@query("SELECT count(*) n, count_if(NOT l_discount > 0)::BIGINT outside FROM lineitem")
def target_domain(spark, sf):
    return checks.target_domain(t(spark, sf, "lineitem"), "l_discount", "positive")


@query(
    """WITH x AS (SELECT event_type, CASE event_id % 9 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN value || 'x' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' WHEN 4 THEN '' WHEN 5 THEN '1e999' WHEN 6 THEN '1,5' ELSE value::VARCHAR END s, event_id % 9 IN (0, 7, 8) AND value IS NOT NULL ok FROM events)
SELECT event_type, count(*) n, count_if(ok)::BIGINT numbers FROM x GROUP BY 1"""
)
def strict_numbers(spark, sf):
    """Over texts of which most say no finite number."""
    v, k = F.col("value").cast("string"), F.col("event_id") % 9
    said = F.when(k == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(k == 1, F.concat(v, F.lit("x"))).when(k == 2, "nan").when(k == 3, "inf").when(k == 4, "").when(k == 5, "1e999").when(k == 6, "1,5").otherwise(v)
    rows = t(spark, sf, "events").withColumn("number", S.strict_number(said))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("number").alias("numbers"))


@query(f"WITH {EVENT_SQL} SELECT event_id, lo <= mid + 1e-3 * greatest(1, abs(lo), abs(mid), abs(up)) AND mid <= up + 1e-3 * greatest(1, abs(lo), abs(mid), abs(up)) \"ordered\" FROM e")
def ordered_quantiles(spark, sf):
    return decisions.ordered_levels(_events(spark, sf), ["lower", "median", "upper"]).select("event_id", "ordered")


@query("""SELECT l_returnflag, l_linenumber::DOUBLE AS "key", sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber)::BIGINT run_n FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def running_counts(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("double").alias("key")).agg(F.count("*").alias("n"))
    return ordered.running_sums(rows, ["l_returnflag"], "key", ["n"]).drop("n")


@query(
    f"""WITH RECURSIVE {LABEL_SQL}, k AS (SELECT avg(n_chars / 1000.0) ma, stddev_pop(n_chars / 1000.0) sa, avg((doc_id % 5)::DOUBLE) mb, stddev_pop((doc_id % 5)::DOUBLE) sb, count(*) n FROM x),
d AS MATERIALIZED (SELECT doc_id, (n_chars / 1000.0 - ma) / sa u, ((doc_id % 5)::DOUBLE - mb) / sb v, quality::DOUBLE y FROM x, k),
w(i, a, b, c) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT i + 1, any_value(a) - 0.1 * (avg(e * u) + any_value(a) / any_value(n)), any_value(b) - 0.1 * (avg(e * v) + any_value(b) / any_value(n)), any_value(c) - 0.1 * avg(e)
 FROM (SELECT i, a, b, c, u, v, 1 / (1 + exp(-greatest(-60, least(60, c + a * u + b * v)))) - y e, (SELECT n FROM k) n FROM w, d WHERE i < 500) GROUP BY i)
SELECT doc_id, round(1 / (1 + exp(-(c + a * u + b * v))), 6) score FROM d, w WHERE i = 500"""
)
def logistic_fit(spark, sf):
    rows = _labelled(spark, sf).select("doc_id", (F.col("n_chars") / 1000.0).cast("double").alias("length"), (F.col("doc_id") % 5).cast("double").alias("five"), "quality")
    model = fits.logistic(rows, ["length", "five"], F.col("quality"), 500, 0.1, 1.0)
    return rows.select("doc_id", F.round(model.probability(), 6).alias("score"))


@query()
def class_weighted_forest(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 2).cast("int").alias("small"))
    fitted = fits.balanced_forest(rows, "embedding", "small", 10)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = fitted.transform(rows.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return scored.select("vec_id", F.round(F.get(vector_to_array("probability"), 1), 6).alias("score"))


@query()
def quantile_forest(spark, sf):
    rows = t(spark, sf, "embeddings").withColumn("target", F.round(F.get("embedding", 0).cast("double") * 10 + F.col("label"), 3))
    return fits.quantile_forest(rows, rows, "vec_id", "embedding", "target", [0.05, 0.5, 0.95], 10)


from . import derived_queries, structure_queries  # noqa: E402, F401  register the rest
