"""Metrics, decisions and fits against naive versions over drawn rows; and cases that are true by definition."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import decisions, evaluate, fits, ranking


def up(x):
    return math.floor(x + 0.5)


def mean(xs):
    xs = list(xs)
    return sum(xs) / len(xs)


def drawn(seed, n=83, rungs=30):
    """Whole truths and predictions with halves among them."""
    r = np.random.default_rng(seed)
    y = r.integers(0, rungs, n)
    return [(float(a), float(a) + float(d) / 2) for a, d in zip(y, r.integers(-7, 8, n))]


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "truth double, prediction double")


NAIVE = {
    "mae": lambda rows: mean(abs(y - p) for y, p in rows),
    "rmse": lambda rows: math.sqrt(mean((y - p) ** 2 for y, p in rows)),
    "r2": lambda rows: 1 - sum((y - p) ** 2 for y, p in rows) / sum((y - mean(y for y, _ in rows)) ** 2 for y, _ in rows),
    "rounded_accuracy": lambda rows: mean(up(p) == y for y, p in rows),
    "within_one": lambda rows: mean(abs(up(p) - y) <= 1 for y, p in rows),
    "underprediction_rate": lambda rows: mean(up(p) < y for y, p in rows),
    "mean_excess": lambda rows: mean(up(p) - y for y, p in rows),
}


@pytest.mark.parametrize("seed", [1, 2])
def test_regression_metrics(spark, seed):
    rows = drawn(seed)
    r = evaluate.regression(pairs(spark, rows), list(NAIVE)).first()
    assert r.n == len(rows) and {k: r[k] for k in NAIVE} == pytest.approx({k: f(rows) for k, f in NAIVE.items()})


def test_gaps_are_in_no_metric(spark):
    rows = drawn(3)
    gaps = [(None, 4.0), (4.0, None), (None, None)]
    frame = spark.createDataFrame(rows + gaps, "truth double, prediction double")
    r = evaluate.regression(frame, list(NAIVE)).first()
    assert r.n == len(rows) and {k: r[k] for k in NAIVE} == pytest.approx({k: f(rows) for k, f in NAIVE.items()})
    assert sum(b.n for b in evaluate.by_band(frame, [9], ["mae"]).collect()) == len(rows)
    labelled = spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a"), ("b", None)], "truth string, prediction string")
    c = evaluate.classification(labelled, ["accuracy"], "a").first()
    assert (c.n, c.tp, c.fp, c.fn, c.tn, c.accuracy) == (2, 1, 1, 0, 0, 0.5)


def test_errors_of_truths_that_fit_no_metric(spark):
    with pytest.raises(Exception, match="truth that varies"):
        evaluate.regression(pairs(spark, [(4, 1), (4, 9)]), ["r2"]).collect()
    with pytest.raises(Exception, match="whole numbers"):
        evaluate.regression(pairs(spark, [(0.25, 1)]), ["mean_excess"]).collect()
    for metrics, said in ((["precision", "recall", "f1", "mcc"], None), (["balanced_accuracy"], "both classes")):
        none = evaluate.classification(pairs(spark, [(0, 0)] * 3), metrics, 1.0)
        if said:
            with pytest.raises(Exception, match=said):
                none.collect()
        else:
            assert [none.first()[m] for m in metrics] == [0] * 4


def test_intervals(spark):
    r = np.random.default_rng(4)
    rows = [(float(y), float(m - a), float(m), float(m + b)) for y, m, a, b in zip(r.normal(0, 2, 60), r.normal(0, 1, 60), r.random(60) * 2, r.random(60) * 2)]
    frame = spark.createDataFrame([*rows, (1.0, None, 2.0, None), (None, 0.0, 1.0, 2.0)], "truth double, lower double, median double, upper double")
    got = evaluate.intervals(frame, levels=(0.1, 0.5, 0.9)).first()
    loss = [mean(max(q * (row[0] - row[k]), (q - 1) * (row[0] - row[k])) for row in rows) for k, q in ((1, 0.1), (2, 0.5), (3, 0.9))]
    assert (got.n, got.coverage, got.width) == (60, mean(lo <= y <= hi for y, lo, _, hi in rows), pytest.approx(mean(hi - lo for _, lo, _, hi in rows)))
    assert (got.pinball_0_1, got.pinball_0_5, got.pinball_0_9, got.pinball_mean) == pytest.approx((*loss, mean(loss)))
    with pytest.raises(Exception, match="both ends"):
        evaluate.intervals(spark.createDataFrame([(1.0, 0.0, 1.0, None)], "truth double, lower double, median double, upper double")).collect()


@pytest.mark.parametrize("seed", [5, 6])
def test_classification(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(y), int(y) if k else 1 - int(y)) for y, k in zip(r.random(70) < 0.3, r.random(70) < 0.8)]
    tp, fp, fn, tn = (sum(row == c for row in rows) for c in ((1, 1), (0, 1), (1, 0), (0, 0)))
    want = {
        "accuracy": (tp + tn) / 70, "precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn), "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2,
        "mcc": (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)),
    }
    got = evaluate.classification(pairs(spark, rows), list(want), 1.0).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (tp, fp, fn, tn) and {k: got[k] for k in want} == pytest.approx(want)


def scored(spark, rows):
    return spark.createDataFrame([(i, float(s), bool(y)) for i, (s, y) in enumerate(rows)], "id long, score double, y boolean")


def drawn_scores(seed, n=64):
    """Scores with many ties."""
    r = np.random.default_rng(seed)
    return [(float(s) / 8, bool(y)) for s, y in zip(r.integers(0, 9, n), r.random(n) < 0.4)]


@pytest.mark.parametrize("seed", [7, 8])
def test_areas(spark, seed):
    rows = drawn_scores(seed)
    frame = scored(spark, rows)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = mean((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert ranking.roc_auc(frame, [], "score", F.col("y")).first().roc_auc == pytest.approx(wins)
    hits, steps = 0, []
    for at, (_, y) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1):
        hits += y
        steps += [hits / at] * y
    assert ranking.pr_auc(frame, [], "score", F.col("y")).first().pr_auc == pytest.approx(mean(steps))
    with pytest.raises(Exception, match="both classes"):
        ranking.roc_auc(frame.filter("not y"), [], "score", F.col("y")).collect()


def test_top_fractions(spark):
    rows = drawn_scores(9)
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][0], i))
    rate = mean(y for _, y in rows)
    fractions = [0.001, 0.1, 0.33, 1.0]
    for r in ranking.top_fractions(scored(spark, rows), "score", "id", F.col("y"), fractions).collect():
        k = max(1, round(r.fraction * len(rows)))
        hits = sum(rows[i][1] for i in order[:k])
        assert (r.taken, r.hits, r.precision, r.recall, r.enrichment) == (k, hits, pytest.approx(hits / k), pytest.approx(hits / (rate * len(rows))), pytest.approx(hits / k / rate))
    none = ranking.top_fractions(scored(spark, [(s, False) for s, _ in rows]), "score", "id", F.col("y"), [0.5]).first()
    assert (none.recall, none.enrichment) == (0, 0)


def test_rounding_is_up_from_half(spark):
    from plumbline.functions.metrics import half_up

    values = [k / 4 for k in range(-14, 15)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", half_up(F.col("x")).alias("r")).collect()
    assert all(r.r - 0.5 <= r.x < r.r + 0.5 for r in got)


@pytest.mark.parametrize("edges", [[11], [4, 9, 21], [-5, 500]])
def test_bands(spark, edges):
    rows = drawn(10)
    bounds = [-math.inf, *edges, math.inf]
    for r in evaluate.by_band(pairs(spark, rows), edges, ["mae", "mean_excess"]).collect():
        some = [(y, p) for y, p in rows if bounds[r.position] <= y < bounds[r.position + 1]]
        assert r.n == len(some)
        assert (r.mae, r.mean_excess) == (pytest.approx((NAIVE["mae"](some), NAIVE["mean_excess"](some))) if some else (None, None))
    with pytest.raises(ValueError, match="r2"):
        evaluate.by_band(pairs(spark, rows), edges, ["r2"])


LEVELS = {0.4: "a", 0.6: "b", 0.8: "c", 0.95: "d"}


def levelled(seed):
    r = np.random.default_rng(seed)
    return [(y, *(p + shift + float(r.integers(0, 3)) / 4 for shift in (-0.75, 0.0, 1.25, 3.5))) for y, p in drawn(seed)]


@pytest.mark.parametrize("ceiling", [None, 0.6, 0.2, 0.0])
def test_decision_levels(spark, ceiling):
    rows = levelled(11)
    frame = spark.createDataFrame(rows, "truth double, a double, b double, c double, d double")
    trials = []
    for k, level in enumerate(LEVELS, 1):
        some = [(row[0], row[k]) for row in rows]
        trials.append((NAIVE["mae"](some), level, NAIVE["underprediction_rate"](some)))
    allowed = [t for t in trials if ceiling is None or t[2] <= ceiling]
    r = decisions.select_level(frame, LEVELS, "truth", "mae", ceiling).first()
    if allowed:
        value, level, rate = min(allowed, key=lambda t: (round(t[0], 9), t[1]))
        assert (r.level, r.value, r.rate, r.feasible) == (level, pytest.approx(value), pytest.approx(rate), True)
    else:
        assert (r.level, r.feasible) == (None, False) and r.rate == pytest.approx(min(t[2] for t in trials))


@pytest.mark.parametrize("most", [2, 8])
def test_band_offsets(spark, most):
    rows, edges, ceiling = drawn(12, 200), [4, 13, 90], 0.1
    bounds = [-math.inf, *edges, math.inf]
    for r in decisions.band_offsets(pairs(spark, rows), "truth", "prediction", edges, ceiling, most).collect():
        some = [(y, up(p)) for y, p in rows if bounds[r.position] <= up(p) < bounds[r.position + 1]]
        rates = [mean(p + k < y for y, p in some) for k in range(most + 1)] if some else [0.0]
        kept = [k for k, rate in enumerate(rates) if rate <= ceiling]
        want = kept[0] if kept else most
        assert (r.n, r.offset, r.rate, r.feasible) == (len(some), want, pytest.approx(rates[want]), bool(kept))


@pytest.mark.parametrize("coverage", [0.3, 0.9, 1.0])
def test_conformal_correction(spark, coverage):
    r = np.random.default_rng(13)
    rows = [(float(y), float(m - 1), float(m + 1)) for y, m in zip(r.normal(0, 2, 41), r.normal(0, 1, 41))]
    got = decisions.conformal_correction(spark.createDataFrame(rows, "truth double, lower double, upper double"), "truth", "lower", "upper", coverage).first()
    scores = sorted(max(lo - y, y - hi) for y, lo, hi in rows)
    assert (got.n, got.correction) == (41, scores[min(41, math.ceil(42 * coverage)) - 1])


def test_intervals_keep_their_median(spark):
    r = np.random.default_rng(14)
    rows = [(float(m - a), float(m), float(m + b)) for m, a, b in r.random((50, 3))]
    for correction in (-0.6, 0.0, 0.4):
        low, high = S.calibrated(F.col("l"), F.col("m"), F.col("u"), correction)
        for old, new in zip(rows, spark.createDataFrame(rows, "l double, m double, u double").select(low.alias("l"), "m", high.alias("u")).collect()):
            assert (new.l, new.u) == pytest.approx((min(old[0] - correction, old[1]), max(old[2] + correction, old[1])))


def test_published_values(spark):
    rows = [(p,) for _, p in drawn(15)]
    got = spark.createDataFrame(rows, "m double").select("m", S.published(F.col("m"), [(4.0, 1), (17.0, 3), (None, 6)]).alias("v")).collect()
    assert all(r.v == up(r.m) + (1 if up(r.m) < 4 else 3 if up(r.m) < 17 else 6) for r in got)


@pytest.mark.parametrize("floor", [None, 0.75, 1.0])
def test_thresholds(spark, floor):
    rows = drawn_scores(16, 40)
    values = sorted({s for s, _ in rows})
    cuts = [values[0], *((a + b) / 2 for a, b in zip(values, values[1:])), math.nextafter(values[-1], math.inf)]

    def at(c):
        tp, fp = sum(y for s, y in rows if s >= c), sum(not y for s, y in rows if s >= c)
        fn, tn = sum(y for _, y in rows) - tp, sum(not y for _, y in rows) - fp
        d = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return (tp * tn - fp * fn) / d if d else 0.0, tp / (tp + fn)

    best = max((c for c in cuts if floor is None or at(c)[1] >= floor), key=lambda c: (round(at(c)[0], 9), -c))
    r = decisions.select_threshold(scored(spark, rows), "score", F.col("y"), "mcc", floor).first()
    assert r.threshold == pytest.approx(best) and r.value == pytest.approx(at(best)[0])


def test_ridge(spark):
    r = np.random.default_rng(17)
    x = r.normal(0, 1, (40, 3)) * (1, 5, 0.1) + (0, 2, 9)
    y = x @ (1.5, -0.4, 7.0) + r.normal(0, 0.3, 40)
    frame = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y)], "a double, b double, c double, y double")
    for l2 in (0.0, 3.0):
        z = (x - x.mean(0)) / x.std(0)
        want = z @ np.linalg.solve(z.T @ z + l2 * np.eye(3), z.T @ (y - y.mean())) + y.mean()
        assert [v.s for v in frame.select(fits.ridge(frame, ["a", "b", "c"], "y", l2).score().alias("s")).collect()] == pytest.approx(want.tolist())
    with pytest.raises(ValueError, match="singular"):
        fits.ridge(frame.withColumn("d", F.col("a") * 2), ["a", "d"], "y")


def test_standardizer(spark):
    values = [p for _, p in drawn(18)]
    s = fits.standardizer(spark.createDataFrame([(x, 5.0) for x in values], "x double, k double"), ["x", "k"])
    assert s.means == pytest.approx((mean(values), 5.0)) and s.deviations == pytest.approx((statistics.pstdev(values), 1.0))


def test_median_and_majority(spark):
    from plumbline.operators.splits import majority
    from plumbline.plans.training import train_median

    for n in (30, 31):
        values = [p for _, p in drawn(19, n)]
        assert train_median(spark.createDataFrame([(x,) for x in values], "x double"), "x") == statistics.median(values)
    r = majority(spark.createDataFrame([(x,) for x in ["b", "c", "a", "c", "b", None, None, None]], "x string"), [], "x").first()
    assert (r.majority, r.n) == ("b", 2)


def test_strict_numbers(spark):
    good = {"-0.25": -0.25, "\t7": 7.0, "1e3 ": 1000.0, ".5": 0.5}
    bad = ["", "NaN", "Infinity", "-inf", "12a", "1 2", "1e400", None]
    rows = spark.createDataFrame([(x,) for x in [*(k.strip("\t") for k in good), *bad]], "x string")
    assert [r.n for r in rows.select(S.strict_number(F.col("x")).alias("n")).collect()] == [*good.values(), *[None] * len(bad)]


def test_eigenvalues(spark):
    r = np.random.default_rng(20)
    for m in (*(a + a.T for a in r.normal(0, 2, (4, 3, 3))), 3.0 * np.eye(3), np.diag([1.0, 1.0, 4.0])):
        got = spark.range(1).select(S.symmetric_eigenvalues([[F.lit(float(x)) for x in row] for row in m]).alias("e")).first().e
        assert got == pytest.approx(list(np.linalg.eigvalsh(m)), abs=1e-7)
